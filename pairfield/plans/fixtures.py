"""The tidy tables that queries run on, as SQL that Spark and DuckDB both read.

All rows of the base tables take part; images hold 256 pixels (flow) or as many as
their rows need (surface), so the tables grow with their sources.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX = {
    "fx_pairs": """
        SELECT CAST(o_orderkey AS BIGINT) AS pair_id, o_orderpriority AS category, o_orderstatus AS split,
               CAST(o_custkey AS BIGINT) AS src_image, CAST((o_custkey * 7 + 3) % 1000 AS BIGINT) AS trg_image,
               CAST(512 AS BIGINT) AS w, CAST(512 AS BIGINT) AS h
        FROM {orders}""",
    "fx_kp": """
        SELECT pair_id, CAST(kp_idx AS BIGINT) AS kp_idx, src_x, src_y, trg_x, trg_y,
               src_x + q * 2 - 51 AS pred_x, src_y + n * 11 - 44 AS pred_y
        FROM (SELECT CAST(l_orderkey AS BIGINT) AS pair_id,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS kp_idx,
                     CAST((l_partkey * 29 + 11) % 512 AS DOUBLE) AS src_x,
                     CAST((l_suppkey * 53 + l_linenumber * 71) % 512 AS DOUBLE) AS src_y,
                     CAST((l_partkey * 37) % 512 AS DOUBLE) AS trg_x,
                     CAST((l_suppkey * 41 + l_linenumber * 59) % 512 AS DOUBLE) AS trg_y,
                     l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n
              FROM {lineitem}) t""",
    "fx_flow": """
        SELECT CAST(floor(k / 256.0) AS BIGINT) AS pair_id, CAST(floor((k % 256) / 16.0) AS BIGINT) AS y, CAST(k % 16 AS BIGINT) AS x,
               CASE WHEN st = 'P' THEN NULL ELSE CAST((k * 7) % 21 - 10 AS DOUBLE) END AS dx,
               CASE WHEN st = 'P' THEN NULL ELSE CAST((k * 11) % 17 - 8 AS DOUBLE) END AS dy,
               CAST((k * 7) % 21 - 10 AS DOUBLE) + CAST((k * 13) % 9 - 4 AS DOUBLE) AS pdx,
               CAST((k * 11) % 17 - 8 AS DOUBLE) + CAST((k * 5) % 7 - 3 AS DOUBLE) AS pdy
        FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS st FROM {orders}) t""",
    "fx_surface": """
        SELECT object_id, image_id, CAST(floor(rn / 16.0) AS BIGINT) AS y, CAST(rn % 16 AS BIGINT) AS x,
               (a % 16 + 1) / 256.0E0 AS cx, (b % 16 + 1) / 256.0E0 AS cy, (a % 5 + 1) / 256.0E0 AS cz
        FROM (SELECT CAST(l_suppkey AS BIGINT) AS object_id, CAST(l_linenumber AS BIGINT) AS image_id,
                     CAST(l_partkey AS DOUBLE) AS a, l_quantity AS b,
                     row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) - 1 AS rn
              FROM {lineitem}) t""",
    "fx_features": """
        SELECT CAST(floor(vec_id / 32.0) AS BIGINT) AS pair_id, CAST(floor(vec_id / 16.0) AS BIGINT) % 2 AS side,
               CAST(vec_id % 16 AS BIGINT) AS pos, CAST(floor((vec_id % 16) / 4.0) AS BIGINT) AS row_i,
               CAST(vec_id % 4 AS BIGINT) AS col_i, CAST(label AS BIGINT) AS label, embedding AS vec
        FROM {embeddings}""",
    "fx_metrics": """
        SELECT CAST(user_id % 4 AS BIGINT) AS run, event_type AS benchmark, CAST(day(ts) AS BIGINT) AS epoch,
               CAST(event_id AS BIGINT) AS step, value, ts
        FROM {events}""",
    "fx_catalog": """
        SELECT CAST(p_partkey AS BIGINT) AS asset_id, p_name AS name, p_brand AS category,
               CAST(p_size % 3 AS BIGINT) AS asset_type, CAST(p_size AS BIGINT) AS size
        FROM {part}""",
    "fx_layout": """
        SELECT concat(lpad(CAST(o_orderkey AS VARCHAR(20)), 6, '0'), '-', CAST(o_custkey AS VARCHAR(20)), '-',
                      CAST(o_custkey * 7 + 3 AS VARCHAR(20)), ':', lower(o_orderpriority)) AS line
        FROM {orders}""",
}

#: The same rows for Spark, with windows over columns that the result keeps: Spark then knows how its rows are dealt, and deals them no second time for groups of them.
SPARK = {
    "fx_kp": """
        SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS kp_idx, src_x, src_y, trg_x, trg_y,
               src_x + q * 2 - 51 AS pred_x, src_y + n * 11 - 44 AS pred_y
        FROM (SELECT CAST(l_orderkey AS BIGINT) AS pair_id, l_linenumber, l_partkey, l_suppkey,
                     CAST((l_partkey * 29 + 11) % 512 AS DOUBLE) AS src_x,
                     CAST((l_suppkey * 53 + l_linenumber * 71) % 512 AS DOUBLE) AS src_y,
                     CAST((l_partkey * 37) % 512 AS DOUBLE) AS trg_x,
                     CAST((l_suppkey * 41 + l_linenumber * 59) % 512 AS DOUBLE) AS trg_y,
                     l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n
              FROM {lineitem}) t""",
    "fx_surface": """
        SELECT object_id, image_id, CAST(floor(rn / 16.0) AS BIGINT) AS y, CAST(rn % 16 AS BIGINT) AS x,
               (a % 16 + 1) / 256.0E0 AS cx, (b % 16 + 1) / 256.0E0 AS cy, (a % 5 + 1) / 256.0E0 AS cz
        FROM (SELECT object_id, image_id, a, b, row_number() OVER (PARTITION BY object_id, image_id ORDER BY l_orderkey, l_partkey, b, l_extendedprice) - 1 AS rn
              FROM (SELECT CAST(l_suppkey AS BIGINT) AS object_id, CAST(l_linenumber AS BIGINT) AS image_id, l_orderkey, l_partkey, l_extendedprice,
                           CAST(l_partkey AS DOUBLE) AS a, l_quantity AS b
                    FROM {lineitem}) s) t""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table over the Parquet tables of sf_dir."""
    sql = SPARK.get(name, FX[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", sql))}
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    """SQL with the fixture tables that it names put before it."""
    used = [n for n in FX if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', FX[n])})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
