"""Queries of surfaces and annotations: Q12, Q13, Q33, Q37."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as G
from ..operators import matching as X
from ..sources.shared import saved
from .fixtures import fixture
from .registry import query

PAIRS = """p AS (SELECT b.object_id, a.image_id AS image1, b.image_id AS image2, b.y AS y2, b.x AS x2, a.y AS y1, a.x AS x1,
                        (b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy) + (b.cz - a.cz) * (b.cz - a.cz) AS d2
                 FROM fx_surface a JOIN fx_surface b ON a.object_id = b.object_id AND a.image_id <> b.image_id),
          n AS (SELECT * FROM p WHERE d2 <= 5e-5)"""


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id, image1, image2, y2, x2 ORDER BY d2, y1, x1) AS k FROM n WHERE image1 < image2)
           SELECT object_id, image1 || '-' || image2 AS pair, y2 AS y, x2 AS x, CAST(x1 - x2 AS DOUBLE) AS dx, CAST(y1 - y2 AS DOUBLE) AS dy FROM r WHERE k = 1""")
def q12_surface_match_flow(spark, sf_dir):
    # both sides of the join read it: its rows are numbered once
    surface = saved(fixture(spark, sf_dir, "fx_surface"), "surface")
    return X.matches_to_flow(X.pairwise_matches(surface), ["object_id", "pair"])


@query("""WITH a AS (SELECT object_id, image_id + 1 AS view, y, x, cx, cy, cz FROM fx_surface), b AS (SELECT object_id, image_id AS view, y, x, cx, cy, cz FROM fx_surface),
          n AS (SELECT b.object_id, b.view, b.y AS y2, b.x AS x2, a.y AS y1, a.x AS x1, (b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy) + (b.cz - a.cz) * (b.cz - a.cz) AS d2 FROM a JOIN b ON a.object_id = b.object_id AND a.view = b.view),
          r AS (SELECT *, row_number() OVER (PARTITION BY object_id, view, y2, x2 ORDER BY d2, y1, x1) AS k FROM n WHERE d2 <= 5e-5)
          SELECT b.object_id, b.view, b.y, b.x, CAST(r.x1 - r.x2 AS DOUBLE) AS dx, CAST(r.y1 - r.y2 AS DOUBLE) AS dy FROM b LEFT JOIN r ON b.object_id = r.object_id AND b.view = r.view AND b.y = r.y2 AND b.x = r.x2 AND r.k = 1""")
def q12b_next_view_flow(spark, sf_dir):
    s = saved(fixture(spark, sf_dir, "fx_surface"), "surface")
    before, view = s.withColumn("view", F.col("image_id") + 1), s.withColumn("view", F.col("image_id"))
    return X.matches_to_flow(X.match_surfaces(before, view, ["object_id", "view"], unmatched=True), ["object_id", "view"])


@query(f"""WITH {PAIRS}, c AS (SELECT object_id, image_id, count(*) AS n FROM fx_surface GROUP BY object_id, image_id),
           o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY n DESC, image_id) AS place FROM c),
           m AS (SELECT n.object_id, n.image1, n.image2, count(DISTINCT (y2, x2)) AS k FROM n JOIN o a ON n.object_id = a.object_id AND n.image1 = a.image_id JOIN o b ON n.object_id = b.object_id AND n.image2 = b.image_id WHERE a.place < b.place GROUP BY n.object_id, n.image1, n.image2)
           SELECT a.object_id, a.image_id AS image1, b.image_id AS image2, round(coalesce(m.k, 0) / (0.5E0 * (a.n + b.n)), 6) AS overlap
           FROM o a JOIN o b ON a.object_id = b.object_id AND a.place < b.place LEFT JOIN m ON m.object_id = a.object_id AND m.image1 = a.image_id AND m.image2 = b.image_id""")
def q13_view_overlap(spark, sf_dir):
    return X.rank_overlaps(X.view_overlap(fixture(spark, sf_dir, "fx_surface"))).withColumn("overlap", F.round("overlap", 6))


@query("""SELECT object_id, y, x, arg_min(image_id, cz * 100 + image_id / 100.0E0) AS layer, min(cz) AS depth FROM fx_surface GROUP BY object_id, y, x""")
def q33_depth_merge(spark, sf_dir):
    layers = fixture(spark, sf_dir, "fx_surface").withColumns({"layer": F.col("image_id"), "depth": F.col("cz")})
    return G.merge_depth(layers, ["object_id"], ["layer"]).select("object_id", "y", "x", "layer", "depth")


JOINTS = """j AS (SELECT CAST(user_id AS BIGINT) AS image, event_type AS joint, round(avg(value), 6) AS x, CAST(count(*) AS DOUBLE) AS y, CAST(count(*) % 2 AS BIGINT) AS visible FROM events GROUP BY user_id, event_type),
             p AS (SELECT CAST(pair_id AS BIGINT) AS pair_id, src_image, trg_image % 100 AS trg_image FROM fx_pairs)"""


def _joints(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    joints = events.groupBy(F.col("user_id").cast("long").alias("image"), F.col("event_type").alias("joint")).agg(F.round(F.avg("value"), 6).alias("x"), F.count(F.lit(1)).cast("double").alias("y"), (F.count(F.lit(1)) % 2).alias("visible"))
    pairs = fixture(spark, sf_dir, "fx_pairs").select("pair_id", "src_image", (F.col("trg_image") % 100).alias("trg_image"))
    return pairs, joints


@query(f"""WITH {JOINTS} SELECT p.pair_id, a.joint, a.x AS src_x, b.x AS trg_x, a.y AS src_y, b.y AS trg_y FROM p JOIN j a ON p.src_image = a.image JOIN j b ON p.trg_image = b.image AND a.joint = b.joint""")
def q37_common_joints(spark, sf_dir):
    return X.common_joints(*_joints(spark, sf_dir)).select("pair_id", "joint", "src_x", "trg_x", "src_y", "trg_y")


@query(f"""WITH {JOINTS} SELECT p.pair_id, a.joint AS part_id, a.x AS src_x, b.x AS trg_x FROM p JOIN j a ON p.src_image = a.image JOIN j b ON p.trg_image = b.image AND a.joint = b.joint WHERE a.visible * b.visible = 1""")
def q37b_common_visible(spark, sf_dir):
    pairs, joints = _joints(spark, sf_dir)
    return X.common_visible(pairs, joints.withColumnRenamed("joint", "part_id")).select("pair_id", "part_id", "src_x", "trg_x")


@query("""SELECT CAST(c.c_custkey AS BIGINT) AS image_id, CAST(c.c_nationkey AS BIGINT) AS class_id, n.n_name AS class_name, c.c_mktsegment AS split, round(c.c_acctbal, 2) AS box_w FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q37c_assemble_images(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "image_id")
    classes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("class_id"), F.col("n_name").alias("class_name"))
    got = X.assemble_images(c.select("image_id", F.col("c_nationkey").cast("long").alias("class_id")), classes, c.select("image_id", F.round("c_acctbal", 2).alias("box_w")), c.select("image_id", F.col("c_mktsegment").alias("split")))
    return got.select("image_id", "class_id", "class_name", "split", "box_w")


@query("""WITH a AS (SELECT CAST(o_custkey AS BIGINT) AS image, CAST(o_orderkey % 7 AS BIGINT) AS kp_idx, max(o_totalprice) AS x, min(o_totalprice) AS y FROM orders GROUP BY o_custkey, o_orderkey % 7)
          SELECT p.pair_id, s.kp_idx, s.x AS src_x, s.y AS src_y, t.x AS trg_x, t.y AS trg_y FROM fx_pairs p JOIN a s ON p.src_image = s.image JOIN a t ON p.trg_image = t.image AND s.kp_idx = t.kp_idx""")
def q01c_attach_annotations(spark, sf_dir):
    """JON-1."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ann = o.groupBy(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 7).alias("kp_idx")).agg(F.max("o_totalprice").alias("x"), F.min("o_totalprice").alias("y"))
    return X.attach_annotations(fixture(spark, sf_dir, "fx_pairs").select("pair_id", "src_image", "trg_image"), ann).select("pair_id", "kp_idx", "src_x", "src_y", "trg_x", "trg_y")
