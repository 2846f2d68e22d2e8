"""Queries of layouts and catalogues: Q26, Q27, Q43 (manifest), Q44, Q45, Q46."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.matching import exists_in, missing_from
from ..sources import readers as D
from ..sources.writers import category_summary
from .fixtures import fixture
from .registry import query


@query("""SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q26_json_annotations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT user_id, k, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) t GROUP BY user_id, k""")
def q26b_json_map(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("user_id", F.explode(F.from_json("props", "map<string, bigint>")).alias("name", "k"))
    return rows.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))


FILES = """f AS (SELECT p.asset_id, CASE WHEN p.asset_type = 1 THEN 'Diffuse' ELSE 'nor' END AS kind, (p.size % 2 + 1) || 'k' AS resolution, x.format, p.name || '.' || x.format AS url
           FROM fx_catalog p JOIN (SELECT 'png' AS format, 0 AS k UNION ALL SELECT 'jpg', 1 UNION ALL SELECT 'exr', 2) x ON (p.asset_id + x.k) % 3 <> 0)"""


def _files(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_catalog")
    formats = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(k).alias("k")) for k, f in enumerate(("png", "jpg", "exr"))]))
    rows = c.withColumn("x", formats).where((F.col("asset_id") + F.col("x.k")) % 3 != 0)
    return rows.select("asset_id", F.when(F.col("asset_type") == 1, "Diffuse").otherwise("nor").alias("kind"), F.concat((F.col("size") % 2 + 1).cast("string"), F.lit("k")).alias("resolution"), F.col("x.format").alias("format"), F.concat("name", F.lit("."), F.col("x.format")).alias("url"))


@query(f"""WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE format WHEN 'jpg' THEN 0 WHEN 'png' THEN 1 ELSE 2 END, format, url) AS rn FROM f WHERE kind IN ('diffuse', 'Diffuse') AND resolution = '1k')
           SELECT asset_id, format, url FROM r WHERE rn = 1""")
def q27_catalog_choice(spark, sf_dir):
    return D.choose_asset_file(_files(spark, sf_dir), "diffuse", "1k").select("asset_id", "format", "url")


@query(f"""WITH {FILES}, t AS (SELECT asset_id, CASE asset_type WHEN 0 THEN 'hdris' WHEN 1 THEN 'textures' ELSE 'models' END AS kind FROM fx_catalog), h AS (SELECT DISTINCT asset_id FROM f WHERE kind = 'Diffuse' AND resolution = '1k')
           SELECT t.asset_id, t.kind, h.asset_id IS NOT NULL AS has_file FROM t LEFT JOIN h ON t.asset_id = h.asset_id""")
def q27c_missing_files(spark, sf_dir):
    assets = D.catalog_rows(fixture(spark, sf_dir, "fx_catalog").withColumnRenamed("asset_type", "type"))
    chosen = D.choose_asset_file(_files(spark, sf_dir), "diffuse", "1k")
    there, gone = exists_in(assets, chosen, "asset_id"), missing_from(assets, chosen, "asset_id")
    return there.withColumn("has_file", F.lit(True)).unionByName(gone.withColumn("has_file", F.lit(False))).select("asset_id", "kind", "has_file")


@query("""SELECT split, category, CAST(count(*) AS BIGINT) AS n, CAST(sum(src_image) AS BIGINT) AS total FROM fx_pairs GROUP BY split, category""")
def q27d_extraction_summary(spark, sf_dir):
    return category_summary(fixture(spark, sf_dir, "fx_pairs"), ["split", "category"], "src_image")


@query("""WITH e AS (SELECT CAST(c_nationkey AS VARCHAR) AS segment, c_name AS key, c_custkey AS "offset" FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY segment, key) - 1 AS row_no FROM e)
          SELECT row_no, segment, key, "offset" FROM r""")
def q43c_manifest(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    segments = c.groupBy(F.col("c_nationkey").cast("string").alias("segment")).agg(F.map_from_entries(F.collect_list(F.struct("c_name", "c_custkey"))).alias("entries"))
    return D.manifest_rows(segments, None, 0, None).select("row_no", "segment", "key", F.col("e").alias("offset"))


PATHS = """p AS (SELECT 'scene' || (pair_id % 7) AS scene, CAST(floor(pair_id / 7.0) AS INTEGER) AS n, pair_id FROM fx_pairs)"""


def _paths(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pairs")
    scene, n = F.concat(F.lit("scene"), (F.col("pair_id") % 7).cast("string")), F.floor(F.col("pair_id") / 7).cast("string")
    flow = p.where("split <> 'P'").select(F.concat(F.lit("root/flow/"), scene, F.lit("/frame_"), n, F.lit(".flo")).alias("path"))
    images = p.where("category <> '5-LOW'").select(F.concat(F.lit("root/clean/"), scene, F.lit("/frame_"), n, F.lit(".png")).alias("path"))
    return flow.unionByName(images)


@query(f"""WITH {PATHS}, f AS (SELECT p.* FROM p JOIN fx_pairs x ON p.pair_id = x.pair_id WHERE x.split <> 'P'), i AS (SELECT p.* FROM p JOIN fx_pairs x ON p.pair_id = x.pair_id WHERE x.category <> '5-LOW')
           SELECT f.scene, f.n, 'root/clean/' || f.scene || '/frame_' || (f.n + 1) || '.png' AS src_image FROM f JOIN i a ON a.scene = f.scene AND a.n = f.n JOIN i b ON b.scene = f.scene AND b.n = f.n + 1""")
def q44_frame_pairs(spark, sf_dir):
    return D.scan_frame_pairs(_paths(spark, sf_dir)).select("scene", "n", "src_image")


@query("""WITH o AS (SELECT pair_id FROM fx_pairs WHERE split <> 'P'), a AS (SELECT pair_id FROM fx_pairs WHERE category LIKE '1%'), b AS (SELECT pair_id FROM fx_pairs WHERE category LIKE '2%' OR category LIKE '1%')
          SELECT CAST(o.pair_id AS VARCHAR) AS stem, a.pair_id IS NOT NULL AS has1, b.pair_id IS NOT NULL AS has2 FROM o LEFT JOIN a ON o.pair_id = a.pair_id LEFT JOIN b ON o.pair_id = b.pair_id WHERE a.pair_id IS NOT NULL OR b.pair_id IS NOT NULL""")
def q44b_kitti_scan(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pairs").withColumn("s", F.col("pair_id").cast("string"))
    flow = p.where("split <> 'P'").select(F.concat(F.lit("k/flow_occ/"), "s", F.lit("_10.png")).alias("path"))
    first = p.where("category LIKE '1%'").select(F.concat(F.lit("k/image_2/"), "s", F.lit("_10.png")).alias("path"))
    second = p.where("category LIKE '1%' OR category LIKE '2%'").select(F.concat(F.lit("k/image_2/"), "s", F.lit("_11.png")).alias("path"))
    got = D.scan_kitti(flow.unionByName(first).unionByName(second), "occ")
    return got.select("stem", F.col("frame1").isNotNull().alias("has1"), F.col("frame2").isNotNull().alias("has2"))


@query("""SELECT CAST(pair_id AS VARCHAR) AS src_image, CAST(pair_id * 2 AS VARCHAR) AS trg_image, CAST(i AS BIGINT) AS kp_idx, src_image + i * 1.0E0 AS src_x, src_image - i * 1.0E0 AS src_y, trg_image + i * 2.0E0 AS trg_x, trg_image - i * 2.0E0 AS trg_y FROM fx_pairs, (SELECT unnest(range(0, 10)) AS i) t""")
def q45_wide_points(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pairs")
    make = {"s": ("src_image", 1.0), "t": ("trg_image", 2.0)}
    wide = p.select(F.concat(F.lit("data/"), F.col("pair_id").cast("string")).alias("src"), F.concat(F.lit("data/"), (F.col("pair_id") * 2).cast("string")).alias("trg"), *[(F.col(c) + (i if axis == "x" else -i) * k).alias(f"{side}{axis}{i}") for side, (c, k) in make.items() for axis in "xy" for i in range(10)])
    return D.willow_points(wide).drop("category")


@query("""SELECT CAST(pair_id AS VARCHAR) AS src_image, kp_idx, src_x, src_y, trg_x, trg_y FROM fx_kp""")
def q45b_comma_points(spark, sf_dir):
    kp = fixture(spark, sf_dir, "fx_kp")
    cols = ("src_x", "src_y", "trg_x", "trg_y")
    listed = kp.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("kp_idx", *cols))).alias("p"))
    text = listed.select(F.col("pair_id").cast("string").alias("src"), F.lit("t").alias("trg"), F.lit(1).alias("class"), *[F.array_join(F.col(f"p.{c}").cast("array<string>"), ", ").alias(c) for c in cols])
    return D.caltech_points(text).select("src_image", "kp_idx", *cols)


@query("""SELECT 'run' || run AS class_name, 'img' || epoch AS image, benchmark AS joint, round(min(value), 6) AS x, round(max(value), 6) AS y FROM fx_metrics GROUP BY run, epoch, benchmark""")
def q46_nested_joints(spark, sf_dir):
    m = fixture(spark, sf_dir, "fx_metrics").groupBy(F.concat(F.lit("run"), "run").alias("c"), F.concat(F.lit("img"), "epoch").alias("i"), "benchmark").agg(F.array(F.round(F.min("value"), 6), F.round(F.max("value"), 6)).alias("p"))
    joints = m.groupBy("c", "i").agg(F.map_from_entries(F.collect_list(F.struct("benchmark", "p"))).alias("j"))
    images = joints.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("i", F.create_map(F.lit("a1"), "j")))).alias("m"))
    return D.nested_joints(images.select(F.create_map("c", "m").alias("m")), "m").select("class_name", "image", "joint", "x", "y")


@query("""SELECT 'obj' || image_id AS object_id, min(CASE WHEN kind = 'images' THEN path END) AS images, min(CASE WHEN kind = 'geometry' THEN path END) AS geometry,
                 CASE WHEN min(CASE WHEN kind = 'images' THEN path END) IS NULL THEN 1 ELSE 0 END + CASE WHEN min(CASE WHEN kind = 'geometry' THEN path END) IS NULL THEN 1 ELSE 0 END AS n_missing
          FROM (SELECT src_image AS image_id, CASE split WHEN 'O' THEN 'images' WHEN 'F' THEN 'geometry' ELSE 'normals' END AS kind, 'root/obj' || src_image || '/' || CASE split WHEN 'O' THEN 'image' WHEN 'F' THEN 'geo' ELSE 'normals' END || '.npz' AS path FROM fx_pairs) t GROUP BY image_id""")
def q44c_object_manifest(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pairs")
    name = F.when(F.col("split") == "O", "image").when(F.col("split") == "F", "geo").otherwise("normals")
    got = D.manifest_of(p.select(F.concat(F.lit("root/obj"), F.col("src_image").cast("string"), F.lit("/"), name, F.lit(".npz")).alias("path")))
    return got.select("object_id", "images", "geometry", F.size("missing").alias("n_missing"))
