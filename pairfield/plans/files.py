"""Queries that write a layout to the shared folder and read it back with its reader, and those of operators over listings: Q45, Q46, Q48 to Q50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as functions
from ..operators import geometry as G
from ..operators import matching as X
from ..operators import metrics as M
from ..operators.profiling import curvature_stats
from ..sources import readers as D
from ..sources import schemas as S
from ..sources import writers as W
from ..sources.flo import read_flo, write_flo
from ..sources.shared import shared_path
from .evaluation import DISTANCE, PER_PAIR, _flows, _per_pair
from .fixtures import fixture
from .registry import ORACLE, query
from .surfaces import PAIRS, q13_view_overlap

PASCAL = """SELECT CAST(src_image AS VARCHAR) || '.jpg' AS src_image, CAST(trg_image AS VARCHAR) || '.jpg' AS trg_image,
                   CAST(pair_id % 20 AS INT) AS category_id, pair_id % 3 = 1 AS flip FROM fx_pairs"""


def _pascal_csv(spark, sf_dir, path: str, flips: bool) -> None:
    p = fixture(spark, sf_dir, "fx_pairs")
    names = [F.concat(F.lit("JPEGImages/"), F.col(f"{side}_image").cast("string"), F.lit(".jpg")).alias(c) for side, c in (("src", "source_image"), ("trg", "target_image"))]
    flip = [(F.col("pair_id") % 3 == 1).cast("int").alias("flip")] if flips else []
    p.select(*names, (F.col("pair_id") % 20 + 1).alias("class"), *flip).write.option("header", True).csv(path)


@query(PASCAL)
def q45c_pascal_pairs(spark, sf_dir):
    path = shared_path(spark, "pascal")
    _pascal_csv(spark, sf_dir, path, True)
    return D.read_pairs_pascal(spark, path, "trn")


@query("""SELECT 'pfpascal' AS benchmark, 'test' AS split, CAST(NULL AS VARCHAR) AS category, CAST(pair_id % 20 AS INT) AS category_id,
                 CAST(src_image AS VARCHAR) || '.jpg' AS src_image, CAST(trg_image AS VARCHAR) || '.jpg' AS trg_image, FALSE AS flip FROM fx_pairs""")
def q45d_benchmark_router(spark, sf_dir):
    root = shared_path(spark, "router")
    _pascal_csv(spark, sf_dir, f"{root}/test_pairs.csv", False)
    return D.load_benchmark(spark, "pfpascal", root, "tst").drop("pair_id")


def _annotations(spark, sf_dir):
    """name and the JSON of an annotation for each pair with keypoints."""
    kp = fixture(spark, sf_dir, "fx_kp").groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("kp_idx", F.array("src_x", "src_y").alias("s"), F.array("trg_x", "trg_y").alias("t")))).alias("k"))
    row = F.struct(
        F.col("k.s").alias("src_kps"), F.col("k.t").alias("trg_kps"), F.array(*[F.lit(v) for v in (0.0, 0.0, 511.0, 511.0)]).alias("src_bndbox"), F.array(*[F.lit(v) for v in (0.0, 0.0, 511.0, 511.0)]).alias("trg_bndbox"),
        F.array(*[F.lit(512)] * 3).alias("src_imsize"), F.array(*[F.lit(512)] * 3).alias("trg_imsize"), F.concat(F.lit("c"), (F.col("pair_id") % 18).cast("string")).alias("category"),
        (F.col("pair_id") % 3).cast("int").alias("viewpoint_variation"), F.lit(0).alias("scale_variation"), F.lit(0).alias("truncation"), F.lit(0).alias("occlusion"),
    )
    return kp.select("pair_id", F.concat(F.lit("pair-"), F.col("pair_id").cast("string")).alias("name"), F.to_json(row).alias("value"), row.alias("row"))


POINTS = "SELECT 'pair-' || pair_id AS name, kp_idx, src_x, src_y, trg_x, trg_y FROM fx_kp"


@query(POINTS)
def q46c_annotation_files(spark, sf_dir):
    files = _annotations(spark, sf_dir).select(F.concat(F.lit("/ann/test/"), "name", F.lit(".json")).alias("path"), "value")
    return D.annotation_points(D.annotation_files(files), ["name"])


@query(POINTS)
def q46d_annotation_maps(spark, sf_dir):
    """Objects of up to 64 pairs each."""
    texts = _annotations(spark, sf_dir).groupBy(F.floor(F.col("pair_id") / 64)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "row")))).alias("value"))
    return D.annotation_points(D.annotation_maps(texts), ["name"])


@query("""SELECT CASE split WHEN 'F' THEN 'trn' WHEN 'P' THEN 'val' ELSE 'test' END AS split, 'c' || (p.pair_id % 18) AS category, CAST(count(*) AS BIGINT) AS n_points, CAST(count(DISTINCT p.pair_id) AS BIGINT) AS n_pairs
          FROM fx_pairs p JOIN fx_kp k ON p.pair_id = k.pair_id GROUP BY 1, 2""")
def q46e_compacted_annotations(spark, sf_dir):
    path = shared_path(spark, "compacted")
    a = _annotations(spark, sf_dir)
    pairs = fixture(spark, sf_dir, "fx_pairs").select(F.concat(F.lit("pair-"), F.col("pair_id").cast("string")).alias("name"), F.when(F.col("split") == "F", "trn").when(F.col("split") == "P", "val").otherwise("test").alias("split"))
    D.compact(D.annotation_files(a.select(F.concat("name", F.lit(".json")).alias("path"), "value")), pairs, path, 4)
    back = spark.read.parquet(path)
    return back.groupBy("split", "category").agg(F.sum(F.size("src_kps")).alias("n_points"), F.count(F.lit(1)).alias("n_pairs"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS brand, p_name AS name FROM part")
def q46f_keyed_text(spark, sf_dir):
    path = shared_path(spark, "keyed")
    spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_brand", "p_name")).write.text(path)
    return D.read_keyed_text(spark, path, ["brand", "name"])


@query("SELECT CAST(pair_id AS INT) AS image, CAST(kp_idx AS INT) AS part_id, src_x AS x, src_y AS y, CAST(kp_idx % 2 AS INT) AS visible FROM fx_kp")
def q46g_part_locs(spark, sf_dir):
    path = shared_path(spark, "parts")
    fixture(spark, sf_dir, "fx_kp").select("pair_id", "kp_idx", "src_x", "src_y", F.col("kp_idx") % 2).write.option("sep", " ").csv(path)
    return D.read_part_locs(spark, path)


@query("""SELECT src_image AS list, CAST(k AS BIGINT) AS line_no, 'i' || src_image AS src_image, 'i' || trg_image || '_' || pair_id AS trg_image
          FROM (SELECT *, row_number() OVER (PARTITION BY src_image ORDER BY pair_id) - 1 AS k FROM fx_pairs) t WHERE k < 5""")
def q46h_pair_lists(spark, sf_dir):
    """One list for each source image, its first five lines."""
    p = fixture(spark, sf_dir, "fx_pairs")
    line = F.concat(F.lit("i"), F.col("src_image").cast("string"), F.lit(" i"), F.col("trg_image").cast("string"), F.lit("_"), F.col("pair_id").cast("string"))
    texts = p.groupBy(F.col("src_image").alias("list")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pair_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return D.pair_lines(texts, 5, ("list",))


@query("""SELECT split AS subset, CAST(pair_id AS VARCHAR) AS pair, pair_id % 2 = 1 AS flip, CAST(dense_rank() OVER (ORDER BY split) - 1 AS INT) AS label FROM fx_pairs""")
def q44d_tss_flags(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pairs")
    return D.tss_flags(p.select(F.concat_ws("/", F.lit("/tss"), "split", F.col("pair_id").cast("string"), F.lit("flip_gt.txt")).alias("path"), F.concat((F.col("pair_id") % 2).cast("string"), F.lit("\n")).alias("value")))


@query("""SELECT category AS obj, CAST(src_image AS VARCHAR) AS im1, CAST(trg_image AS VARCHAR) AS im2, CAST(h AS INT) AS h, CAST(w AS INT) AS w,
                 pair_id / 4.0E0 AS m0, 0.5E0 AS m2, CAST(src_image AS DOUBLE) AS m5, 1.0E0 AS m8 FROM fx_pairs""")
def q45e_homographies(spark, sf_dir):
    path = shared_path(spark, "homographies")
    values = [F.col("pair_id") / 4, F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(1.0), F.col("src_image"), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    fixture(spark, sf_dir, "fx_pairs").select(F.col("category").alias("obj"), "src_image", "trg_image", "h", "w", *[v.alias(f"h{i}") for i, v in enumerate(values)]).write.option("header", True).csv(path)
    return D.read_homographies(spark, path).select("obj", "im1", "im2", "h", "w", *[F.col("mat")[i].alias(f"m{i}") for i in (0, 2, 5, 8)])


@query("SELECT '/img/' || category || '/' || asset_id || CASE asset_id % 3 WHEN 0 THEN '.PNG' ELSE '.jpg' END AS path FROM fx_catalog WHERE asset_id % 3 <> 2")
def q44e_image_listing(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_catalog")
    suffix = F.element_at(F.array(F.lit(".PNG"), F.lit(".jpg"), F.lit(".txt")), (F.col("asset_id") % 3 + 1).cast("int"))
    return D.images_of(c.select(F.concat(F.lit("/img/"), "category", F.lit("/"), F.col("asset_id").cast("string"), suffix).alias("path")))


@query("""WITH s AS (SELECT pair_id, max(x) + 1 AS w, max(y) + 1 AS h FROM fx_flow GROUP BY pair_id),
          p AS (SELECT pair_id, w, unnest(range(w * h)) AS k FROM s)
          SELECT 'flow/' || p.pair_id || '.flo' AS path, k // w AS y, k % w AS x, dx, dy FROM p LEFT JOIN fx_flow f ON f.pair_id = p.pair_id AND f.y = k // w AND f.x = k % w""")
def q40d_flow_files(spark, sf_dir):
    """All flows as .flo files in the shared folder, and read back; pixels that a flow lacks come back as invalid."""
    path = shared_path(spark, "flo")
    name = F.concat(F.lit("flow/"), F.col("pair_id").cast("string"), F.lit(".flo")).alias("path")
    write_flo(fixture(spark, sf_dir, "fx_flow").select(name, "y", "x", "dx", "dy"), path)
    return read_flo(spark, path)


def _feature_sets(spark, sf_dir) -> str:
    path = shared_path(spark, "features")
    fixture(spark, sf_dir, "fx_features").select("pair_id", "pos", "vec", F.when(F.col("side") == 0, "src").otherwise("trg").alias("dataset_name")).write.partitionBy("dataset_name").parquet(path)
    return path


@query("""SELECT CASE side WHEN 0 THEN 'src' ELSE 'trg' END AS dataset_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(min(len(vec)) AS INT) AS dim FROM fx_features GROUP BY side""")
def q18f_feature_sets(spark, sf_dir):
    return D.read_feature_sets(spark, _feature_sets(spark, sf_dir))[1]


@query("""SELECT CASE side WHEN 0 THEN 'src' ELSE 'trg' END AS dataset_name, pair_id, pos, CAST(i - 1 AS INTEGER) AS dim, round(CAST(vec[i] AS DOUBLE), 6) AS v FROM fx_features, (SELECT unnest(range(1, 65)) AS i) r""")
def q18g_feature_set_rows(spark, sf_dir):
    """SRC-21: every number of every row."""
    rows = D.read_feature_sets(spark, _feature_sets(spark, sf_dir))[0]
    return rows.select("dataset_name", "pair_id", "pos", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query()
def q13b_written_overlaps(spark, sf_dir):
    path = shared_path(spark, "overlaps")
    W.write_overlaps(q13_view_overlap(spark, sf_dir), path)
    return spark.read.parquet(path)


ORACLE["q13b_written_overlaps"] = ORACLE["q13_view_overlap"]


@query("""SELECT 'image' AS kind, l_suppkey AS object_id, CAST(l_linenumber AS BIGINT) AS image_id, round(avg(l_quantity), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber
          UNION ALL SELECT 'object', object_id, CAST(0 AS BIGINT), round(avg(m), 6), CAST(count(*) AS BIGINT) FROM (SELECT l_suppkey AS object_id, avg(l_quantity) AS m FROM lineitem GROUP BY l_suppkey, l_linenumber) t GROUP BY object_id""")
def q19c_written_curvature(spark, sf_dir):
    path = shared_path(spark, "curvature")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    W.write_curvature(items.select(F.col("l_suppkey").alias("object_id"), F.col("l_linenumber").cast("long").alias("image_id"), F.col("l_quantity").alias("mean_curv")), path)
    images, objects = spark.read.parquet(f"{path}/images"), spark.read.parquet(f"{path}/objects")
    objects = objects.join(images.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_images")), "object_id")
    one = images.select(F.lit("image").alias("kind"), "object_id", "image_id", F.round("mean", 6).alias("mean"), "n")
    return one.unionByName(objects.select(F.lit("object").alias("kind"), "object_id", F.lit(0).cast("long").alias("image_id"), F.round("mean", 6).alias("mean"), F.col("n_images").alias("n")))


@query("""SELECT category, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM fx_catalog WHERE category IS NOT NULL) AS BIGINT) AS total,
                 CAST((SELECT count(DISTINCT category) FROM fx_catalog) AS BIGINT) AS n_categories FROM fx_catalog WHERE category IS NOT NULL GROUP BY category""")
def q18g_written_summary(spark, sf_dir):
    path = shared_path(spark, "summary")
    W.write_summary(fixture(spark, sf_dir, "fx_catalog"), path)
    back = spark.read.schema("total bigint, n_categories bigint, counts map<string, bigint>").json(path)
    return back.select("total", "n_categories", F.explode("counts").alias("category", "n"))


@query("""SELECT pair_id, round(avg(sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy))), 6) AS epe FROM fx_flow WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY pair_id""")
def q07c_written_errors(spark, sf_dir):
    path = shared_path(spark, "errors")
    W.write_image_errors(M.endpoint_error(*_flows(spark, sf_dir), None), path)
    return spark.read.parquet(path).withColumn("epe", F.round("epe", 6))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id, image1, image2, y2, x2 ORDER BY d2, y1, x1) AS k FROM n WHERE image1 < image2)
           SELECT object_id, image1 || '-' || image2 AS pair, y2, x2, y1, x1 FROM r WHERE k = 1""")
def q12c_written_matches(spark, sf_dir):
    path = shared_path(spark, "matches")
    for _ in range(2):  # the second write leaves what is there
        W.write_matches(X.pairwise_matches(fixture(spark, sf_dir, "fx_surface")), path)
    return spark.read.parquet(path).select(F.col("object_id").cast("long").alias("object_id"), "pair", "y2", "x2", "y1", "x1")


@query("SELECT CAST(asset_id AS VARCHAR) AS asset_id, category AS kind, '1k' AS resolution, 'jpg' AS format, '/assets/' || name AS path FROM fx_catalog")
def q27e_written_catalog(spark, sf_dir):
    path = shared_path(spark, "catalog")
    c = fixture(spark, sf_dir, "fx_catalog")
    W.write_catalog(c.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("category").alias("kind"), F.lit("1k").alias("resolution"), F.lit("jpg").alias("format"), F.concat(F.lit("/assets/"), "name").alias("path")), path)
    return W.read_chosen(spark, path)


@query(f"SELECT round(avg(pck_pct), 6) AS pck_pct, CAST(count(*) AS BIGINT) AS n_pairs FROM ({PER_PAIR}) t")
def q01d_pck_of_dataset(spark, sf_dir):
    return M.pck_mean(_per_pair(spark, sf_dir)).withColumn("pck_pct", F.round("pck_pct", 6))


@query("""WITH e AS (SELECT pair_id, 100 * avg(CASE WHEN sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy)) <= 0.1 * 16 THEN 1.0E0 ELSE 0.0E0 END) AS pck FROM fx_flow WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY pair_id)
          SELECT p.split AS subset, round(avg(e.pck), 6) AS pck_pct FROM fx_pairs p JOIN (SELECT DISTINCT pair_id FROM fx_flow) f ON p.pair_id = f.pair_id LEFT JOIN e ON e.pair_id = f.pair_id GROUP BY p.split""")
def q07d_dense_pck_by_class(spark, sf_dir):
    labels = fixture(spark, sf_dir, "fx_pairs").select("pair_id", F.col("split").alias("subset"))
    return M.dense_pck_by_class(M.dense_pck(*_flows(spark, sf_dir), 0.1, 16), labels, "subset").withColumn("pck_pct", F.round("pck_pct", 6))


@query("SELECT asset_id, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS BIGINT) AS category_id FROM fx_catalog")
def q48_category_index(spark, sf_dir):
    return G.category_index(fixture(spark, sf_dir, "fx_catalog").select("asset_id", "category"))


@query("""WITH i AS (SELECT DISTINCT object_id, image_id FROM fx_surface)
          SELECT a.object_id, a.image_id AS image1, b.image_id AS image2 FROM i a JOIN i b ON a.object_id = b.object_id AND a.image_id < b.image_id""")
def q48b_image_pairs(spark, sf_dir):
    return X.image_pairs(fixture(spark, sf_dir, "fx_surface").select("object_id", "image_id").distinct())


@query("SELECT pair_id, y - 4 AS y, x - 3 AS x, dx, dy FROM fx_flow WHERE y BETWEEN 4 AND 11 AND x BETWEEN 3 AND 12")
def q48c_crop_pixels(spark, sf_dir):
    return G.crop_pixels(fixture(spark, sf_dir, "fx_flow").select("pair_id", "y", "x", "dx", "dy"), 4, 3, 8, 10)


@query(f"""SELECT pair_id, kp_idx, round(2 * src_x / 511 - 1, 9) AS nx, round(src_x, 9) AS back, round(src_y / 2, 9) AS half, greatest(0, least(1, src_x / 255)) AS clipped, round({DISTANCE}, 6) AS distance FROM fx_kp""")
def q49_sql_functions(spark, sf_dir):
    """UDF-4: scalar geometry in SQL."""
    functions.register(spark)
    return spark.sql(
        """SELECT pair_id, kp_idx, round(normalize_coord(src_x, 512), 9) AS nx, round(unnormalize_coord(normalize_coord(src_x, 512), 512), 9) AS back, round(rescale_coord(src_y, 512, 256), 9) AS half,
                  clip_rescale(src_x, 0, 255) AS clipped, round(point_distance(pred_x, pred_y, src_x, src_y), 6) AS distance FROM {kp}""",
        kp=fixture(spark, sf_dir, "fx_kp"),
    )


@query("""WITH p AS (SELECT pair_id, split, src_image, trg_image % 500 AS trg_image FROM fx_pairs),
          s AS (SELECT split, src_image AS a FROM p UNION ALL SELECT split, trg_image FROM p)
          SELECT split, a AS image, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY split, a""")
def q49b_transform_chain(spark, sf_dir):
    """UDF-2: a chain of transforms as one."""
    chain = functions.compose(lambda d: d.withColumn("trg_image", F.col("trg_image") % 500), G.make_bidirectional, lambda d: d.groupBy("split", F.col("src_image").alias("image")).agg(F.count(F.lit(1)).alias("n")))
    return chain(fixture(spark, sf_dir, "fx_pairs").select("pair_id", "split", "src_image", "trg_image"))
