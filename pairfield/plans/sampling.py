"""Queries of keyed sampling: Q02, Q22, Q23, Q24, Q41, Q42."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import keyed as K
from ..functions import points as P
from ..operators import filters as L
from ..operators import geometry as Y
from ..operators import grids as G
from ..operators import matching as X
from ..operators import sampling as S
from ..operators.tracking import assign_batches, number_objects, shuffle_order
from .fixtures import fixture
from .registry import query

SEED = 7


def U(stream: str, *keys: str) -> str:
    """The keyed uniform in DuckDB's SQL."""
    said = " || '|' || ".join([f"'{SEED}'", f"'{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5({said}), 1, 8)) AS BIGINT) / 4294967296.0E0)"


@query(f"""WITH b AS (SELECT pair_id, kp_idx, src_x, src_y, {U("crop", "pair_id")} < 0.6 AS take, {U("left", "pair_id")} AS ul, {U("top", "pair_id")} AS ut, {U("right", "pair_id")} AS ur, {U("bottom", "pair_id")} AS ub,
              min(src_x) OVER p AS x1, min(src_y) OVER p AS y1, max(src_x) OVER p + 1 AS x2, max(src_y) OVER p + 1 AS y2 FROM fx_kp WINDOW p AS (PARTITION BY pair_id)),
           c AS (SELECT *, CASE WHEN take THEN floor(x1 * ul) ELSE 0 END AS l, CASE WHEN take THEN floor(y1 * ut) ELSE 0 END AS t, CASE WHEN take THEN floor(x2 + (512 - x2) * ur) ELSE 512 END AS r, CASE WHEN take THEN floor(y2 + (512 - y2) * ub) ELSE 512 END AS o FROM b)
           SELECT pair_id, kp_idx, round(greatest(0, least(255, (src_x - l) * 256 / (r - l))), 6) AS x, round(greatest(0, least(255, (src_y - t) * 256 / (o - t))), 6) AS y FROM c""")
def q02_crop_points(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id")
    kp = fixture(spark, sf_dir, "fx_kp")
    box = F.struct(F.min("src_x").over(w).alias("x1"), F.min("src_y").over(w).alias("y1"), (F.max("src_x").over(w) + 1).alias("x2"), (F.max("src_y").over(w) + 1).alias("y2"))
    got = Y.crop_points(Y.crop_window(kp.withColumn("box", box), "box", (512, 512), 0.6, SEED, "pair_id"), "src_x", "src_y", 256)
    return got.select("pair_id", "kp_idx", F.round("src_x", 6).alias("x"), F.round("src_y", 6).alias("y"))


@query("""SELECT pair_id, kp_idx, CASE WHEN kp_idx % 2 = 0 THEN 256 - src_x / 2 ELSE src_x / 2 END AS src_x, src_y / 4 AS src_y, CAST(floor(trg_x * 255 / 511.0E0) AS BIGINT) AS trg_x, CAST(floor(trg_y * 127 / 511.0E0) AS BIGINT) AS trg_y,
          round(greatest(0, least(1, (pred_x - 100) / 300.0E0)), 6) AS share FROM fx_kp""")
def q02b_rescale_flip(spark, sf_dir):
    kp = L.valid_keypoints(fixture(spark, sf_dir, "fx_kp"))
    kp = Y.rescale_points(kp, [("src_x", "src_y")], (512, 512), (256, 128))
    kp = Y.rescale_points(kp, [("trg_x", "trg_y")], (512, 512), (256, 128), align_corners=True, as_int=True)
    kp = Y.hflip(kp, ["src_x"], 256.0, F.col("kp_idx") % 2 == 0)
    return kp.select("pair_id", "kp_idx", "src_x", "src_y", "trg_x", "trg_y", F.round(P.clip_rescale(F.col("pred_x"), 100, 400), 6).alias("share"))


@query(f"""WITH s AS (SELECT pair_id, CAST(s AS BIGINT) AS slot FROM fx_pairs, (SELECT unnest([0, 1, 2]) AS s) t),
           d AS (SELECT *, {U("src", "pair_id", "slot")} * 2 + 1 AS a, {U("trg", "pair_id", "slot")} * 2 + 1 AS b, CASE WHEN slot = 0 THEN {U("match0", "pair_id", "slot")} < 0.9 ELSE {U("match", "pair_id", "slot")} < 0.5 END AS k FROM s)
           SELECT pair_id, slot, round(a, 6) AS src_value, round(CASE WHEN k THEN a ELSE b END, 6) AS trg_value FROM d""")
def q22_matched_sampling(spark, sf_dir):
    got = S.sample_matched(fixture(spark, sf_dir, "fx_pairs").select("pair_id"), 3, {"name": "uniform", "lo": 1, "hi": 3}, 0.5, 0.9, "pair_id", SEED)
    return got.select("pair_id", "slot", F.round("src_value", 6).alias("src_value"), F.round("trg_value", 6).alias("trg_value"))


@query(f"""WITH i AS (SELECT object_id, CAST(n AS INTEGER) AS image_no FROM (SELECT DISTINCT object_id FROM fx_surface) o, (SELECT unnest(range(0, 5)) AS n) t),
           v AS (SELECT *, {U("az", "object_id", "image_no")} * 2 * pi() AS a, ({U("el", "object_id", "image_no")} - 0.5) * pi() AS e, 0.8 + 0.4 * {U("zoom", "object_id", "image_no")} AS zoom, {U("light/z", "object_id", "image_no")} AS lz, 0.1 + 0.3 * {U("ambient", "object_id", "image_no")} AS ambient FROM i)
           SELECT object_id, image_no, round(cos(e) * cos(a), 6) AS camera_x, round(cos(e) * sin(a), 6) AS camera_y, round(sin(e), 6) AS camera_z, round(zoom, 6) AS zoom, round(sin(e) - 0.3 + 0.6 * lz, 6) AS light_z, round(ambient, 6) AS ambient FROM v""")
def q22b_render_manifest(spark, sf_dir):
    got = S.build_render_manifest(fixture(spark, sf_dir, "fx_surface").select("object_id").distinct(), 5, SEED)
    return got.select("object_id", "image_no", *[F.round(c, 6).alias(c) for c in ("camera_x", "camera_y", "camera_z", "zoom", "light_z", "ambient")])


@query(f"""WITH d AS (SELECT *, {U("swap", "pair_id")} < 0.3 AS s, {U("flip", "pair_id")} < 0.5 AS f, {U("light/exponent", "pair_id")} AS e, {U("scale/a", "pair_id")} AS a, {U("scale/r", "pair_id")} AS r, {U("angle/az/centre", "pair_id")} AS c, {U("angle/az/1", "pair_id")} AS z FROM fx_pairs)
           SELECT pair_id, CASE WHEN s THEN trg_image ELSE src_image END AS src_image, CASE WHEN s THEN src_image ELSE trg_image END AS trg_image, f AS flip_trg, round(1 + 29 * e, 6) AS exponent, round(1 + a + (r - 0.5), 6) AS scale_b, round(0.2 + 0.6 * c + (0.2 * z - 0.1), 6) AS az1 FROM d""")
def q22c_augment_light_scale(spark, sf_dir):
    p = S.augment_pairs(fixture(spark, sf_dir, "fx_pairs"), 0.5, 0.3, "pair_id", SEED)
    p = S.sample_angles(S.sample_scales(S.sample_lighting(p, "pair_id", SEED), {"name": "uniform", "lo": 1, "hi": 2}, {"name": "uniform", "lo": -0.5, "hi": 0.5}, "pair_id", SEED), {"name": "uniform", "lo": -0.1, "hi": 0.1}, (0.2, 0.8), "pair_id", SEED)
    return p.select("pair_id", "src_image", "trg_image", "flip_trg", *[F.round(c, 6).alias(c) for c in ("exponent", "scale_b", "az1")])


@query(f"""WITH p AS (SELECT pair_id, CAST(n AS INTEGER) AS place FROM fx_pairs, (SELECT unnest(range(0, 21)) AS n) t),
           r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY {U("place", "pair_id", "place")}, place) - 1 AS slot FROM p)
           SELECT pair_id, slot, round((place * 0.1E0 - 1) * (1 + 0.5 * {U("place/scale", "pair_id")}), 6) AS "offset" FROM r WHERE slot < 4""")
def q22d_object_offsets(spark, sf_dir):
    return S.sample_offsets(fixture(spark, sf_dir, "fx_pairs").select("pair_id"), 4, "pair_id", SEED).withColumn("offset", F.round("offset", 6))


@query(f"""WITH g AS (SELECT asset_id AS cell_id, size * 1.0E0 AS score, exp(-((size - 25) / 8.0E0) * ((size - 25) / 8.0E0) / 2) AS w FROM fx_catalog),
           l AS (SELECT cell_id, score, sum(w) OVER (ORDER BY cell_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS hi FROM g), c AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY cell_id), 0) AS lo FROM l),
           d AS (SELECT pair_id, {U("grid", "pair_id")} AS u FROM fx_pairs)
           SELECT d.pair_id, c.cell_id, c.score FROM d JOIN c ON d.u >= c.lo AND d.u < c.hi""")
def q23_weighted_grid_sample(spark, sf_dir):
    cat = fixture(spark, sf_dir, "fx_catalog")
    grid = cat.select(F.col("asset_id").alias("cell_id"), F.col("size").cast("double").alias("score"), F.col("size").alias("x"), F.col("asset_type").alias("y"))
    got = S.sample_grid(grid, fixture(spark, sf_dir, "fx_pairs").select("pair_id"), {"name": "normal", "mean": 25, "std": 8}, "pair_id", SEED)
    return got.select("pair_id", "cell_id", "score")


@query(f"""WITH z AS (SELECT object_id, image_id, y, x, (cx - avg(cx) OVER (PARTITION BY object_id)) / (stddev_samp(cx) OVER (PARTITION BY object_id) + 1e-6) AS z FROM fx_surface)
           SELECT object_id, image_id, y, x, round(1 / (1 + exp(-(z * (0.5 + {U("std", "object_id")}) + (-0.2 + 0.4 * {U("mean", "object_id")})))), 5) AS cx FROM z""")
def q23b_respread(spark, sf_dir):
    got = G.respread(fixture(spark, sf_dir, "fx_surface"), ["object_id"], "cx", (-0.2, 0.2), (0.5, 1.5), SEED)
    return got.select("object_id", "image_id", "y", "x", F.round("cx", 5).alias("cx"))


@query(f"""SELECT pair_id, {U("split", "pair_id")} < 0.87 AS is_train, CAST(floor(src_image / 100.0) AS BIGINT) AS grp FROM fx_pairs""")
def q24_random_split(spark, sf_dir):
    return S.random_split(fixture(spark, sf_dir, "fx_pairs"), None, "pair_id", SEED, 0.87).select("pair_id", "is_train", F.floor(F.col("src_image") / 100).alias("grp"))


@query(f"""WITH u AS (SELECT pair_id, y, x, dx, dy, {U("sub", "pair_id", "y", "x")} AS u FROM fx_flow), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN dx IS NOT NULL THEN u END NULLS LAST, y, x) AS k FROM u)
           SELECT pair_id, y, x, CASE WHEN u < 0.2 OR k <= 10 THEN dx END AS dx, CASE WHEN u < 0.2 OR k <= 10 THEN dy END AS dy FROM r""")
def q24b_subsample_flow(spark, sf_dir):
    return S.subsample_flow(fixture(spark, sf_dir, "fx_flow").select("pair_id", "y", "x", "dx", "dy"), 0.2, SEED)


@query(f"""WITH e AS (SELECT DISTINCT CAST(floor(o_orderkey / 5000.0) AS BIGINT) AS epoch FROM orders), r AS (SELECT epoch, asset_id, row_number() OVER (PARTITION BY epoch ORDER BY {U("pool", "epoch", "asset_id")}, asset_id) AS rank FROM e, fx_catalog)
           SELECT epoch, asset_id, rank FROM r WHERE rank <= 50""")
def q24c_sample_pool(spark, sf_dir):
    calls = fixture(spark, sf_dir, "fx_pairs").select(F.col("pair_id").alias("call_no"))
    return S.sample_pool(calls, fixture(spark, sf_dir, "fx_catalog"), 50, 5000, SEED)


@query(f"""WITH m AS (SELECT pair_id, y, x, row_number() OVER (PARTITION BY pair_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n, {U("phase", "pair_id")} AS u FROM fx_flow WHERE dx IS NOT NULL),
           k AS (SELECT DISTINCT pair_id, least(round_even(u * (n / 32.0E0) + j * (n / 32.0E0), 0), n - 1) AS i FROM m, (SELECT unnest(range(0, 32)) AS j) t)
           SELECT m.pair_id, m.y AS y2, m.x AS x2 FROM m WHERE n <= 32 OR EXISTS (SELECT 1 FROM k WHERE k.pair_id = m.pair_id AND k.i = m.i)""")
def q24d_even_points(spark, sf_dir):
    f = L.valid_flow(fixture(spark, sf_dir, "fx_flow")).select("pair_id", F.col("y").alias("y2"), F.col("x").alias("x2"))
    return S.sample_points(f, 32, SEED)


@query(f"""WITH p AS (SELECT pair_id, category, row_number() OVER (PARTITION BY category ORDER BY {U("shuffle/3", "pair_id")}, pair_id) - 1 AS place FROM fx_pairs), b AS (SELECT *, CAST(floor(place / 64.0) AS BIGINT) AS batch FROM p), c AS (SELECT *, count(*) OVER (PARTITION BY category, batch) AS n FROM b)
           SELECT pair_id, category, place, batch FROM c WHERE n = 64""")
def q24e_shuffled_batches(spark, sf_dir):
    placed = shuffle_order(fixture(spark, sf_dir, "fx_pairs").select("pair_id", "category"), SEED, 3, "pair_id", ["category"])
    return assign_batches(placed, 64, ["place"], ["category"], drop_last=True)


@query(f"""WITH r AS (SELECT asset_id, row_number() OVER (ORDER BY asset_id) - 1 AS r, count(*) OVER () AS t FROM fx_catalog), p AS (SELECT CAST(n AS BIGINT) AS pick, CAST(floor({U("asset", "n")} * (SELECT count(*) FROM fx_catalog)) AS BIGINT) AS r FROM (SELECT unnest(range(0, 200)) AS n) t)
           SELECT p.pick, r.asset_id, row_number() OVER (ORDER BY p.pick) AS object_no FROM p JOIN r ON p.r = r.r""")
def q24f_sample_assets(spark, sf_dir):
    got = S.sample_assets(fixture(spark, sf_dir, "fx_catalog"), 200, True, SEED).select("pick", "asset_id")
    return number_objects(got, ["pick"])


@query(f"""WITH c AS (SELECT pair_id, {", ".join(f"{b[0]} - 0.2 + 0.4 * {U(f'corner/x{i}', 'pair_id')} AS x{i}, {b[1]} - 0.2 + 0.4 * {U(f'corner/y{i}', 'pair_id')} AS y{i}" for i, b in enumerate([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]))} FROM fx_pairs),
           d AS (SELECT *, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det FROM c),
           q AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / det AS g, ((x1 - x2) * sy - sx * (y1 - y2)) / det AS h FROM d)
           SELECT pair_id, round((x1 - x0 + g * x1) * 0.5, 6) AS m0, round((x3 - x0 + h * x3) * 0.5, 6) AS m1, round((x1 - x0 + g * x1) * 0.5 + (x3 - x0 + h * x3) * 0.5 + x0, 6) AS m2, round(g * 0.5 + h * 0.5 + 1, 6) AS m8 FROM q""")
def q41_homography_params(spark, sf_dir):
    got = S.sample_homography(fixture(spark, sf_dir, "fx_pairs").select("pair_id"), 0.2, "pair_id", SEED)
    return got.select("pair_id", *[F.round(F.col("mat")[k], 6).alias(f"m{k}") for k in (0, 1, 2, 8)])


@query(f"""WITH p AS (SELECT pair_id, 0.9 + 0.2 * {U("scale", "pair_id")} AS s, -0.2 + 0.4 * {U("angle", "pair_id")} AS a, -0.1 + 0.2 * {U("shear", "pair_id")} AS h, -0.1 + 0.2 * {U("tx", "pair_id")} AS tx, -0.1 + 0.2 * {U("ty", "pair_id")} AS ty FROM fx_pairs)
           SELECT k.pair_id, k.kp_idx, round(s * cos(a) * (2 * src_x / 511 - 1) - s * sin(a + h) * (2 * src_y / 511 - 1) + tx, 6) AS wx, round(s * sin(a) * (2 * src_x / 511 - 1) + s * cos(a + h) * (2 * src_y / 511 - 1) + ty, 6) AS wy FROM fx_kp k JOIN p ON k.pair_id = p.pair_id""")
def q41b_affine_warp(spark, sf_dir):
    mats = S.sample_affine(fixture(spark, sf_dir, "fx_pairs").select("pair_id"), 0.2, (0.9, 1.1), 0.1, 0.1, "pair_id", SEED)
    kp = fixture(spark, sf_dir, "fx_kp").withColumns({"x": P.normalize(F.col("src_x"), 512), "y": P.normalize(F.col("src_y"), 512)})
    got = Y.warp_points(kp.join(mats, "pair_id"), "mat")
    return got.select("pair_id", "kp_idx", F.round("wx", 6).alias("wx"), F.round("wy", 6).alias("wy"))


@query(f"""WITH p AS (SELECT object_id, 8 * {U("mask/x", "object_id")} AS mx, 8 * {U("mask/y", "object_id")} AS my FROM (SELECT DISTINCT object_id FROM fx_surface) t)
           SELECT object_id, y, x, round(least(1, 2 * exp(-((x - mx) * (x - mx) + (y - my) * (y - my)) / 18)), 6) AS mask FROM p, (SELECT unnest(range(0, 8)) AS y) a, (SELECT unnest(range(0, 8)) AS x) b""")
def q41c_location_masks(spark, sf_dir):
    got = S.location_masks(fixture(spark, sf_dir, "fx_surface").select("object_id").distinct(), 8, 8, 3.0, "object_id", SEED)
    return got.select("object_id", "y", "x", F.round("mask", 6).alias("mask"))


@query(f"""WITH c AS (SELECT pair_id, {", ".join(f"{b[0]} - 0.2 + 0.4 * {U(f'corner/x{i}', 'pair_id')} AS x{i}, {b[1]} - 0.2 + 0.4 * {U(f'corner/y{i}', 'pair_id')} AS y{i}" for i, b in enumerate([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]))},
              0.9 + 0.2 * {U("scale", "pair_id")} AS s, -0.2 + 0.4 * {U("angle", "pair_id")} AS a, -0.1 + 0.2 * {U("shear", "pair_id")} AS r, -0.1 + 0.2 * {U("tx", "pair_id")} AS tx, -0.1 + 0.2 * {U("ty", "pair_id")} AS ty FROM fx_pairs),
           d AS (SELECT *, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det FROM c),
           q AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / det AS g, ((x1 - x2) * sy - sx * (y1 - y2)) / det AS h FROM d),
           p AS (SELECT q.*, CAST(v AS BIGINT) AS y, CAST(u AS BIGINT) AS x, (2 * (u + 8) / 15.0E0) / 2 AS px, (2 * (v + 4) / 15.0E0) / 2 AS py FROM q, (SELECT unnest(range(0, 8)) AS v) e, (SELECT unnest(range(0, 8)) AS u) f),
           w AS (SELECT *, ((x1 - x0 + g * x1) * px + (x3 - x0 + h * x3) * py + x0) / (g * px + h * py + 1) AS hx, ((y1 - y0 + g * y1) * px + (y3 - y0 + h * y3) * py + y0) / (g * px + h * py + 1) AS hy FROM p),
           n AS (SELECT *, s * cos(a) * hx - s * sin(a + r) * hy + tx AS nx, s * sin(a) * hx + s * cos(a + r) * hy + ty AS ny FROM w)
           SELECT pair_id, y, x, CASE WHEN nx BETWEEN -1 AND 1 AND ny BETWEEN -1 AND 1 THEN round((nx + 1) * 7.5 - (x + 8), 6) END AS dx, CASE WHEN nx BETWEEN -1 AND 1 AND ny BETWEEN -1 AND 1 THEN round((ny + 1) * 7.5 - (y + 4), 6) END AS dy FROM n""")
def q41d_warp_pairs(spark, sf_dir):
    ids = fixture(spark, sf_dir, "fx_pairs").select("pair_id")
    got = Y.crop_pixels(S.warp_pairs(ids, 16, 16, "pair_id", SEED), 4, 8, 8, 8)
    return got.select("pair_id", "y", "x", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("""WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS warp_id, n_nationkey * 20.0E0 AS cx, n_regionkey * 100.0E0 AS cy, 1e-6 * n_nationkey AS kx, -1e-6 * n_regionkey AS ky FROM nation),
          k AS (SELECT pair_id, kp_idx, src_x AS x, src_y AS y, CAST(pair_id % 5 AS INTEGER) AS warp_id FROM fx_kp),
          d AS (SELECT k.*, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2, kx, ky FROM k JOIN c ON k.warp_id = c.warp_id)
          SELECT pair_id, kp_idx, round(1 + 0.9E0 * x + 0.1E0 * y + sum(kx * CASE WHEN d2 = 0 THEN 0 ELSE d2 * ln(d2) END), 4) AS wx, round(2 - 0.1E0 * x + 1.1E0 * y + sum(ky * CASE WHEN d2 = 0 THEN 0 ELSE d2 * ln(d2) END), 4) AS wy FROM d GROUP BY pair_id, kp_idx, x, y""")
def q41e_warp_tps(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    affine = {"a0x": 1.0, "ax": 0.9, "bx": 0.1, "a0y": 2.0, "ay": -0.1, "by": 1.1}
    centers = n.select(F.col("n_regionkey").alias("warp_id"), (F.col("n_nationkey") * 20.0).alias("cx"), (F.col("n_regionkey") * 100.0).alias("cy"), (F.col("n_nationkey") * 1e-6).alias("kx"), (F.col("n_regionkey") * -1e-6).alias("ky"), *[F.lit(v).alias(c) for c, v in affine.items()])
    points = fixture(spark, sf_dir, "fx_kp").select((F.col("pair_id") % 5).cast("int").alias("warp_id"), "pair_id", "kp_idx", F.col("src_x").alias("x"), F.col("src_y").alias("y"))
    return Y.warp_tps(points, centers, ["pair_id", "kp_idx"]).select("pair_id", "kp_idx", F.round("wx", 4).alias("wx"), F.round("wy", 4).alias("wy"))


@query(f"""SELECT asset_id, round(1 + 2 * {U("u", "asset_id")}, 6) AS u, round(3 + 2 * sqrt(-2 * ln(1 - {U("n/a", "asset_id")})) * cos(2 * pi() * {U("n/b", "asset_id")}), 6) AS n, round(-1.5 * ln(1 - {U("e", "asset_id")}), 6) AS e,
           round(CASE WHEN {U("t", "asset_id")} < 0.25 THEN sqrt({U("t", "asset_id")} * 4) ELSE 4 - sqrt((1 - {U("t", "asset_id")}) * 12) END, 6) AS t,
           round(CASE WHEN {U("mix/pick", "asset_id")} < 0.25 THEN {U("mix/0", "asset_id")} ELSE 5 + {U("mix/1", "asset_id")} END, 6) AS m, round(2 + {U("power", "asset_id")}, 6) AS power FROM fx_catalog""")
def q42_distributions(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_catalog").select("asset_id")
    specs = {"u": {"name": "uniform", "lo": 1, "hi": 3}, "n": {"name": "norm", "mean": 3, "std": 2}, "e": {"name": "expon", "scale": 1.5}, "t": {"name": "triang", "lo": 0, "mode": 1, "hi": 4}}
    for name, spec in specs.items():
        c = S.sample_distribution(c, spec, "asset_id", SEED, name, name)
    c = S.sample_distribution(c, [{"name": "uniform", "weight": 1}, {"name": "uniform", "lo": 5, "hi": 6, "weight": 3}], "asset_id", SEED, "m", "mix")
    c = S.sample_power(c, 2, 1, "asset_id", SEED)
    return c.select("asset_id", *[F.round(k, 6).alias(k) for k in ("u", "n", "e", "t", "m", "power")])


@query(f"""WITH f AS (SELECT asset_id, size + 3 AS n, CAST(floor({U("frame", "asset_id")} * (size + 3)) AS BIGINT) AS s FROM fx_catalog) SELECT asset_id, array_to_string(list_transform(range(0, 5), lambda i: (s + i) % n), ',') AS frames FROM f""")
def q42b_frames(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_catalog").select("asset_id", (F.col("size") + 3).alias("length"))
    return S.sample_frames(c, 5, "asset_id", SEED).select("asset_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query(f"""WITH h AS (SELECT asset_id, {U("hue", "asset_id")} AS h, 0.5 + 0.5 * {U("sat", "asset_id")} AS s, 0.5 + 0.5 * {U("val", "asset_id")} AS v FROM fx_catalog), i AS (SELECT *, floor(h * 6) % 6 AS i, h * 6 - floor(h * 6) AS f FROM h),
           c AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM i)
           SELECT asset_id, round(CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END, 6) AS r, round(CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END, 6) AS g, round(CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END, 6) AS b FROM c""")
def q42c_colors(spark, sf_dir):
    got = S.sample_colors(fixture(spark, sf_dir, "fx_catalog").select("asset_id"), "asset_id", SEED)
    return got.select("asset_id", *[F.round(c, 6).alias(c) for c in "rgb"])


@query(f"""WITH n AS (SELECT asset_id, {", ".join(f"sqrt(-2 * ln(1 - {U(f'quat/{i}/a', 'asset_id')})) * cos(2 * pi() * {U(f'quat/{i}/b', 'asset_id')}) AS n{i}" for i in range(4))}, list_sort([{", ".join(U(f"quat/r/{i}", "asset_id") for i in range(15))}])[12] AS r FROM fx_catalog),
           s AS (SELECT *, r / sqrt(n0 * n0 + n1 * n1 + n2 * n2 + n3 * n3) AS s FROM n)
           SELECT asset_id, {", ".join(f"round(n{i} * s, 6) AS q{i}" for i in range(4))} FROM s""")
def q42d_quaternions(spark, sf_dir):
    """The beta radius is the twelfth of fifteen draws."""
    got = S.sample_quaternions(fixture(spark, sf_dir, "fx_catalog").select("asset_id"), "asset_id", SEED)
    return got.select("asset_id", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(4)])


@query(f"""WITH r AS (SELECT asset_id, category, row_number() OVER (PARTITION BY category ORDER BY asset_id) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM fx_catalog),
           w AS (SELECT *, (r + CASE WHEN {U("match", "asset_id")} < 0.4 OR n < 2 THEN 0 ELSE 1 + CAST(floor({U("other", "asset_id")} * (n - 1)) AS BIGINT) END) % n AS want FROM r)
           SELECT w.asset_id, r.asset_id AS match_id FROM w JOIN r ON w.category = r.category AND w.want = r.r""")
def q27b_assign_match(spark, sf_dir):
    return X.assign_match(fixture(spark, sf_dir, "fx_catalog"), "asset_id", "category", 0.4, SEED).select("asset_id", "match_id")


@query("""SELECT pair_id, CAST(src_image AS BIGINT) AS size, (trg_image % 100) / 100.0E0 AS hit_rate, CAST(src_image + CASE WHEN (trg_image % 100) / 100.0E0 > 0.8 THEN -5 WHEN (trg_image % 100) / 100.0E0 < 0.5 THEN 5 ELSE 0 END AS BIGINT) AS next_size FROM fx_pairs""")
def q24g_adapt_pool(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pairs").select("pair_id", F.col("src_image").alias("size"), ((F.col("trg_image") % 100) / 100.0).alias("hit_rate"))
    return S.adapt_pool(p)
