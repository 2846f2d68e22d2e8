"""Queries of scalar functions: Q06, Q25, Q31."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import points as P
from ..operators.geometry import interpolate_config, next_run
from ..sources.readers import spair_lines
from .fixtures import fixture
from .registry import query


@query("""WITH p AS (SELECT object_id, image_id, y, x, cx * 14 AS h, cy * 14 AS s, cz * 40 AS v, cx - 0.03 AS ax, cy - 0.03 AS ay, cz - 0.01 AS az FROM fx_surface),
          c AS (SELECT *, floor(h * 6) % 6 AS i, h * 6 - floor(h * 6) AS f FROM p), d AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t, greatest(abs(ax), abs(ay), abs(az)) AS mx FROM c)
          SELECT object_id, image_id, y, x, round(CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END, 5) AS r, round(CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END, 5) AS b,
                 round(atan2(ay, ax) / pi(), 5) AS u, round(2 * asin(az / sqrt(ax * ax + ay * ay + az * az)) / pi(), 5) AS w,
                 round(CASE WHEN abs(ax) >= abs(ay) AND abs(ax) >= abs(az) THEN ay ELSE ax END / mx, 5) AS cu,
                 round(CASE WHEN abs(az) >= abs(ax) AND abs(az) >= abs(ay) AND NOT (abs(ax) >= abs(ay) AND abs(ax) >= abs(az)) THEN ay ELSE az END / mx, 5) AS cw FROM d""")
def q06_hsv_uv_sphere(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_surface")
    x, y, z = F.col("cx") - 0.03, F.col("cy") - 0.03, F.col("cz") - 0.01
    r, _, b = P.hsv_to_rgb(F.col("cx") * 14, F.col("cy") * 14, F.col("cz") * 40)
    u, w = P.uv_spherical(x, y, z)
    cu, cw = P.uv_cube(x, y, z)
    return s.select("object_id", "image_id", "y", "x", *[F.round(v, 5).alias(n) for n, v in (("r", r), ("b", b), ("u", u), ("w", w), ("cu", cu), ("cw", cw))])


@query("""WITH l AS (SELECT CAST(regexp_extract(line, '^([^-]+)-', 1) AS BIGINT) AS pair_id, regexp_extract(line, '^[^-]+-([^-]+)-', 1) AS src_image, regexp_extract(line, '^[^-]+-[^-]+-([^:]+):', 1) AS trg_image, regexp_extract(line, ':(.*)$', 1) AS category FROM fx_layout)
          SELECT pair_id, src_image, trg_image, category, 'img_' || lpad(src_image, CAST(greatest(length(src_image), 6) AS INTEGER), '0') AS padded, CAST(src_image AS BIGINT) + CAST(trg_image AS BIGINT) AS total, trg_image AS seg FROM l""")
def q25_parse_layout(spark, sf_dir):
    rows = spair_lines(fixture(spark, sf_dir, "fx_layout"), "line")
    ints = P.parse_ints(F.concat(F.lit("["), F.col("src_image"), F.lit(", "), F.col("trg_image"), F.lit("]")))
    seg = P.path_seg(F.concat_ws("/", F.lit("root"), F.col("src_image"), F.col("trg_image")), -1)
    return rows.select("pair_id", "src_image", "trg_image", "category", P.pad_suffix(F.concat(F.lit("img_"), F.col("src_image")), 6).alias("padded"), F.aggregate(ints, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), seg.alias("seg"))


@query("""SELECT pair_id, CAST(string_agg(CAST(kp_idx AS VARCHAR), ',' ORDER BY kp_idx) AS VARCHAR) AS text, round(sum(src_x), 3) AS total FROM fx_kp GROUP BY pair_id""")
def q25b_points_as_text(spark, sf_dir):
    kp = fixture(spark, sf_dir, "fx_kp")
    listed = kp.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("kp_idx", "src_x"))).alias("p"))
    text = P.points_to_string(F.transform("p", lambda s: s["kp_idx"]))
    back = P.string_to_points(P.points_to_string(F.transform("p", lambda s: s["src_x"])))
    return listed.select("pair_id", text.alias("text"), F.round(F.aggregate(back, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("""SELECT CAST(coalesce(max(pair_id) + 1, 0) AS BIGINT) AS next_run FROM fx_pairs""")
def q25c_next_run(spark, sf_dir):
    return next_run(fixture(spark, sf_dir, "fx_pairs").select(F.concat(F.lit("logs/run-"), F.col("pair_id"), F.lit("/events")).alias("path")))


@query("""WITH s AS (SELECT event_id, event_id * 1.0E0 AS e, least(1, event_id / 5000.0E0) AS x FROM events)
          SELECT event_id, round(x, 6) AS lin, round(x * x, 6) AS poly, round((exp(2 * x) - 1) / (exp(2.0E0) - 1), 6) AS ex, round(sin(x * pi() / 2), 6) AS sn, round((1 - x) * 3 + x * 11, 6) AS mixed, round((1 - x) * 0.5 + x * 0.25, 6) AS lr,
                 round(CASE WHEN e < 1000 THEN 0.3 WHEN e >= 5000 THEN 0.9 ELSE 0.3 + 0.6 * (e - 1000) / 4000 END, 6) AS remember, round(least(0.4, 0.1 * pow(1.5, floor(e / 1000))), 6) AS warp, round(e / 256 * 2 * 4, 6) AS scaled FROM s""")
def q31_schedules(spark, sf_dir):
    e = F.col("event_id").cast("double")
    x = P.schedule(e, 5000)
    config = interpolate_config({"size": 3, "lr": 0.5, "name": "a"}, {"size": 11, "lr": 0.25, "name": "b"}, x)
    cols = {"lin": x, "poly": P.schedule(e, 5000, "poly"), "ex": P.schedule(e, 5000, "exp"), "sn": P.schedule(e, 5000, "sin"), "mixed": config["size"], "lr": config["lr"], "remember": P.remember_rate(e, 1000, 4000, 0.3), "warp": P.warp_strength(e, 0.1, 1.5, 1000, 0.4), "scaled": P.linear_scale(e, 256, 2, 4)}
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *[F.round(v, 6).alias(n) for n, v in cols.items()])


@query("""SELECT pair_id, kp_idx, src_x / 2 AS x1, src_y / 4 AS y1, CASE WHEN kp_idx % 2 = 0 THEN 256 - (src_x + 40) / 2 ELSE src_x / 2 END AS bx1, CASE WHEN kp_idx % 2 = 0 THEN 256 - src_x / 2 ELSE (src_x + 40) / 2 END AS bx2, (src_y + 30) / 4 AS by2 FROM fx_kp""")
def q02c_boxes(spark, sf_dir):
    """PRJ-3, PRJ-4: boxes given by corner and size, rescaled and mirrored."""
    from ..operators.geometry import hflip, rescale_box

    kp = fixture(spark, sf_dir, "fx_kp").withColumn("box", P.xywh_to_xyxy(F.col("src_x"), F.col("src_y"), F.lit(40.0), F.lit(30.0)))
    kp = rescale_box(kp, "box", (512, 512), (256, 128)).withColumns({"x1": F.col("box.x1"), "y1": F.col("box.y1")})
    kp = hflip(kp, [], 256.0, F.col("kp_idx") % 2 == 0, ["box"])
    return kp.select("pair_id", "kp_idx", "x1", "y1", F.col("box.x1").alias("bx1"), F.col("box.x2").alias("bx2"), F.col("box.y2").alias("by2"))


@query("""SELECT pair_id, kp_idx, src_y - 100 AS y1, src_x - 50 AS x1, trg_y - 20 AS y2, trg_x - 30 AS x2 FROM fx_kp
          WHERE src_y - 100 >= 0 AND src_y - 100 < 299 AND src_x - 50 >= 0 AND src_x - 50 < 399 AND trg_y - 20 >= 0 AND trg_y - 20 < 399 AND trg_x - 30 >= 0 AND trg_x - 30 < 299""")
def q02d_crop_matches(spark, sf_dir):
    """FLT-8."""
    from ..operators.filters import crop_matches

    kp = fixture(spark, sf_dir, "fx_kp").select("pair_id", "kp_idx", F.col("src_y").alias("y1"), F.col("src_x").alias("x1"), F.col("trg_y").alias("y2"), F.col("trg_x").alias("x2"))
    return crop_matches(kp, (100, 50, 300, 400), (20, 30, 400, 300))
