"""Queries of point and flow accuracy: Q01, Q03, Q04, Q07, Q08, Q21, Q28, Q29, Q36, Q47."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.geometry import pack_keypoints, pck_threshold, unpack_keypoints
from .fixtures import fixture
from .registry import query

DISTANCE = "sqrt((pred_x - src_x) * (pred_x - src_x) + (pred_y - src_y) * (pred_y - src_y))"
PER_PAIR = f"""
    SELECT p.pair_id, p.category, p.split, coalesce(c.n_ok, 0) * 100.0 / greatest(coalesce(c.n_pts, 0), 1) AS pck_pct
    FROM fx_pairs p LEFT JOIN (SELECT pair_id, count(*) AS n_pts, sum(CASE WHEN {DISTANCE} <= 0.1 * 512 THEN 1 ELSE 0 END) AS n_ok FROM fx_kp GROUP BY pair_id) c ON p.pair_id = c.pair_id"""


def _flows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = fixture(spark, sf_dir, "fx_flow")
    return f.select("pair_id", "y", "x", F.col("pdx").alias("dx"), F.col("pdy").alias("dy")), f.select("pair_id", "y", "x", "dx", "dy")


def _per_pair(spark, sf_dir, alpha: float = 0.1) -> DataFrame:
    return M.pck_per_pair(fixture(spark, sf_dir, "fx_kp"), pck_threshold(fixture(spark, sf_dir, "fx_pairs")), alpha)


@query(f"SELECT category, round(avg(pck_pct), 6) AS pck_pct, CAST(count(*) AS BIGINT) AS n_pairs FROM ({PER_PAIR}) t GROUP BY category")
def q01_pck_by_category(spark, sf_dir):
    return M.pck_by(_per_pair(spark, sf_dir), ["category"]).withColumn("pck_pct", F.round("pck_pct", 6))


@query(f"""SELECT category, split, round(avg(pck_pct), 6) AS pck_pct, CAST(count(*) AS BIGINT) AS n_pairs
           FROM ({PER_PAIR}) t GROUP BY GROUPING SETS ((category, split), (split), ())""")
def q01b_pck_grouping_sets(spark, sf_dir):
    return M.pck_by(_per_pair(spark, sf_dir), ["category", "split"], [["category", "split"], ["split"], []]).withColumn("pck_pct", F.round("pck_pct", 6))


@query("SELECT pair_id, kp_idx, src_x AS x, src_y AS y, least(n, 40) AS n_pts FROM (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n FROM fx_kp) t WHERE kp_idx < 40")
def q03_pack_unpack(spark, sf_dir):
    packed = pack_keypoints(fixture(spark, sf_dir, "fx_kp"), 40)
    return unpack_keypoints(packed).join(packed.select("pair_id", "n_pts"), "pair_id")


@query(f"""WITH r AS (SELECT pair_id, greatest(max(src_x) - min(src_x), max(src_y) - min(src_y)) AS thr FROM fx_kp GROUP BY pair_id),
           c AS (SELECT k.pair_id, sum(CASE WHEN {DISTANCE} <= 0.1 * r.thr THEN 1 ELSE 0 END) * 100.0 / greatest(count(*), 1) AS pct FROM fx_kp k JOIN r ON k.pair_id = r.pair_id GROUP BY k.pair_id)
           SELECT p.split, round(avg(coalesce(c.pct, 0)), 6) AS pck_pct, round(avg(r.thr), 6) AS mean_thr
           FROM fx_pairs p LEFT JOIN c ON p.pair_id = c.pair_id LEFT JOIN r ON p.pair_id = r.pair_id GROUP BY p.split""")
def q04_threshold_modes(spark, sf_dir):
    kp = fixture(spark, sf_dir, "fx_kp")
    got = M.pck_per_pair(kp, pck_threshold(fixture(spark, sf_dir, "fx_pairs"), kp, "bbox-kp"), 0.1)
    return got.groupBy("split").agg(F.round(F.avg("pck_pct"), 6).alias("pck_pct"), F.round(F.avg("thr"), 6).alias("mean_thr"))


@query("""WITH e AS (SELECT pair_id, sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy)) AS err FROM fx_flow WHERE dx IS NOT NULL AND dy IS NOT NULL)
          SELECT f.pair_id, round(e2.pck, 6) AS pck_pct, round(e2.epe, 6) AS epe
          FROM (SELECT DISTINCT pair_id FROM fx_flow) f LEFT JOIN
               (SELECT pair_id, 100 * avg(CASE WHEN err <= 0.1 * 16 THEN 1.0E0 ELSE 0.0E0 END) AS pck, avg(err) AS epe FROM e GROUP BY pair_id) e2 ON f.pair_id = e2.pair_id""")
def q07_dense_pck_epe(spark, sf_dir):
    pred, target = _flows(spark, sf_dir)
    per = M.endpoint_error(pred, target, None)
    return M.dense_pck(pred, target, 0.1, 16).join(per, "pair_id", "left").select("pair_id", F.round("pck_pct", 6).alias("pck_pct"), F.round("epe", 6).alias("epe"))


@query("""WITH e AS (SELECT sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy)) AS err FROM fx_flow WHERE dx IS NOT NULL AND dy IS NOT NULL)
          SELECT 'mean' AS reduction, round(avg(err), 6) AS epe, CAST(count(*) AS BIGINT) AS n_valid FROM e
          UNION ALL SELECT 'sum', round(sum(err), 4), CAST(count(*) AS BIGINT) FROM e
          UNION ALL SELECT 'batch_sum', round(sum(err) / count(*), 6), CAST(count(*) AS BIGINT) FROM e
          UNION ALL SELECT 'pixel_pck', round(avg(CASE WHEN err <= 1 THEN 1.0E0 ELSE 0.0E0 END), 6), CAST(count(*) AS BIGINT) FROM e""")
def q07b_epe_reductions(spark, sf_dir):
    pred, target = _flows(spark, sf_dir)
    rows = [M.endpoint_error(pred, target, r).select(F.lit(r).alias("reduction"), F.round("epe", 4 if r == "sum" else 6).alias("epe"), "n_valid") for r in ("mean", "sum", "batch_sum")]
    pck = M.pixel_pck(pred, target).select(F.lit("pixel_pck").alias("reduction"), F.round("pck_frac", 6).alias("epe"), "n_valid")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(pck)


@query("""WITH e AS (SELECT sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy)) AS err, sqrt(dx * dx + dy * dy) AS mag FROM fx_flow WHERE dx IS NOT NULL AND dy IS NOT NULL)
          SELECT round(100 * avg(CASE WHEN err > 3 AND (mag = 0 OR err / mag > 0.05) THEN 1.0E0 ELSE 0.0E0 END), 6) AS f1_pct, CAST(count(*) AS BIGINT) AS n_valid FROM e""")
def q08_kitti_outliers(spark, sf_dir):
    return M.kitti_f1(*_flows(spark, sf_dir)).withColumn("f1_pct", F.round("f1_pct", 6))


@query(f"""WITH pp AS (SELECT split AS benchmark, pck_pct FROM ({PER_PAIR}) t),
           b AS (SELECT split AS benchmark, floor((row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1) / 32.0) AS batch, src_image * 1.0E0 AS loss FROM fx_pairs),
           l AS (SELECT benchmark, avg(loss) AS loss FROM (SELECT benchmark, batch, avg(loss) AS loss FROM b GROUP BY benchmark, batch) t GROUP BY benchmark),
           r AS (SELECT p.benchmark, CASE p.benchmark WHEN 'O' THEN 0.1E0 WHEN 'F' THEN 0.05E0 ELSE 0.15E0 END AS alpha, avg(p.pck_pct) AS pck_pct, any_value(l.loss) AS loss FROM pp p JOIN l ON p.benchmark = l.benchmark GROUP BY p.benchmark)
           SELECT benchmark, round(alpha, 6) AS alpha, round(pck_pct, 6) AS pck_pct, round(loss, 6) AS loss FROM r
           UNION ALL SELECT 'average', round(avg(alpha), 6), round(avg(pck_pct), 6), round(avg(loss), 6) FROM r""")
def q21_multi_benchmark(spark, sf_dir):
    from ..operators.tracking import assign_batches

    pairs = fixture(spark, sf_dir, "fx_pairs").withColumn("benchmark", F.col("split"))
    batches = assign_batches(pairs, 32, ["pair_id"], by=["benchmark"]).select("benchmark", "batch", F.col("src_image").cast("double").alias("loss"))
    per = _per_pair(spark, sf_dir).select(F.col("split").alias("benchmark"), "pck_pct")
    got = M.multi_benchmark(per, batches, {"O": 0.1, "F": 0.05, "P": 0.15})
    return got.select("benchmark", *[F.round(c, 6).alias(c) for c in ("alpha", "pck_pct", "loss")])


@query("""WITH t AS (SELECT pair_id, y, x FROM fx_flow WHERE dx > 0), p AS (SELECT pair_id, y, x FROM fx_flow WHERE pdx > 0),
          b AS (SELECT coalesce(t.pair_id, p.pair_id) AS pair_id, t.y AS ty, p.y AS py FROM t FULL JOIN p ON t.pair_id = p.pair_id AND t.y = p.y AND t.x = p.x),
          s AS (SELECT pair_id, CAST(sum(CASE WHEN ty IS NOT NULL AND py IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS i, CAST(count(*) AS BIGINT) AS u FROM b GROUP BY pair_id)
          SELECT pair_id, round(i / (u * 1.0E0), 6) AS iou, round((256 - (u - i)) / 256.0E0, 6) AS lt_acc FROM s""")
def q28_mask_iou_ltacc(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_flow")
    got = M.mask_scores(f.where("pdx > 0"), f.where("dx > 0"), 256)
    return got.select("pair_id", F.round("iou", 6).alias("iou"), F.round("lt_acc", 6).alias("lt_acc"))


@query("""WITH l AS (SELECT pair_id, y, x, abs(pdx - dx) AS loss1, abs(pdy - dy) AS loss2 FROM fx_flow WHERE dx IS NOT NULL),
          r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loss1, y, x) AS r1, row_number() OVER (PARTITION BY pair_id ORDER BY loss2, y, x) AS r2,
                greatest(1, floor(0.3 * count(*) OVER (PARTITION BY pair_id))) AS k FROM l)
          SELECT pair_id, round(avg(CASE WHEN r2 <= k THEN loss1 END), 6) AS loss1, round(avg(CASE WHEN r1 <= k THEN loss2 END), 6) AS loss2 FROM r GROUP BY pair_id""")
def q29_small_loss_exchange(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_flow").where("dx IS NOT NULL").select("pair_id", "y", "x", F.abs(F.col("pdx") - F.col("dx")).alias("loss1"), F.abs(F.col("pdy") - F.col("dy")).alias("loss2"))
    return M.dynamic_selection(rows, 0.3).select("pair_id", F.round("loss1", 6).alias("loss1"), F.round("loss2", 6).alias("loss2"))


@query("""WITH v AS (SELECT pair_id, y, x, dx, dy, pdx, pdy FROM fx_flow),
          s AS (SELECT pair_id, avg(sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy))) AS s1, avg(sqrt(dx * dx + dy * dy)) AS s2 FROM v WHERE dx IS NOT NULL GROUP BY pair_id),
          o AS (SELECT unnest([-1, 0, 1]) AS d),
          n AS (SELECT DISTINCT v.pair_id, v.y + a.d AS y, v.x + b.d AS x FROM v, o a, o b WHERE v.dx IS NOT NULL),
          e AS (SELECT v.pair_id, v.y, v.x, sqrt(v.pdx * v.pdx + v.pdy * v.pdy) AS l FROM v JOIN n ON v.pair_id = n.pair_id AND v.y = n.y AND v.x = n.x),
          r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY l, y, x) AS rk, greatest(1, floor(0.5 * count(*) OVER (PARTITION BY pair_id))) AS k FROM e)
          SELECT r.pair_id, round(any_value(s.s1) + 0.5 * avg(CASE WHEN rk <= k THEN l END), 6) AS error1, round(any_value(s.s2) + 0.5 * avg(CASE WHEN rk <= k THEN l END), 6) AS error2
          FROM r JOIN s ON r.pair_id = s.pair_id GROUP BY r.pair_id""")
def q29b_pseudo_filtered_error(spark, sf_dir):
    pred, target = _flows(spark, sf_dir)
    still = target.select("pair_id", "y", "x", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    got = M.pseudo_filtered_error(pred, still, target, 0.5, 3, 0.5)
    return got.select("pair_id", F.round("error1", 6).alias("error1"), F.round("error2", 6).alias("error2"))


@query(f"""WITH d AS (SELECT pair_id, kp_idx, {DISTANCE} AS d FROM fx_kp)
           SELECT pair_id, coalesce(string_agg(CASE WHEN d <= 0.1 * 512 THEN CAST(kp_idx AS VARCHAR) END, ',' ORDER BY kp_idx), '') AS correct,
                  coalesce(string_agg(CASE WHEN d > 0.1 * 512 THEN CAST(kp_idx AS VARCHAR) END, ',' ORDER BY kp_idx), '') AS incorrect,
                  round(coalesce(sum(CASE WHEN d <= 0.1 * 512 THEN d END), 0), 6) AS sum_d FROM d GROUP BY pair_id""")
def q36_pck_detail(spark, sf_dir):
    got = M.pck_detail(fixture(spark, sf_dir, "fx_kp"), pck_threshold(fixture(spark, sf_dir, "fx_pairs")), 0.1)
    return got.select("pair_id", F.array_join("correct", ",").alias("correct"), F.array_join("incorrect", ",").alias("incorrect"), F.round(F.aggregate("correct_d", F.lit(0.0), lambda a, b: a + b), 6).alias("sum_d"))


@query("""WITH e AS (SELECT pair_id, sqrt((pdx - dx) * (pdx - dx) + (pdy - dy) * (pdy - dy)) AS err, sqrt(dx * dx + dy * dy) AS mag FROM fx_flow WHERE dx IS NOT NULL),
          p AS (SELECT pair_id, avg(CASE WHEN err <= 0.1 * 16 THEN 100.0E0 ELSE 0.0E0 END) AS a, avg(CASE WHEN err <= 0.05 * 16 THEN 100.0E0 ELSE 0.0E0 END) AS b FROM e GROUP BY pair_id)
          SELECT 'pck@0.1' AS metric, round(avg(a), 6) AS value FROM p UNION ALL SELECT 'tss_pck', round(avg(b), 6) FROM p
          UNION ALL SELECT 'sintel_pck', round(avg(CASE WHEN err <= 1 THEN 1.0E0 ELSE 0.0E0 END), 6) FROM e
          UNION ALL SELECT 'kitti_f1', round(100 * avg(CASE WHEN err > 3 AND (mag = 0 OR err / mag > 0.05) THEN 1.0E0 ELSE 0.0E0 END), 6) FROM e
          UNION ALL SELECT 'epe', round(avg(err), 6) FROM e""")
def q47_metric_dispatch(spark, sf_dir):
    pred, target = _flows(spark, sf_dir)
    out = None
    for m in ("pck@0.1", "tss_pck", "sintel_pck", "kitti_f1", None):
        row = M.evaluate(pred, target, m, 16)
        out = row if out is None else out.unionByName(row)
    return out.withColumn("value", F.round("value", 6))


@query(f"SELECT round(avg(pck_pct), 6) AS pck_pct, CAST(count(*) AS BIGINT) AS total FROM ({PER_PAIR}) t")
def q47b_merged_states(spark, sf_dir):
    per = _per_pair(spark, sf_dir)
    got = M.merge_states([M.metric_state(per.where(F.col("split") == s)) for s in ("O", "F", "P")])
    return got.withColumn("pck_pct", F.round("pck_pct", 6))
