"""Accuracy of points and flow: AGG-1..13, 29..31, 38, 39, UDF-1, UDF-3, TOP-4."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import flow_is_valid


def point_error(kp: DataFrame | None = None) -> Column:
    """Distance of the predicted from the true source point."""
    dx, dy = F.col("pred_x") - F.col("src_x"), F.col("pred_y") - F.col("src_y")
    return F.sqrt(dx * dx + dy * dy)


def pck_per_pair(kp: DataFrame, pairs: DataFrame, alpha: float) -> DataFrame:
    """AGG-1: pairs with n_pts, n_ok and pck_pct; pairs without points have 0 (a divisor of at least 1)."""
    joined = kp.join(pairs.select("pair_id", "thr"), "pair_id")
    counts = joined.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_pts"), F.sum((point_error() <= alpha * F.col("thr")).cast("long")).alias("n_ok"))
    out = pairs.join(counts, "pair_id", "left").withColumns({"n_pts": F.coalesce("n_pts", F.lit(0)), "n_ok": F.coalesce("n_ok", F.lit(0))})
    return out.withColumn("pck_pct", 100.0 * F.col("n_ok") / F.greatest("n_pts", F.lit(1)))


def pck_detail(kp: DataFrame, pairs: DataFrame, alpha: float) -> DataFrame:
    """AGG-2: per pair the ids of right and wrong points, in order, and the distances of the right ones."""
    rows = kp.join(pairs.select("pair_id", "thr"), "pair_id").withColumn("d", point_error()).withColumn("ok", F.col("d") <= alpha * F.col("thr"))
    listed = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("kp_idx", "ok", "d"))).alias("p"))

    def pick(ok: bool, field: str) -> Column:
        return F.transform(F.filter("p", lambda s: s["ok"] == F.lit(ok)), lambda s: s[field])

    return listed.select("pair_id", pick(True, "kp_idx").alias("correct"), pick(False, "kp_idx").alias("incorrect"), pick(True, "d").alias("correct_d"))


def pck_mean(per_pair: DataFrame) -> DataFrame:
    """AGG-3."""
    return per_pair.agg(F.avg("pck_pct").alias("pck_pct"), F.count(F.lit(1)).alias("n_pairs"))


def pck_by(per_pair: DataFrame, keys: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """AGG-4: mean by keys, or by several sets of keys at once."""
    agg = [F.avg("pck_pct").alias("pck_pct"), F.count(F.lit(1)).alias("n_pairs")]
    if sets is None:
        return per_pair.groupBy(*keys).agg(*agg)
    return per_pair.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*agg)


def _errors(pred: DataFrame, target: DataFrame, keys: list[str], invalid: str) -> DataFrame:
    """Pixels with a valid target: keys, y, x, the error and the target's length."""
    t = target.where(flow_is_valid(invalid=invalid)).select(*keys, "y", "x", "dx", "dy")
    p = pred.select(*keys, "y", "x", F.col("dx").alias("px"), F.col("dy").alias("py"))
    return t.join(p, [*keys, "y", "x"]).withColumns({"err": F.hypot(F.col("px") - F.col("dx"), F.col("py") - F.col("dy")), "mag": F.hypot("dx", "dy")})


def dense_pck(pred: DataFrame, target: DataFrame, alpha: float, size: float | None = None, invalid: str = "inf") -> DataFrame:
    """AGG-5: percent of valid pixels per pair within alpha, relative to size below 1 and in pixels else; no valid pixel: NULL."""
    limit = alpha * size if alpha < 1 else alpha
    rows = _errors(pred, target, ["pair_id"], invalid).groupBy("pair_id").agg(F.avg((F.col("err") <= limit).cast("double")).alias("f"))
    return target.select("pair_id").distinct().join(rows, "pair_id", "left").select("pair_id", (100.0 * F.col("f")).alias("pck_pct"))


def dense_pck_by_class(per_pair: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """AGG-6."""
    return per_pair.join(labels, "pair_id").groupBy(by).agg(F.avg("pck_pct").alias("pck_pct"))


def pixel_pck(pred: DataFrame, target: DataFrame, alpha: float = 1.0, mask: DataFrame | None = None, invalid: str = "inf") -> DataFrame:
    """AGG-7: the fraction of all valid pixels (of the mask's, if given) within alpha pixels."""
    rows = _errors(pred, target, ["pair_id"], invalid)
    if mask is not None:
        rows = rows.join(mask, ["pair_id", "y", "x"], "left_semi")
    return rows.agg(F.avg((F.col("err") <= alpha).cast("double")).alias("pck_frac"), F.count(F.lit(1)).alias("n_valid"))


def endpoint_error(pred: DataFrame, target: DataFrame, reduction: str | None = "mean", invalid: str = "inf") -> DataFrame:
    """AGG-8, 9, 10: mean, sum, batch_sum (the sum over the count of valid pixels), or None for a mean per pair."""
    rows = _errors(pred, target, ["pair_id"], invalid)
    if reduction is None:
        return rows.groupBy("pair_id").agg(F.avg("err").alias("epe"))
    value = {"mean": F.avg("err"), "sum": F.sum("err"), "batch_sum": F.try_divide(F.sum("err"), F.count("err"))}[reduction]
    return rows.agg(value.alias("epe"), F.count(F.lit(1)).alias("n_valid"))


#: Weights of the levels, the finest last; levels past the list have the last weight.
LEVEL_WEIGHTS = (0.32, 0.08, 0.02, 0.01, 0.005)


def multiscale_epe(levels: DataFrame, targets: DataFrame, weights: tuple[float, ...] = LEVEL_WEIGHTS) -> DataFrame:
    """AGG-11: weighted sum over levels of the mean error; both tables: level, pair_id, y, x, dx, dy."""
    rows = _errors(levels, targets, ["level", "pair_id"], "inf").groupBy("level").agg(F.avg("err").alias("epe"))
    table = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(table, F.least(F.col("level") + 1, F.lit(len(weights))).cast("int"))
    return rows.agg(F.sum(weight * F.col("epe")).alias("loss"))


def kitti_f1(pred: DataFrame, target: DataFrame, invalid: str = "inf") -> DataFrame:
    """AGG-12: percent of valid pixels off by more than 3 px and more than 5 % of the flow's length."""
    relative = F.try_divide(F.col("err"), F.col("mag"))
    bad = (F.col("err") > 3) & F.coalesce(relative > 0.05, F.lit(True))
    return _errors(pred, target, ["pair_id"], invalid).agg((100.0 * F.avg(bad.cast("double"))).alias("f1_pct"), F.count(F.lit(1)).alias("n_valid"))


def multi_benchmark(per_pair: DataFrame, losses: DataFrame, alphas: dict[str, float]) -> DataFrame:
    """AGG-29: per benchmark its alpha, mean PCK and mean of batch losses, then a row of means over benchmarks.

    per_pair: benchmark, pck_pct; losses: benchmark, batch, loss. A benchmark
    without alpha is an error.
    """
    spark = per_pair.sparkSession
    table = spark.createDataFrame(list(alphas.items()), "benchmark string, alpha double")
    pck = per_pair.groupBy("benchmark").agg(F.avg("pck_pct").alias("pck_pct"))
    loss = losses.groupBy("benchmark", "batch").agg(F.avg("loss").alias("loss")).groupBy("benchmark").agg(F.avg("loss").alias("loss"))
    rows = pck.join(loss, "benchmark", "left").join(table, "benchmark", "left")
    alpha = F.when(F.col("alpha").isNull(), F.raise_error(F.concat(F.lit("no alpha for "), F.col("benchmark"))).cast("double")).otherwise(F.col("alpha"))
    rows = rows.select("benchmark", alpha.alias("alpha"), "pck_pct", "loss")
    return rows.unionByName(rows.agg(F.lit("average").alias("benchmark"), F.avg("alpha").alias("alpha"), F.avg("pck_pct").alias("pck_pct"), F.avg("loss").alias("loss")))


def mask_scores(pred: DataFrame, true: DataFrame, n_pixels: int | None = None, key: str = "pair_id") -> DataFrame:
    """AGG-30, AGG-31: iou and lt_acc of mask pixels (key, y, x); lt_acc counts equal background too."""
    both = pred.select(key, "y", "x").distinct().withColumn("p", F.lit(1)).join(true.select(key, "y", "x").distinct().withColumn("t", F.lit(1)), [key, "y", "x"], "full")
    inter = F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0))
    out = both.groupBy(key).agg(inter.alias("inter"), F.count(F.lit(1)).alias("union"))
    scores = out.select(key, (F.col("inter") / F.col("union")).alias("iou"), "inter", "union")
    return scores if n_pixels is None else scores.withColumn("lt_acc", (n_pixels - (F.col("union") - F.col("inter"))) / n_pixels)


def dynamic_selection(rows: DataFrame, rate: float, by: list[str] = ("pair_id",), order: list[str] = ("y", "x")) -> DataFrame:
    """AGG-38, TOP-4: each side's mean loss over the other's k lowest pixels, k = max(1, int(rate n))."""
    w1, w2 = Window.partitionBy(*by).orderBy("loss1", *order), Window.partitionBy(*by).orderBy("loss2", *order)
    ranked = rows.withColumns({"r1": F.row_number().over(w1), "r2": F.row_number().over(w2), "k": F.greatest(F.lit(1), F.floor(rate * F.count(F.lit(1)).over(Window.partitionBy(*by))))})
    return ranked.groupBy(*by).agg(F.avg(F.when(F.col("r2") <= F.col("k"), F.col("loss1"))).alias("loss1"), F.avg(F.when(F.col("r1") <= F.col("k"), F.col("loss2"))).alias("loss2"))


def dilate(cells: DataFrame, k: int, by: list[str] = ("pair_id",)) -> DataFrame:
    """Cells within a k by k window of a labelled one."""
    r = k // 2
    near = cells.select(*by, F.explode(F.sequence(F.col("y") - r, F.col("y") + r)).alias("y"), "x")
    return near.select(*by, "y", F.explode(F.sequence(F.col("x") - r, F.col("x") + r)).alias("x")).distinct()


def pseudo_filtered_error(p1: DataFrame, p2: DataFrame, target: DataFrame, rate: float, k: int, weight: float = 1.0) -> DataFrame:
    """AGG-39: per pair both supervised errors, plus weight times the exchange of small errors near labelled cells."""
    sup = [_errors(p, target, ["pair_id"], "inf").groupBy("pair_id").agg(F.avg("err").alias(f"sup{i}")) for i, p in ((1, p1), (2, p2))]
    near = dilate(target.where(flow_is_valid()).select("pair_id", "y", "x"), k)
    a = p1.select("pair_id", "y", "x", F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    b = p2.select("pair_id", "y", "x", F.col("dx").alias("bx"), F.col("dy").alias("by"))
    rows = a.join(b, ["pair_id", "y", "x"]).join(near, ["pair_id", "y", "x"], "left_semi")
    apart = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    picked = dynamic_selection(rows.withColumns({"loss1": apart, "loss2": apart}), rate)
    return picked.join(sup[0], "pair_id").join(sup[1], "pair_id").select("pair_id", (F.col("sup1") + weight * F.col("loss1")).alias("error1"), (F.col("sup2") + weight * F.col("loss2")).alias("error2"))


def metric_state(per_pair: DataFrame, by: list[str] = ()) -> DataFrame:
    """UDF-3: the mergeable state of a mean, sum and total."""
    return per_pair.groupBy(*by).agg(F.sum("pck_pct").alias("sum"), F.count("pck_pct").alias("total"))


def merge_states(states: list[DataFrame], by: list[str] = ()) -> DataFrame:
    """UDF-3: states of parts to one mean."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(*by).agg((F.sum("sum") / F.greatest(F.sum("total"), F.lit(1))).alias("pck_pct"), F.sum("total").alias("total"))


def evaluate(pred: DataFrame, target: DataFrame, metric: str | None, size: float | None = None) -> DataFrame:
    """UDF-1: a flow metric by name: pck@alpha, tss_pck, sintel_pck, kitti_f1; None is the endpoint error."""
    if metric is None:
        return endpoint_error(pred, target).select(F.lit("epe").alias("metric"), F.col("epe").alias("value"))
    if m := re.fullmatch(r"pck@([\d.]+)", metric):
        got = dense_pck(pred, target, float(m[1]), size).agg(F.avg("pck_pct").alias("value"))
    elif metric == "tss_pck":
        got = dense_pck(pred, target, 0.05, size).agg(F.avg("pck_pct").alias("value"))
    elif metric == "sintel_pck":
        got = pixel_pck(pred, target).select(F.col("pck_frac").alias("value"))
    elif metric == "kitti_f1":
        got = kitti_f1(pred, target).select(F.col("f1_pct").alias("value"))
    else:
        raise ValueError(f"no metric named {metric}")
    return got.select(F.lit(metric).alias("metric"), "value")
