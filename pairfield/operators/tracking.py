"""Metric logs, batches and checkpoints: WIN-4..10, SNK-5, AGG-43, GEN-22."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import unit
from .order import running


def running_best(metrics: DataFrame, by: list[str] = ("benchmark",), order: list[str] = ("epoch",), value: str = "value") -> DataFrame:
    """WIN-4: the best before each row (0 at first) and whether the row beats it."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(value).over(before), F.lit(0.0)), F.lit(0.0))
    return metrics.withColumn("best_before", best).withColumn("is_best", F.col(value) > F.col("best_before"))


def best_epoch(metrics: DataFrame, by: list[str] = ("benchmark",), value: str = "value") -> DataFrame:
    """WIN-5: the best value and the first epoch that has it."""
    return metrics.groupBy(*by).agg(F.max(value).alias("best"), F.max_by("epoch", F.struct(F.col(value), -F.col("epoch"))).alias("epoch"))


def running_mean(metrics: DataFrame, by: list[str] = ("run", "epoch"), order: list[str] = ("step",), value: str = "value") -> DataFrame:
    """WIN-6."""
    return metrics.withColumn("running_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def select_checkpoints(df: DataFrame, policy: str, by: list[str] = ("run",), time: str = "step", score: str = "value") -> DataFrame:
    """WIN-7: all checkpoints, each run's last, or its best (the earliest of equal ones)."""
    if policy == "all":
        return df
    order = F.struct(time) if policy == "last" else F.struct(score, -F.col(time))
    best = df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), order).alias("__best"))
    return best.select("__best.*")


def assign_batches(df: DataFrame, size: int, order: list[str], by: list[str] = (), drop_last: bool = False) -> DataFrame:
    """WIN-9: batch numbers of consecutive rows; drop_last leaves out a batch that is not full. The first column of order is a number."""
    out = running(df, order[0], tuple(order[1:]), tuple(by), name="batch").withColumn("batch", F.floor((F.col("batch") - 1) / F.lit(size)).cast("long"))
    if not drop_last:
        return out
    return out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by, "batch"))).where(F.col("n") == size).drop("n")


def number_objects(df: DataFrame, order: list[str], by: list[str] = ()) -> DataFrame:
    """WIN-10: numbers from 1. The first column of order is a number."""
    return running(df, order[0], tuple(order[1:]), tuple(by), name="object_no").withColumn("object_no", F.col("object_no").cast("long"))


def shuffle_order(df: DataFrame, seed: int, epoch: int, key: str, by: list[str] = ()) -> DataFrame:
    """GEN-22: a place for each row, drawn anew for each epoch."""
    drawn = df.withColumn("__u", unit(seed, f"shuffle/{epoch}", key))
    return running(drawn, "__u", (key,), tuple(by), name="place").withColumn("place", (F.col("place") - 1).cast("long")).drop("__u")


def training_summary(metrics: DataFrame) -> DataFrame:
    """SNK-5: best value per benchmark and its checkpoint's name, N/A for epoch 0."""
    return best_epoch(metrics).select("benchmark", "best", F.when(F.col("epoch") > 0, F.concat(F.lit("epoch_"), F.col("epoch").cast("string"))).otherwise("N/A").alias("checkpoint"))


def count_by_prefix(df: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """AGG-43: sums by the part of the name before its first dot or space."""
    return df.groupBy(F.regexp_extract(name, "^([^. ]*)", 1).alias("prefix")).agg(F.sum(n).alias("total"))
