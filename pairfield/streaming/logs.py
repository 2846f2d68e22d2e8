"""Metric logs as streams: STR-1, STR-2. Each job has a batch twin that must agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_path

BEST = "benchmark string, epoch long, value double"


def metric_windows(logs: DataFrame, window: str, slide: str | None = None, watermark: str | None = None, session: bool = False) -> DataFrame:
    """STR-1: count, mean and extremes per run, benchmark and window of event time.

    logs: run, benchmark, value, ts. On a stream the watermark drops rows that come
    later than it; session: windows that close after a gap of `window`.
    """
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark("ts", watermark)
    w = F.session_window("ts", window) if session else F.window("ts", window, slide or window)
    got = rows.groupBy("run", "benchmark", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return got.select("run", "benchmark", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "lo", "hi")


class _Best(StatefulProcessor):
    """The greatest value of a benchmark so far, as typed state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.best.get()[0] if self.best.exists() else float("-inf")
        seen = pd.concat(list(rows)).dropna(subset=["value"]).sort_values("epoch", kind="stable")
        before = seen["value"].cummax().shift(fill_value=float("-inf")).clip(lower=best)
        won = seen[seen["value"] > before]
        if len(won):
            self.best.update((float(won["value"].iloc[-1]),))
        yield pd.DataFrame({"benchmark": pd.Series([key[0]] * len(won), dtype=object), "epoch": won["epoch"].to_numpy(), "value": won["value"].to_numpy()})

    def close(self) -> None:
        pass


def stream_best(logs: DataFrame) -> DataFrame:
    """STR-2: a row whenever a benchmark's value beats all before it; the state is one number, NaN and NULL never win.

    logs: benchmark, epoch, value. Rows of a batch are taken in order of epoch. The state lies
    in the checkpoint, so a stream that stops goes on where it was; see typed_state().
    """
    return logs.select("benchmark", "epoch", "value").groupBy("benchmark").transformWithStateInPandas(_Best(), BEST, "Append", "None")


@contextmanager
def typed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which typed state asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def catch_up(job: Callable[[DataFrame], DataFrame], inbox: str, schema, sink: str, checkpoint: str, spark: SparkSession) -> None:
    """Runs job over the files that came to the inbox since its last run, appends to the sink and stops; fails as the stream does."""
    with typed_state(spark):
        out = job(spark.readStream.schema(schema).parquet(inbox))
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


def replayed(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What job has written after the parts came one after the other as files, with a stop and a new start between any two."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    inbox, sink, checkpoint = (shared_path(spark, f"{name}-{x}") for x in ("inbox", "sink", "checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(inbox)
        catch_up(job, inbox, schema, sink, checkpoint, spark)
    return spark.read.parquet(sink)


def best_so_far(logs: DataFrame) -> DataFrame:
    """STR-2's batch twin: the rows that beat all epochs before."""
    from ..operators.tracking import running_best

    rows = logs.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("benchmark", "epoch").agg(F.max("value").alias("value"))
    return running_best(rows).where("is_best").select("benchmark", "epoch", "value")
