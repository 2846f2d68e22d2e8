"""Numbers and running sums along one order of a whole table, without a task that holds it: WIN-9, WIN-10, GEN-5, GEN-22, GEN-23.

Rows are dealt by ranges of the whole order (group, key, ties, and at last their
place in the input, so that equal keys can be split too), as many ranges as a shuffle
has partitions. Each range counts along its rows; then what comes before a range is added,
which takes one row for each group and range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved


def _local(groups: list[str], weight: str | None, ranges: str):
    """Appends the range's number, whether a row begins a group in it, and the running amount inside group and range."""

    def run(batches):
        from pyspark import TaskContext

        part, last, total, place = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in groups:
                codes = batch.column(batch.schema.get_field_index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            own = tuple(batch.column(batch.schema.get_field_index(c))[0].as_py() for c in groups)
            new[0] = last is None or own != last
            amount = np.ones(n, np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).fill_null(0).to_numpy(zero_copy_only=False)
            # sums of floats run with more digits: their error would grow with the range
            wide = amount.astype(np.longdouble) if amount.dtype.kind == "f" else amount
            upto = np.cumsum(wide)
            begin = np.flatnonzero(new)
            base = np.zeros(n, upto.dtype)
            base[begin] = upto[begin] - wide[begin]
            group = np.cumsum(new)
            offset = np.concatenate([[-total], base[begin]])[group]
            upto = upto - offset
            at = np.arange(place, place + n)
            place += n
            last, total = tuple(batch.column(batch.schema.get_field_index(c))[n - 1].as_py() for c in groups), upto[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at), pa.array(upto.astype(amount.dtype)), pa.array((upto - wide).astype(amount.dtype))], [*batch.schema.names, ranges, "__at", "__upto", "__before"])

    return run


def running(df: DataFrame, key: str, ties: tuple[str, ...] = (), by: tuple[str, ...] = (), weight: str | None = None, name: str = "row_no", before: str | None = None) -> DataFrame:
    """df with the running count (from 1) or sum of weight along key and ties, inside groups of equal `by`; before: a name for the value without the row itself."""
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    kind = "long" if weight is None or df.schema[weight].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"
    order = [*by, key, *ties]
    fed = df if weight is None else df.withColumn("__weight", F.col(weight).cast(kind))
    dealt = fed.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(width, *order, "__place").sortWithinPartitions(*order, "__place").drop("__place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", __range int, __at long, __upto {kind}, __before {kind}"
    counted = saved(dealt.mapInArrow(_local(list(by), None if weight is None else "__weight", "__range"), schema), "running")
    # negative weights may make the last amount of a range not its greatest
    sums = counted.groupBy(*by, "__range").agg(F.max_by("__upto", "__at").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).cast(kind)).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), "__base")
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    out = {name: F.col("__upto") + F.col("__base")} | ({before: F.col("__before") + F.col("__base")} if before else {})
    return counted.join(bases, same).withColumns(out).drop("__range", "__at", "__upto", "__before", "__weight", "__r", "__base", *[f"__{i}" for i in range(len(by))])
