"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it should be seen. Among all
rates in [0, 3] that give each source its target of words, those are taken that
stay nearest to 1 in relative entropy: exp(lambda_source * size / mean size),
cut at 3. Newton iterations on the convex dual find the lambdas; they run as
joins and grouped sums over (source, size) counts, which is all that the rates
depend on, so no iteration reads documents. Sums are decimals: their value does
not depend on the order of rows, and reruns agree.

Rates become copies by systematic rounding inside (source, bucket) parts of at
most about BUCKET documents: a hot source is split over many tasks. The words
that rounding misses are then made up with the part's smallest documents.

A null source is a source of its own, last in order. Texts without words have
size 0; they keep one copy and take no words. Repeated rows count each. Ties in size and
key, null keys too, go by a hash of all columns, so the order of rows and partitions changes
nothing. An empty table gives an empty result; other columns pass through, those with the
name of a result are replaced. A solution that isn't found in ITERATIONS steps is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import saved, without

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BUCKET = 2_000
ITERATIONS = 60
TOLERANCE = 1e-9
_EXACT = "decimal(38,6)"


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def source_targets(counts: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, n_docs, mean_size, least_size from (source, size, n) counts.

    Weights repeat over the sources in code point order. Targets share all
    words by weight and stop at `most` times the source's size, the excess shared
    again: the common level is read from one running sum over the sources (a row
    for each source, not for each document).
    """
    per = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum("n").alias("n_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(whole) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, all_ = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled, used = F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(all_) - filled) / (F.sum("weight").over(all_) - used)
    per = per.withColumn("level", level)
    # the level that holds is the first one, in rising order, that its own source does not cap
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_)
    target = F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "n_docs", "least_size", target.alias("target"), (F.col("source_size") / F.col("n_docs")).alias("mean_size"))


def solve(counts: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """targets with the lambda of each source; counts: (source, size, n)."""
    state = saved(
        targets.select(
            "*",
            F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.log(F.lit(float(most))) * F.col("mean_size") / F.col("least_size")).otherwise(F.lit(0.0)).alias("lam"),
            F.lit(-1e6).alias("lo"),
            (F.log(F.lit(float(most))) * F.col("mean_size") / F.col("least_size")).alias("hi"),
            (F.coalesce(F.col("source_size") == 0, F.lit(True)) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))).alias("done"),
        ),
        "mix-state",
    )
    for _ in range(ITERATIONS):
        x = F.col("size") / F.col("mean_size")
        rate = F.exp(F.least(F.col("lam") * x, F.log(F.lit(float(most)))))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(F.col("lam") * x < F.log(F.lit(float(most))), words * x).otherwise(F.lit(0.0))
        c, s = counts.alias("c"), state.where(~F.col("done")).alias("s")
        sums = (
            c.join(s, _same(F.col("c.source"), F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.sum(words.cast(_EXACT)).cast("double").alias("got"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        )
        a, b = state.alias("a"), sums.alias("b")
        lo = F.when(F.col("got") < F.col("target"), F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") > F.col("target"), F.least("hi", "lam")).otherwise(F.col("hi"))
        near = F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        # Newton on log(words): its slope does not vanish where few words are left
        step = F.col("lam") + F.log(F.col("target") / F.greatest(F.col("got"), F.lit(1e-6))) * F.try_divide(F.col("got"), F.col("slope"))
        joined = a.join(b, _same(F.col("a.source"), F.col("b.source")), "left").select("a.*", "got", "slope").withColumn("new_lo", lo).withColumn("new_hi", hi)
        inside = (step > F.col("new_lo")) & (step < F.col("new_hi"))
        lam = F.when(F.col("done") | near | F.col("got").isNull(), F.col("lam")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("new_lo") + F.col("new_hi")) / 2)
        state = saved(
            joined.select(
                *[c for c in targets.columns],
                lam.alias("lam"),
                F.coalesce("new_lo", "lo").alias("lo"),
                F.coalesce("new_hi", "hi").alias("hi"),
                (F.col("done") | F.coalesce(near, F.lit(True)) | F.coalesce(F.col("new_hi") - F.col("new_lo") <= 1e-14, F.lit(False))).alias("done"),
            ),
            "mix-state",
        )
        if state.where(~F.col("done")).isEmpty():
            return state.drop("lo", "hi", "done")
    open_ = state.where(~F.col("done")).select("source", "target", "lo", "hi").limit(5).collect()
    raise ArithmeticError(f"no rates after {ITERATIONS} iterations for {open_}")


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs with source_size, target, rate and copies; size: a column of word counts."""
    docs = without(docs, "source_size", "target", "rate", "copies")
    own = docs.columns
    keyed = docs.withColumns({"__source": F.col(source), "__size": F.col(size).cast("long")})
    counts = saved(keyed.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    solved = solve(counts, source_targets(counts, weights, most), most)
    p = solved.select(F.col("source").alias("__p"), "source_size", "target", F.col("lam").alias("__lam"), F.col("mean_size").alias("__mean"), F.col("n_docs").alias("__n"))
    rate = F.when(F.col("__size") == 0, F.lit(1.0)).otherwise(F.exp(F.least(F.col("__lam") * F.col("__size") / F.col("__mean"), F.log(F.lit(float(most))))))
    rated = keyed.join(p, _same(F.col("__source"), F.col("__p"))).withColumn("rate", rate)
    # a rate within 1e-9 of a whole number is that number: exp and log need not agree on the last bit
    rated = rated.withColumn("rate", F.when(F.abs(F.col("rate") - F.rint("rate")) < 1e-9, F.rint("rate")).otherwise(F.col("rate")))
    # rows of one key, or of none, are told apart by all that they hold; those that hold the same change places unseen
    held = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
    rated = rated.withColumn("__u", F.xxhash64(F.lit("mix"), F.col(key), F.col("__size"), *held))
    rated = rated.withColumn("__part", F.pmod("__u", F.ceil(F.col("__n") / BUCKET)))
    part = Window.partitionBy("__source", "__part")
    order = part.orderBy("__size", "__u", key)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("rate") - F.floor("rate")
    a = rated.withColumn("__rest", rest).withColumn("__sum", F.sum("__rest").over(running))
    extra = F.floor(F.col("__sum") + 0.5) - F.floor(F.col("__sum") - F.col("__rest") + 0.5)
    a = a.withColumn("__copies", F.floor("rate") + F.least(F.greatest(extra, F.lit(0)), F.lit(1)))
    missing = F.sum((F.col("rate") - F.col("__copies")) * F.col("__size")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    a = a.withColumn("__missing", missing)
    free = (F.col("__size") > 0) & F.when(F.col("__missing") > 0, F.col("__copies") < most).otherwise(F.col("__copies") > 0)
    a = a.withColumn("__free", free).withColumn("__made", F.sum(F.when(F.col("__free"), F.col("__size")).otherwise(F.lit(0))).over(running))
    change = F.when(F.col("__free") & (F.col("__made") - F.col("__size") / 2 <= F.abs("__missing")), F.signum("__missing")).otherwise(F.lit(0.0))
    return a.withColumn("copies", (F.col("__copies") + change).cast("long")).select(*own, "source_size", "target", "rate", "copies")
