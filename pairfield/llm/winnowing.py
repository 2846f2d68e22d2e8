"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of GRAM words gets a hash; of each WINDOW neighbouring hashes the least
one is chosen, the rightmost where several are least. Two texts that share
GRAM + WINDOW - 1 words in a row share a chosen hash, and its position says
where. A chosen hash and its position are held in one long: 40 bits of hash, then
the position counted down from 2^23 - 1 (positions above that start over), so the
least long is the rightmost least hash. Texts with fewer than GRAM words have one
hash over all of them; texts without words have an empty fingerprint, and two
empty ones are alike.

Null texts count as empty. Repeated rows each have their fingerprint; among rows
of one doc_id the order is that of their hashes. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shuffle_width, word_array

GRAM = 5
WINDOW = 8
_PLACES = 1 << 23


def chosen(text: Column) -> Column:
    """The chosen hashes of a text with their positions, each once, in text order."""

    def grams(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - (GRAM - 1), F.least(F.size(ws), F.lit(1)))
        return F.transform(
            F.slice(ws, 1, n),
            lambda w, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, GRAM)]), 24), 23).bitwiseOR(F.lit(_PLACES - 1) - i % F.lit(_PLACES)),
        )

    def minima(p: Column) -> Column:
        def least(m: Column, step: int) -> Column:
            return F.transform(m, lambda x, i: F.least(x, F.get(m, i + step)))

        whole = let(let(let(p, lambda m: least(m, 1)), lambda m: least(m, 2)), lambda m: least(m, 4))  # windows of 2, 4, 8
        return F.array_distinct(F.slice(whole, 1, F.greatest(F.size(p) - (WINDOW - 1), F.least(F.size(p), F.lit(1)))))

    return let(let(word_array(text), grams), minima)


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x, 23)))


def shown(found: Column) -> Column:
    """A fingerprint as text: hash@position, parted by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.hex(F.shiftright(x, 23)), F.lit("@"), (F.lit(_PLACES - 1) - x.bitwiseAND(F.lit(_PLACES - 1))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets; 1 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def ranges(docs: DataFrame, key: str, n: int) -> Column:
    """The number of the key's range among about n equal ones, null first.

    The bounds are found in two steps of an array of arrays, so that a row
    compares with few of them.
    """
    got = docs.select(F.percentile_approx(F.col(key).cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(got or []))
    if not bounds:
        return F.lit(0)
    step = 64
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    groups = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    at = F.size(F.filter(heads, lambda b: b <= F.col(key)))
    inside = F.size(F.filter(F.element_at(groups, F.greatest(at, F.lit(1))), lambda b: b <= F.col(key)))
    return F.coalesce(F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + inside), F.lit(0))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text and next_text, the text that follows in ascending doc_id (after the last: the first).

    Rows are dealt out by ranges of doc_id, so one shuffle brings neighbours
    together; the last row of each range gets its neighbour by a join with the
    ranges' first rows.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = own.withColumn("part", ranges(docs, key, shuffle_width(docs.sparkSession))).withColumn("h", F.xxhash64("text"))
    near = Window.partitionBy("part").orderBy("doc_id", "h")
    led = dealt.select("*", F.lead("text").over(near).alias("after"), F.lead(F.lit(1)).over(near).isNull().alias("last"))
    heads = dealt.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    all_ = Window.orderBy("part")
    tied = heads.select("part", F.coalesce(F.lead("head").over(all_), F.min_by("head", "part").over(Window.partitionBy())).alias("head"))
    edge = tied.join(own.withColumn("h", F.xxhash64("text")), F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.h") == F.col("h"))).groupBy("part").agg(F.first("text").alias("edge"))
    return led.join(edge, "part", "left").select("doc_id", "text", F.when(F.col("last"), F.col("edge")).otherwise(F.col("after")).alias("next_text"))


def half_replaced(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) characters replaced by the first as many of other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
