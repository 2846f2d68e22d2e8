"""Helpers that the operators share: scratch tables, word rules, byte columns."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: The white space that ends a word, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
BATCH_ROWS = 2_000
#: The most that a Bloom filter may take: 32 MB.
MOST_BLOOM_BITS = 1 << 28


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Python workers get at most BATCH_ROWS rows at once: rows may hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that a result would bring again: the result's take their place."""
    return df.drop(*[c for c in df.columns if c in names])


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bloom_filter(ids: DataFrame, *hashes: Column, rows: int | None = None, bits: int | None = None) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of rows whose bits the columns of longs tell.

    It has 16 bits a row, but no more than MOST_BLOOM_BITS (32 MB): a fuller one
    lets more rows pass that are not in it, and never stops one that is. rows: how
    many there are, if that is known.
    """
    if bits is None:
        bits = min(MOST_BLOOM_BITS, max(64, 1 << (16 * (ids.count() if rows is None else rows)).bit_length()))
    at = F.explode(F.array(*[h.bitwiseAND(F.lit(bits - 1).cast("long")) for h in hashes]))
    words = ids.select(at.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def bloom_hits(words: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Which rows the filter may hold; hashes: int64, as told to bloom_filter."""
    hit = np.ones(len(hashes[0]), bool)
    for h in hashes:
        p = h & (64 * len(words) - 1)
        hit &= (words[p >> 6] >> (p & 63)) & 1 == 1
    return hit


def bloom_places(column: str) -> list[Column]:
    """Hashes of a column for a Bloom filter."""
    return [F.xxhash64(F.col(column), F.lit(i)).alias(f"p{i}") for i in range(2)]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n+1 offsets into them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (whole[:0], np.zeros(1, np.int64))


def sliced(batches, column: str, most: int = 8_000_000):
    """The batches in slices of about `most` text bytes, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64) + 64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
