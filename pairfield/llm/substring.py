"""Substring deduplication over content-defined chunks.

A gear hash rolls over the UTF-8 bytes; where it falls under a threshold a chunk
ends, at the next character. A cut depends on the last 32 bytes only, so an
insertion changes the chunks around it and no others. Every chunk's 128-bit
digest is counted over the corpus; chunks after the first one of their digest
(by doc_id, then place) are repeats. Runs of repeats with `least` (LEAST_RUN)
bytes or more are removed; shorter ones stay, since short phrases recur in texts
that have nothing else in common, and are counted only.

Null and empty texts have no chunks and stay as they are. Rows of one doc_id are
one document: a row that repeats another has the same result. Rows without a doc_id
come after all others and are told apart by their texts: equal texts are one document,
in an order of hashes. An empty table gives an empty result; other columns pass
through, those with the name of a result are replaced.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_buffers, without

MEAN_CHUNK = 40
MOST_CHUNK = 4096
LEAST_RUN = 100
#: Rows without a doc_id are numbered from here on; a doc_id of this size may share a number, and then the rows are one document.
NO_ID = 2**62
#: The gear table: 256 numbers from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20_240)).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK, most: int = MOST_CHUNK) -> np.ndarray:
    """Where chunks end in data, a buffer of documents with these offsets; documents end chunks too."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # after these the hash holds the last 32 bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    starts = (data & 0xC0) != 0x80
    at = np.flatnonzero(h < np.uint32(2**32 // mean)) + 1
    letters = np.append(np.flatnonzero(starts), len(data))
    at = letters[np.searchsorted(letters, at)]  # a cut stands before a whole character
    # a hash over a document's start reads the one before it: no cut in the first 32 bytes
    doc = np.searchsorted(offsets, at, "right") - 1
    at = at[at - offsets[np.minimum(doc, len(offsets) - 1)] >= 32]
    at = np.unique(np.concatenate([at, offsets[1:]]))
    at = at[at > 0]
    long = np.flatnonzero(np.diff(np.concatenate([[0], at])) > most)
    if len(long):
        first = np.concatenate([[0], at])[long]
        more = np.concatenate([np.arange(a + most, at[i], most) for a, i in zip(first, long)])
        at = np.unique(np.concatenate([at, letters[np.searchsorted(letters, more)]]))
    return at


def chunks(docs: DataFrame, text: str) -> DataFrame:
    """id, place (byte), size and digest (two longs) of every chunk; docs has __id."""

    def run(batches):
        for batch in sliced(batches, text):
            data, offsets = text_buffers(batch.column(1))
            if not len(data):
                continue
            ends = cuts(data, offsets)
            starts = np.concatenate([[0], ends[:-1]])
            whole = memoryview(data).cast("B")
            digests = b"".join([blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
            d = np.frombuffer(digests, "<i8").reshape(-1, 2)
            doc = np.searchsorted(offsets, starts, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array((starts - offsets[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])],
                ["id", "place", "size", "d1", "d2"],
            )

    return docs.select("__id", text).mapInArrow(run, "id long, place int, size int, d1 long, d2 long")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_RUN) -> DataFrame:
    """docs with clean_text, n_bytes, n_removed, n_spans, removed (the spans as (start, end) bytes) and n_repeated (bytes of all repeats, also in runs under least)."""
    docs = without(docs, "clean_text", "n_bytes", "n_removed", "n_spans", "removed", "n_repeated", "__id", "__found")
    own = docs.columns
    # numbers above those of documents, so that rows without one don't meet at one key
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID))
    rows = docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), unnamed))
    every = chunks(rows, text)
    here = F.struct("id", "place")
    twice = every.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first")).where("n > 1")
    again = every.join(twice, ["d1", "d2"]).where(here != F.col("first"))
    found = again.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("place", "size", F.col("d1").alias("tag"))).alias("__found"))

    def run(batches):
        for batch in sliced(batches, text):
            texts, spans = batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("__found")).to_pylist()
            clean, sizes, gone, runs, repeated = [], [], [], [], []
            for t, got in zip(texts, spans):
                data = (t or "").encode()
                merged: list[list[int]] = []
                # a doc_id may name several texts: each loses the chunks that it has
                for a, b in sorted({(g["place"], g["place"] + g["size"]) for g in got or () if blake2b(data[g["place"] : g["place"] + g["size"]], digest_size=16).digest()[:8] == g["tag"].to_bytes(8, "little", signed=True)}):
                    if merged and merged[-1][1] == a:
                        merged[-1][1] = b
                    else:
                        merged.append([a, b])
                repeated.append(sum(b - a for a, b in merged))
                merged = [x for x in merged if x[1] - x[0] >= least]
                edges = [0, *(e for x in merged for e in x), len(data)]
                clean.append(t if not merged else b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in merged))
                runs.append([{"start": a, "end": b} for a, b in merged])
            kept = batch.drop_columns(["__found"])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(clean, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, span), pa.array(repeated, pa.int64())],
                [*kept.schema.names, "clean_text", "n_bytes", "n_removed", "n_spans", "removed", "n_repeated"],
            )

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + ", clean_text string, n_bytes long, n_removed long, n_spans long, removed array<struct<start: bigint, end: bigint>>, n_repeated long"
    return rows.join(found, "__id", "left").select(*own, "__found").mapInArrow(run, schema)
