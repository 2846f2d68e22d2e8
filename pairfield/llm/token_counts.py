"""Token counts of documents in flat files without an index.

A flat file is a run of ids (uint16) in which an end-of-document id closes each
document; it is stored as blocks that pay no heed to documents. Each block is
searched for the end id as one vector. A running sum over the block summaries
of a file (ids, ends, last end) then gives every block the position and the
document number at which it starts, and stitches documents that span blocks.

Text that spells the end id is encoded as ordinary text. Null texts count as
empty: 0 tokens. Ids after a file's last end id are reported as a document
without doc_id. Repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sliced

END = 49_407
BLOCK = 1 << 20


def write_flat(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """file, block, data (ids) and names (doc_ids of the documents that end there, in order)."""

    def run(batches):
        from pyspark import TaskContext

        from .words import encoder

        enc, file, block = encoder(vocabulary, True), TaskContext.get().partitionId(), 0
        ids, names = np.zeros(0, np.uint16), []  # what no block holds yet

        def row(data, ended):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([data.tobytes()], pa.binary()), pa.array([ended], pa.list_(pa.int64()))], ["file", "block", "data", "names"])

        for batch in sliced(batches, text):
            got, counts = enc.encode(batch.column(1))
            ids = np.concatenate([ids, np.insert(got, np.cumsum(counts), END).astype(np.uint16)])
            names += batch.column(0).to_pylist()
            while len(ids) >= BLOCK:
                n = int(np.count_nonzero(ids[:BLOCK] == END))
                yield row(ids[:BLOCK], names[:n])
                ids, names, block = ids[BLOCK:], names[n:], block + 1
        if len(ids):
            yield row(ids, names)

    flat = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "file int, block int, data binary, names array<bigint>")
    return saved(flat, "flat-tokens")


def count_tokens(blocks: DataFrame, key: str = "doc_id", end: int = END) -> DataFrame:
    """One row for each document: file, its number there, where it starts, its tokens (without the end id)."""

    def run(batches):
        for batch in batches:
            for file, block, data, names in zip(*(batch.column(i) for i in range(4))):
                ids = np.frombuffer(data.as_buffer(), np.uint16)
                at = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([names.as_py()], pa.list_(pa.int64()))],
                    ["file", "block", "n", "ends", "names"],
                )

    found = saved(blocks.select("file", "block", "data", "names").mapInArrow(run, "file int, block int, n long, ends array<bigint>, names array<bigint>"), "token-ends")
    # only a block's summary goes through the file's order
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("e")).select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    last = F.when(F.col("k") > 0, F.col("base") + F.col("e") + 1)
    sums = sums.withColumn("last", last).withColumn("open", F.coalesce(F.max("last").over(before), F.lit(0)))
    based = found.select("file", "block", "ends", "names").join(sums, ["file", "block"])
    cut = F.col("base") + F.col("n")
    done = F.coalesce("last", "open")
    # ids after the last end of a file stand for one more document
    every = F.transform("ends", lambda e, i: F.struct(i.alias("i"), F.get("names", i).alias(key), F.coalesce(F.get("ends", i - 1) + F.col("base") + 1, F.col("open")).alias("start"), (e + F.col("base")).alias("stop")))
    tail = F.when(F.col("final") & (done < cut), F.array(F.struct(F.size("ends").alias("i"), F.lit(None).cast("long").alias(key), done.alias("start"), cut.alias("stop")))).otherwise(F.expr("array()"))
    rows = based.select("file", "first", F.explode(F.concat(every, tail)).alias("d"))
    return rows.select(F.col(f"d.{key}").alias(key), "file", (F.col("first") + F.col("d.i")).alias("number"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))
