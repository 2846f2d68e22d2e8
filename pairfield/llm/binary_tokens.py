"""Token ids in grammar-compressed shard files.

Documents are encoded where they are read, dealt out by ranges of doc_id and
written as blocks of about BLOCK ids. Each block is compressed by Re-Pair: the
most frequent pairs of neighbouring symbols become new symbols, again and again
(a round replaces many pairs at once; where their places overlap the more
frequent pair wins), until no pair stands in LEAST_PLACES places or the symbols
that 16 bits hold run out. A row of the file table is one block:

    shard, block     order of the blocks: ascending doc_id
    doc_ids          int64, one for each document
    n_symbols        uint32, compressed symbols of each document
    rules            uint16 pairs; symbol BASE + i stands for pair i
    lengths          uint32, ids that each rule expands to: with them a range
                     of ids is found without expanding what is before it
    symbols          uint16, the compressed sequence
    n_ids            ids in the block

Pairs never span documents, so one document is read without the others.

Null texts count as empty: they hold the end id alone. Documents of one doc_id
follow each other in the order of their ids. An empty table gives empty files
and an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_width, sliced

BLOCK = 1 << 20
BASE = 49_408
MOST_SYMBOLS = 65_536
#: Rules that a round may add, and the fewest places that make a rule.
ROUND_RULES, LEAST_PLACES = 4_096, 8
SLOT_BITS = 20
END = 1
FILE_SCHEMA = "shard int, block int, n_docs long, n_ids long, doc_ids binary, n_symbols binary, rules binary, lengths binary, symbols binary"


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each document ends in them, and the rules (n, 2); ends: where documents end in ids."""
    a = ids.astype(np.uint32)
    last = np.zeros(len(a), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    made = 0
    table = np.zeros(1 << SLOT_BITS, np.int32)
    # places whose pair may be frequent: a round makes none but beside the places that it replaced
    live = np.flatnonzero(~last[:-1])
    while (room := min(ROUND_RULES, MOST_SYMBOLS - BASE - made)) > 0 and len(live):
        pairs = (a[live] << np.uint32(16)) | a[live + 1]
        # pairs whose slot was hit too seldom are too seldom themselves
        slot = (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
        often = np.bincount(slot, minlength=len(table))[slot] >= LEAST_PLACES
        live, pairs, slot = live[often], pairs[often], slot[often]
        if not len(live):
            break
        ranked = np.sort(pairs)
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.concatenate([heads, [len(ranked)]]))
        chosen = np.flatnonzero(counts >= LEAST_PLACES)
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:room]]
        if not len(chosen):
            break
        keys = ranked[heads[chosen]]  # the most frequent first
        # of two in one slot the more frequent is taken now, the other in a later round
        table[(keys[::-1] * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)] = np.arange(len(keys), dtype=np.int32)[::-1]
        rank = table[slot]
        hit = keys[np.minimum(rank, len(keys) - 1)] == pairs
        where, rank = live[hit], rank[hit]
        # where places overlap the more frequent pair wins; of a symbol repeated, every second place
        beside = np.where(np.diff(where) == 1, 0, len(keys))
        before, after = np.append(len(keys), np.maximum(rank[:-1], beside)), np.append(np.maximum(rank[1:], beside), len(keys))
        at = np.arange(len(where))
        first = np.maximum.accumulate(np.where(rank != before, at, 0))
        take = (rank < before)[first] & ((at - first) % 2 == 0) & (rank <= after)
        where = where[take]
        # pairs that lost all their places take no symbol
        used, symbol = np.unique(rank[take], return_inverse=True)
        a[where] = BASE + made + symbol.astype(np.uint32)
        last[where] = last[where + 1]
        stay, open_ = np.ones(len(a), bool), np.zeros(len(a), bool)
        stay[where + 1] = False
        open_[live] = open_[where] = open_[np.maximum(where, 1) - 1] = True
        a, last = a[stay], last[stay]
        live = np.flatnonzero(open_[stay][:-1] & ~last[:-1])
        rules.append(np.stack([keys[used] >> 16, keys[used] & 0xFFFF], 1))
        made += len(used)
    # the ends in the symbols: full documents end where last stands, empty ones add nothing
    full = np.diff(np.concatenate([[0], ends])) > 0
    where = np.concatenate([[0], np.flatnonzero(last) + 1])
    return a.astype(np.uint16), where[np.cumsum(full)], np.concatenate(rules).astype(np.uint16) if rules else np.zeros((0, 2), np.uint16)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    out: list[int] = []
    for x, y in rules.tolist():
        out.append((1 if x < BASE else out[x - BASE]) + (1 if y < BASE else out[y - BASE]))
    return np.array(out, np.uint32)


def _opened(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: rules are opened level by level."""
    a = symbols.astype(np.uint16)
    while True:
        open_ = a >= BASE
        if not open_.any():
            return a
        n = open_.astype(np.int64) + 1
        first = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint16)
        out[first] = np.where(open_, 0, a)
        pair = rules[a[open_].astype(np.int64) - BASE]
        out[first[open_]], out[first[open_] + 1] = pair[:, 0], pair[:, 1]
        a = out


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: every rule is opened once, and dealt out to the places of its symbol."""
    open_ = symbols >= BASE
    if not open_.any():
        return symbols.astype(np.uint16)
    lengths = rule_lengths(rules).astype(np.int64)
    flat = _opened(np.arange(BASE, BASE + len(rules), dtype=np.uint16), rules)
    rule = symbols[open_].astype(np.int64) - BASE
    n, start = np.ones(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    n[open_], start[open_] = lengths[rule], (np.cumsum(lengths) - lengths)[rule]
    ends = np.cumsum(n)
    out = flat[np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]))]
    out[ends[~open_] - 1] = symbols[~open_]
    return out


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 of a block, opening only the symbols that cover them."""
    symbols, rules = np.frombuffer(row["symbols"], np.uint16), np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
    lengths = np.frombuffer(row["lengths"], np.uint32)
    size = np.ones(len(symbols), np.int64)
    size[symbols >= BASE] = lengths[symbols[symbols >= BASE].astype(np.int64) - BASE]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules)[start - skip : stop - skip]


def encode_documents(docs: DataFrame, vocabulary: str, bounds: list[int], text: str = "text", key: str = "doc_id", end: int = END) -> DataFrame:
    """shard, doc_id and ids (uint16, with the end id) of each document; bounds: first doc_ids of shards 1, 2, ..."""

    def run(batches):
        from .words import encoder

        enc, edges = encoder(vocabulary), np.array(bounds, np.int64)
        for batch in sliced(batches, text):
            ids, counts = enc.encode(batch.column(1))
            if len(ids) and int(ids.max()) >= BASE:
                raise ValueError(f"ids must be under {BASE}: {vocabulary}")
            n = len(counts)
            ends = np.cumsum(counts + 1)
            full = np.insert(ids, np.cumsum(counts), end).astype(np.uint16)
            keys = batch.column(0)
            shard = np.searchsorted(edges, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]) * 2), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays([pa.array(shard), keys, data.cast(pa.binary())], ["shard", key, "ids"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"shard int, {key} long, ids binary")


def write_blocks(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The file table of encoded documents, saved in the shared folder."""

    def run(batches):
        docs, sizes, parts, shard, block = [], [], [], None, 0

        def row():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            ends = np.cumsum(np.array(sizes, np.int64))
            symbols, at, rules = compress(ids, ends)
            made = {
                "shard": shard, "block": block, "n_docs": len(docs), "n_ids": len(ids), "doc_ids": pa.array(docs, pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy().tobytes(),
                "n_symbols": np.diff(np.concatenate([[0], at])).astype(np.uint32).tobytes(), "rules": rules.tobytes(), "lengths": rule_lengths(rules).tobytes(), "symbols": symbols.tobytes(),
            }
            return pa.RecordBatch.from_pylist([made], schema)

        held = 0
        for batch in batches:
            for s, d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if docs and (s != shard or held >= BLOCK):
                    yield row()
                    docs, sizes, parts, held, block = [], [], [], 0, block + 1 if s == shard else 0
                shard = s
                ids = np.frombuffer(data.as_buffer(), np.uint16)
                docs.append(d)
                sizes.append(len(ids))
                parts.append(ids.copy())
                held += len(ids)
        if docs:
            yield row()

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in FILE_SCHEMA.split(", "))])
    ordered = encoded.repartition(shuffle_width(encoded.sparkSession), "shard").sortWithinPartitions("shard", key, "ids")
    return saved(ordered.mapInArrow(run, FILE_SCHEMA), "token-blocks")


def shard_bounds(docs: DataFrame, n: int, key: str = "doc_id") -> list[int]:
    """First doc_ids of shards 1 to n-1, from quantiles of the keys."""
    got = docs.select(F.percentile_approx(F.col(key).cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    return sorted(set(got or []))


def read_blocks(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the file table."""
    # blocks are numbered by two running sums: over the shards, and inside each shard
    per = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    starts = files.select("shard", "block", "n_ids").select("shard", "block", inside.alias("inside")).join(shards, "shard").select("shard", "block", (F.col("inside") + F.col("shard_start")).alias("block_start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules = np.frombuffer(row["symbols"], np.uint16), np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
                lengths = np.frombuffer(row["lengths"], np.uint32)
                size = np.ones(len(symbols), np.int64)
                size[symbols >= BASE] = lengths[symbols[symbols >= BASE].astype(np.int64) - BASE]
                upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(np.frombuffer(row["n_symbols"], np.uint32).astype(np.int64))])]
                whole = memoryview(expand(symbols, rules).astype("<u4")).cast("B")
                at = upto.tolist()
                crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(at, at[1:])]
                docs = pa.array(np.frombuffer(row["doc_ids"], np.int64))
                docs = pa.compute.if_else(pa.compute.equal(docs, np.iinfo(np.int64).min), None, docs)
                n = len(crc)
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(upto[:-1]), pa.array(np.diff(upto)), pa.array(crc, pa.int64())], [key, "shard", "block", "offset", "n_tokens", "ids_crc32"])

    decoded = files.mapInArrow(run, f"{key} long, shard int, block int, offset long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["shard", "block"]).select(key, (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def token_files(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode docs and write them; the file table."""
    bounds = shard_bounds(docs, 4 * shuffle_width(docs.sparkSession), key)
    return write_blocks(encode_documents(docs, vocabulary, bounds, text, key), key)
