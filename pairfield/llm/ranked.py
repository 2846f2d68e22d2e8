"""Ranked lexical search: the best documents of each item, by Block-Max MaxScore over shards.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z in lower case. A document's score for an item sums, over the item's terms
with repeats, weight(term) * impact(term, document); both are whole numbers:

    weight = floor(1000 ln((2N + 2) / (2 df + 1)))
    impact = (10^9 tf) div (1000 tf + 12 m),  m = 75 + (25 n N) div L

with N documents that have a term, L terms in all of them, n in this one.

1. Every document is split into terms; N, L and the postings of the items' terms
   come from this one pass, which is written out.
2. Documents are dealt evenly over shards of about SHARD_POSTINGS postings. A
   shard numbers its documents by doc_id and holds for each term blocks of BLOCK
   postings: packed gaps and counts, and open beside them the last document and
   the greatest impact of each block.
3. A term's greatest impact over all shards bounds what it can add. In a shard,
   terms whose bounds together stay under the item's threshold (the score of its
   last hit so far) are not essential: documents come from the lists of the others.
   A candidate then meets the lists that are not essential, greatest bound first,
   and goes as soon as its score, the maximum of the block it would stand in and
   the bounds of the lists to come are under the threshold; only blocks that some
   candidate is left for are unpacked.
4. Each task carries its heaps of `top` hits from shard to shard. The heaps of all
   tasks are merged in two levels.

Items come in blocks of about ITEM_BYTES of text, for each of which the index holds
that block's terms; nothing else of the items or the index is ever gathered.

A text without terms, empty or null, is no document, and an item without terms has no
hits. Each row of docs is a document: repeated rows rank one after the other, rows without
a doc_id come last among equals. Items that repeat (same id and text) count once;
different texts of one item id are ranked each. Only scores above 0 are hits. Empty
tables give an empty result; other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_width, sliced, text_buffers

TOP = 20
BLOCK = 128
SHARD_POSTINGS = 1_000_000
ITEM_BYTES = 4_000_000
#: Documents of a shard that are looked at in one go.
WINDOW = 4_096
#: Groups of tasks in the first level of merging.
MERGE = 64
_LOW = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The terms of all texts in a row as codes of a dictionary, the dictionary, and how many each text has."""
    data, offsets = text_buffers(texts)
    low = pa.py_buffer(data.tobytes().translate(_LOW))
    spaced = pc.ascii_trim_whitespace(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), low]))
    parts = pc.ascii_split_whitespace(spaced)
    counts = np.where(pc.equal(spaced, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(parts).to_numpy(zero_copy_only=False)).astype(np.int64)
    words = parts.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    return codes[codes != empty], words.dictionary, counts


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, asked: list[str], text: str, key: str) -> DataFrame:
    """dealt, doc_id, n, codes (of asked) and tfs of each document that has a term."""

    def run(batches):
        from pyspark import TaskContext

        place, task = {t: i for i, t in enumerate(asked)}, TaskContext.get().partitionId() << 33
        for batch in sliced(batches, text):
            codes, words, counts = terms(batch.column(1))
            known = np.fromiter((place.get(w, -1) for w in words.to_pylist()), np.int64, len(words))[codes]
            doc = np.repeat(np.arange(len(counts)), counts)[known >= 0]
            pairs, tfs = np.unique(doc * len(asked) + known[known >= 0], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(counts) + 1) * len(asked)).astype(np.int32)
            got = pa.RecordBatch.from_arrays(
                [
                    pa.array(task + np.arange(len(counts))), batch.column(0), pa.array(counts),
                    pa.ListArray.from_arrays(ends, pa.array((pairs % max(len(asked), 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int64))),
                ],
                ["dealt", "doc_id", "n", "codes", "tfs"],
            )
            task += len(counts)
            yield got.filter(pa.array(counts > 0))

    return saved(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, "dealt long, doc_id long, n long, codes array<int>, tfs array<long>"), "ranked-counts")


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    width = next(i for i, t in enumerate(_WIDTHS) if values.max() <= np.iinfo(t).max)
    return width, values.astype(_WIDTHS[width]).tobytes()


def packed(slots: np.ndarray, tfs: np.ndarray, impacts: np.ndarray) -> tuple[bytes, bytes]:
    """A list's blocks: their heads (last slot, greatest impact, where the block ends) and their data."""
    heads, data, gaps = [], [], np.diff(slots, prepend=-1)
    size = 0
    for a in range(0, len(slots), BLOCK):
        b = min(a + BLOCK, len(slots))
        (g, said_g), (t, said_t) = _narrow(gaps[a:b]), _narrow(tfs[a:b])
        data.append(bytes([g, t, b - a - 1]) + said_g + said_t)
        size += len(data[-1])
        heads.append((slots[b - 1], impacts[a:b].max(), size))
    return np.array(heads, np.int64).tobytes(), b"".join(data)


def unpacked(data: bytes, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a block; before: the last slot of the one before it."""
    g, t, n = _WIDTHS[data[0]], _WIDTHS[data[1]], data[2] + 1
    cut = 3 + n * np.dtype(g).itemsize
    return before + np.cumsum(np.frombuffer(data[3:cut], g).astype(np.int64)), np.frombuffer(data[cut:], t).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def by_shard(batches, column: str = "shard"):
    """Tables of one shard each, from batches in the order of shards."""
    held = []
    for batch in batches:
        shards = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(held[-1].schema.get_field_index(column))[0].as_py() != shards[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def index(rows: DataFrame, n_docs: int, n_terms: int, n_postings: int) -> DataFrame:
    """shard, code, n, most, heads, data: a list for each shard and term; at code -1 the shard's documents (doc_ids, m and which ids are null)."""

    def run(batches):
        for table in by_shard(batches):
            ids, no_id = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy()
            order = np.lexsort((ids, no_id))
            slot = np.empty(len(ids), np.int64)
            slot[order] = np.arange(len(ids))
            m = np.array([75 + 25 * n * n_docs // n_terms for n in table.column("n").to_pylist()], np.int64)
            codes = pc.list_flatten(table.column("codes")).to_numpy()
            tfs = pc.list_flatten(table.column("tfs")).to_numpy()
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(table.column("codes")).to_numpy())
            at = np.lexsort((slot[row], codes))
            codes, tfs, row = codes[at], tfs[at], row[at]
            impacts = impact(tfs, m[row])
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            shard = table.column("shard")[0].as_py()
            out = [(shard, -1, len(ids), 0, ids[order].tobytes(), m[order].tobytes() + no_id[order].tobytes())]
            for a, b in zip(cuts, cuts[1:]):
                heads, data = packed(slot[row[a:b]], tfs[a:b], impacts[a:b])
                out.append((shard, int(codes[a]), b - a, int(impacts[a:b].max()), heads, data))
            for a in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 500]), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "code", "n", "most", "heads", "data"])

    spark = rows.sparkSession
    shards = max(shuffle_width(spark), math.ceil(n_postings / SHARD_POSTINGS))
    dealt = rows.where(F.size("codes") > 0).withColumn("shard", F.pmod(F.xxhash64("dealt"), F.lit(shards)).cast("int")).drop("dealt")
    return saved(dealt.repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, code int, n long, most long, heads binary, data binary"), "ranked-index")


class Shard:
    """The lists of a shard; blocks are unpacked when they are first asked for."""

    def __init__(self, table: pa.Table):
        self.lists: dict[int, tuple[np.ndarray, bytes]] = {}
        self.blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for code, heads, data in zip(*(table.column(c).to_pylist() for c in ("code", "heads", "data"))):
            if code < 0:
                self.ids = np.frombuffer(heads, np.int64)
                self.m, self.no_id = np.frombuffer(data[: len(heads)], np.int64), np.frombuffer(data[len(heads) :], bool)
            else:
                self.lists[code] = (np.frombuffer(heads, np.int64).reshape(-1, 3), data)

    def block(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and impacts of a block."""
        if (got := self.blocks.get((code, k))) is None:
            heads, data = self.lists[code]
            slots, tfs = unpacked(data[heads[k - 1, 2] if k else 0 : heads[k, 2]], heads[k - 1, 0] if k else -1)
            got = self.blocks[code, k] = slots, impact(tfs, self.m[slots])
        return got


class Hits:
    """The best `top` of an item so far: by score, then id, rows without an id last."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        scores, ids, no_id = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.no_id, no_id])
        best = np.lexsort((ids, no_id, -scores))[: self.top]
        self.scores, self.ids, self.no_id = scores[best], ids[best], no_id[best]
        if len(best) == self.top:
            self.least = max(1, int(self.scores[-1]))


def search(shard: Shard, codes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, hits: Hits, window: int = WINDOW) -> None:
    """Adds the shard's hits for one item; bounds: the most that each of its terms adds, in rising order as the terms are."""
    upto = np.cumsum(bounds)
    for low in range(0, len(shard.ids), window):
        high = min(low + window, len(shard.ids))
        # documents that stand in these lists only can't reach the threshold
        first = int(np.searchsorted(upto, hits.least, "left"))
        if first == len(codes):
            return
        score = np.zeros(high - low, np.int64)
        for code, w in zip(codes[first:].tolist(), weights[first:].tolist()):
            if code not in shard.lists:
                continue
            lasts = shard.lists[code][0][:, 0]
            for k in range(int(np.searchsorted(lasts, low)), min(int(np.searchsorted(lasts, high - 1)) + 1, len(lasts))):
                slots, adds = shard.block(code, k)
                a, b = np.searchsorted(slots, (low, high))
                score[slots[a:b] - low] += w * adds[a:b]
        at = np.flatnonzero(score)
        score, at = score[at], at + low
        for i in range(first - 1, -1, -1):
            rest = upto[i - 1] if i else 0
            code, w = int(codes[i]), int(weights[i])
            keep = score + upto[i] >= hits.least
            score, at = score[keep], at[keep]
            if not len(at):
                break
            if code not in shard.lists:
                continue
            heads = shard.lists[code][0]
            k = np.searchsorted(heads[:, 0], at)
            most = np.where(k < len(heads), heads[np.minimum(k, len(heads) - 1), 1], 0)
            keep = score + w * most + rest >= hits.least
            score, at, k = score[keep], at[keep], k[keep]
            for b in np.unique(k[k < len(heads)]).tolist():
                slots, adds = shard.block(code, b)
                mine = np.flatnonzero(k == b)
                place = np.minimum(np.searchsorted(slots, at[mine]), len(slots) - 1)
                score[mine] += np.where(slots[place] == at[mine], w * adds[place], 0)
        keep = score >= hits.least
        if keep.any():
            hits.add(score[keep], shard.ids[at[keep]], shard.no_id[at[keep]])


def ranked_block(docs: DataFrame, ids: pa.Array, asked: list[str], wanted: list[list[tuple[int, int]]], id_type: str, text: str, key: str, top: int) -> DataFrame | None:
    """The hits of a block of items; wanted: (code, times) of each item's terms."""
    rows = counted(docs, asked, text, key)
    n_docs, n_terms, n_postings = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("codes"))).first()
    if not n_postings:
        return None
    lists = index(rows, n_docs, n_terms, n_postings)
    # one row for each term of the block
    said = {r[0]: (weight(r[1], n_docs), r[2]) for r in lists.where("code >= 0").groupBy("code").agg(F.sum("n"), F.max("most")).collect()}
    items = []
    for own in wanted:
        got = sorted((t * said[c][0] * said[c][1], c, t * said[c][0]) for c, t in own if c in said and said[c][0] > 0)
        items.append(tuple(np.array(x, np.int64) for x in zip(*got)) or (np.zeros(0, np.int64),) * 3)

    def run(batches):
        from pyspark import TaskContext

        best = [Hits(top) for _ in items]
        for table in by_shard(batches):
            shard = Shard(table)
            for hits, (bounds, codes, weights) in zip(best, items):
                search(shard, codes, weights, bounds, hits)
        task = TaskContext.get().partitionId()
        for i, hits in enumerate(best):
            n = len(hits.ids)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), ids.take(pa.array([i] * n, pa.int32())), pa.array([task] * n, pa.int32()), pa.array(hits.ids, mask=hits.no_id), pa.array(hits.scores)], ["item", "item_id", "task", "doc_id", "score"])

    found = lists.repartition(shuffle_width(docs.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, f"item int, item_id {id_type}, task int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("item", F.pmod("task", F.lit(MERGE))).orderBy(*order))).where(F.col("r") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item."""
    asked = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    id_type = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, made = max(1, math.ceil(size / item_bytes)), []
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        codes, words, counts = terms(pa.concat_arrays(got.column("text").chunks) if got.column("text").num_chunks != 1 else got.column("text").chunk(0))
        wanted = [list(Counter(x.tolist()).items()) for x in np.split(codes, np.cumsum(counts)[:-1])]
        ids = got.column("item_id").chunk(0)
        hits = ranked_block(docs, ids, words.to_pylist(), wanted, id_type, text, key, top)
        if hits is not None:
            made.append(hits)
    if not made:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, made)
