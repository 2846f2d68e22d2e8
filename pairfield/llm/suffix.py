"""Removal of long repeats, found in suffix arrays by Lyndon grouping.

A byte goes if some string of LENGTH bytes that covers it starts anywhere else in
the corpus too. One suffix array of a corpus fits no machine, so strings that can be
equal are brought together first, without loss:

1. Of each LENGTH-byte string the least hash of its GRAM-byte grams (rightmost of
   several) is its anchor. Strings with the same anchor follow each other; they
   are an item. Equal strings have equal anchors, so an item whose anchor occurs
   once has no repeat; items with equal bytes repeat each other whole.
2. Items left over, whose anchors occur in items with other bytes, are cut by the
   anchor's place in the string into parts of STEP strings, here one part an item.
   All strings of a part share a core of LENGTH - STEP + 1 bytes, the anchor, which
   equal strings share as well: parts are grouped by the core's digest. A part is
   the core, one symbol, with up to STEP - 1 bytes before it and after it.
3. Each group gets the suffix array of its parts. Suffixes stand in groups by
   their longest Lyndon prefix, first by its first symbol. From the greatest group
   down, each group finds its members' pointers to the previous suffix of a smaller
   group; those suffixes' prefixes grow by the group's, so they move to new groups
   just above their old ones, the ones that grow more often the higher. Then the
   array is filled from its start: a suffix puts those whose Lyndon prefix ends
   where it begins, found along the same pointers, next into their groups. Nothing
   is compared, renamed or sorted but the first symbols. Neighbours in the array
   that agree for a string's symbols are repeats.

A group of more than CROWD parts, which one task might not hold, is cut into
single strings, and these are grouped by their whole bytes instead of the core's.

Shorter repeats stay, and are counted (n_repeated): of SPAN grams in a row the least
hash names a piece, its gram and BESIDE bytes on either side. Pieces that stand
anywhere else too, told by 64 bits, count with the removed bytes. Each repeat of
SHORT bytes or more holds such a piece, so none is missed; what is counted is the
pieces' bytes, less than the repeat's up to its ends. No suffix array is made for them.

Null and empty texts and those of fewer than LENGTH bytes lose nothing, repeated
rows are repeats of each other, an empty table gives an empty result; other
columns pass through, those with the name of a result are replaced. Bytes are
removed wherever they are: what is kept need not be valid UTF-8, and is binary.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_hits, saved, shuffle_width, sliced, text_buffers, without

LENGTH, GRAM = 400, 32
#: With as many strings as can hold one gram, an item is one part, and its anchor the core.
STEP = LENGTH - GRAM + 1
CORE = LENGTH - STEP + 1
CROWD = 2_000
#: Parts into which the copies of one text are dealt where their spans meet them.
SALTS = 4
#: Pieces of repeats that are counted only.
SPAN, BESIDE = 128, 48
PIECE, SHORT = GRAM + 2 * BESIDE, SPAN + GRAM - 1 + 2 * BESIDE
#: Bytes of texts that are hashed at once: their arrays fit a processor's cache.
BLOCK = 300_000


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all GRAM-byte grams, and numbers that are least for the least hash, the rightmost of several."""
    with np.errstate(over="ignore"):
        h, b, w = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while w < GRAM:  # grams of 2, 4, ... bytes
            h = h[:-w] * b + h[w:]
            b, w = b * b, 2 * w
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    # the hash's upper half, then the place counted down
    return h, (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))


def _least(m: np.ndarray, span: int, w: int = 1) -> np.ndarray:
    """Minima over span numbers in a row, from those over w."""
    while 2 * w <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(m) - (span - w)], m[span - w :]) if w < span else m


def _named(m: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places m names, and where each is named first, between firsts and lasts (of each document); the lasts of their documents."""
    at = (np.uint64(0xFFFFFFFF) - (m & np.uint64(0xFFFFFFFF))).astype(np.int64)
    fresh = np.zeros(len(at) + 1, bool)
    fresh[1:-1] = at[1:] != at[:-1]
    fresh[firsts] = True
    inside = np.zeros(len(at) + 1, np.int8)
    np.add.at(inside, firsts, 1)
    np.add.at(inside, lasts + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    starts = np.flatnonzero(fresh[:-1] & inside)
    return at[starts], starts, lasts[np.searchsorted(firsts, starts, "right") - 1]


def _items(data: np.ndarray, offsets: np.ndarray, both: bool):
    n, none = len(data), (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < (SHORT if both else LENGTH):
        return none + none[2:] if both else none
    h, m = grams(data)
    m, sizes = _least(m, SPAN), np.diff(offsets)
    short = ()
    if both:
        held = sizes >= SHORT
        a, _, _ = _named(m, offsets[:-1][held] + BESIDE, offsets[1:][held] - (SHORT - BESIDE))
        p = np.zeros(len(a), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(-BESIDE, PIECE - BESIDE, GRAM):
                p = (p ^ h[a + k]) * np.uint64(0x94D049BB133111EB)
                p ^= p >> np.uint64(31)
        short = a - BESIDE, p
    held = sizes >= LENGTH
    if not held.any():
        return none + short
    at, starts, lasts = _named(_least(m, LENGTH - GRAM + 1, SPAN), offsets[:-1][held], offsets[1:][held] - LENGTH)
    # an item ends before the next one, or with its document
    return starts, np.minimum(np.append(starts[1:], n), lasts + 1) - starts, at, h[at], *short


def items(data: np.ndarray, offsets: np.ndarray, both: bool = False):
    """First strings, numbers of strings, anchors and anchor hashes of all items; both: and places and hashes of all pieces."""
    cuts = [0, *(np.flatnonzero(np.diff(offsets[1:] // BLOCK)) + 1).tolist(), len(offsets) - 1]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        starts, sizes, at, h, *pieces = _items(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], both)
        if both:
            pieces[0] = pieces[0] + offsets[a]
        found.append((starts + offsets[a], sizes, at + offsets[a], h, *pieces))
    return tuple(map(np.concatenate, zip(*found)))


def anchor_rows(docs: DataFrame, text: str) -> DataFrame:
    """The anchor hash of every item, and every piece's hash."""

    def run(batches):
        for batch in sliced(batches, text):
            _, _, _, h, _, p = items(*text_buffers(batch.column(0)), both=True)
            for x, piece in ((h, False), (p, True)):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.full(len(x), piece))], ["h", "piece"])

    return docs.select(text).mapInArrow(run, "h long, piece boolean")


def _places(h):
    return h, F.shiftrightunsigned(h, 32)


def _held(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the Bloom filter may hold."""
    return bloom_hits(words, h.view(np.int64), (h >> np.uint64(32)).view(np.int64)) if len(h) else np.zeros(0, bool)


def _ids(whole: bytes, starts, sizes, ends) -> np.ndarray:
    """Digests (n, 2) of items: how many strings they have, and the bytes of them."""
    return np.frombuffer(b"".join([blake2b(whole[a : min(a + k - 1 + LENGTH, end)], digest_size=16, salt=k.to_bytes(4, "big")).digest() for a, k, end in zip(starts.tolist(), sizes.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)


def item_rows(docs: DataFrame, again: DataFrame, text: str) -> DataFrame:
    """t1, t2 (the text's hashes), start, n strings, h and digest of the items whose anchors occur again (h); a Bloom filter lets some others pass.

    And t1, t2, start and h of pieces whose hashes occur again, with n 0; copies of a text in one batch give theirs once.
    """
    blooms = docs.sparkSession.sparkContext.broadcast([bloom_filter(again.where(which), *_places(F.col("h"))) for which in ("NOT piece", "piece")])

    def rows(batch, offsets, starts, sizes, h, d):
        doc = np.searchsorted(offsets, starts, "right") - 1
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (starts - offsets[doc], sizes)), pa.array(h.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])],
            ["t1", "t2", "start", "n", "h", "d1", "d2"],
        )

    def run(batches):
        for batch in sliced(batches, text):
            data, offsets = text_buffers(batch.column(2))
            starts, sizes, _, h, places, p = items(data, offsets, both=True)
            hit = _held(blooms.value[0], h)
            if hit.any():
                starts, sizes, h = starts[hit], sizes[hit], h[hit]
                ends = offsets[np.searchsorted(offsets, starts, "right")]
                yield rows(batch, offsets, starts, sizes, h, _ids(data.tobytes(), starts, sizes, ends))
            fresh = np.zeros(batch.num_rows, bool)
            fresh[np.unique(np.stack([batch.column(c).to_numpy() for c in (0, 1)]), axis=1, return_index=True)[1]] = True
            hit = _held(blooms.value[1], p) & fresh[np.searchsorted(offsets, places, "right") - 1]
            if hit.any():
                none = np.zeros((hit.sum(), 2), np.int64)
                yield rows(batch, offsets, places[hit], none[:, 0], p[hit], none)

    return docs.select("t1", "t2", text).mapInArrow(run, "t1 long, t2 long, start int, n int, h long, d1 long, d2 long")


PART = "c1 long, c2 long, i1 long, i2 long, at int, n int, side binary, core int"


def part_rows(docs: DataFrame, open_: DataFrame, text: str) -> DataFrame:
    """Parts of the items whose anchors open_ (h) names: core digest, item, first string, strings, both sides and the left one's length."""
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(open_, *_places(F.col("h"))))

    def run(batches):
        for batch in sliced(batches, text):
            data, offsets = text_buffers(batch.column(0))
            starts, sizes, anchors, h = items(data, offsets)
            hit = np.flatnonzero(_held(bloom.value, h))
            whole, seen, out = data.tobytes(), set(), []
            starts, sizes = starts[hit], sizes[hit]
            ends = offsets[np.searchsorted(offsets, starts, "right")]
            for a, k, anchor, end, (i1, i2) in zip(starts.tolist(), sizes.tolist(), anchors[hit].tolist(), ends.tolist(), _ids(whole, starts, sizes, ends).tolist()):
                if (i1, i2) in seen:
                    continue
                seen.add((i1, i2))
                # strings start at a .. a+k-1; the anchor's place in them tells the part
                for c in range((anchor - a - k + 1) // STEP, (anchor - a) // STEP + 1):
                    core = anchor - STEP * c
                    first, last = max(a, core - STEP + 1), min(a + k - 1, core)
                    c1, c2 = np.frombuffer(blake2b(whole[core : core + CORE], digest_size=16, salt=c.to_bytes(2, "big")).digest(), "<i8").tolist()
                    out.append((c1, c2, i1, i2, first - a, last - first + 1, whole[first:core] + whole[core + CORE : min(last + LENGTH, end)], core - first))
            if out:
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["c1", "c2", "i1", "i2", "at", "n", "side", "core"])

    return docs.select(text).mapInArrow(run, PART)


def suffix_array(text: np.ndarray) -> list[int]:
    """Starts of the suffixes of text (symbols, uint16) in their order."""
    n = len(text)
    order = np.argsort(text, kind="stable")  # by counting
    fresh = np.ones(n, bool)
    fresh[1:] = text[order][1:] != text[order][:-1]
    head = np.flatnonzero(fresh)
    begins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    begins[order], places[order] = head[np.cumsum(fresh) - 1], np.arange(n)
    lengths = np.zeros(n + 1, np.int64)
    lengths[head] = np.diff(np.append(head, n))
    # row: suffixes by group; where: a suffix's place in it; group: its group's first place; size: of the group that begins there
    row, where, group, size = order.tolist(), places.tolist(), begins.tolist(), lengths.tolist()
    smaller = [-1] * n  # the previous suffix of a smaller group
    end = n
    while end:
        begin = group[row[end - 1]]
        members = row[begin:end]
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > begin:
                p = smaller[p]
            smaller[i] = p
        grown: dict[int, int] = {}
        for i in members:
            p = top = smaller[i]
            while top >= 0 and group[top] == begin:
                top = smaller[top]
            while p != top:  # shortens the way for the others of a run
                smaller[p], p = top, smaller[p]
            smaller[i] = top
            if top >= 0:
                grown[top] = grown.get(top, 0) + 1
        times: list[list[int]] = [[] for _ in range(max(grown.values(), default=0))]
        for p, k in grown.items():
            times[k - 1].append(p)
        for same in reversed(times):
            for p in same:
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                q, x = row[last], where[p]
                row[x], where[q], row[last], where[p] = q, x, p, last
            for p in same:
                group[p] += size[group[p]]
            for p in same:
                size[group[p]] += 1
        end = begin
    out, free, placed = [0] * n, list(range(n)), [False] * n
    at = -1
    while at < n:
        p = (n if at < 0 else out[at]) - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]], placed[p] = p, True
            free[g] += 1
            p = smaller[p]
        at += 1
        if at == n:
            break
    return out


def _agreements(words: list[bytes]) -> list[int]:
    """How many bytes each word begins with that another one begins with too: a neighbour in their order agrees for longest."""
    out, order = [0] * len(words), sorted(range(len(words)), key=words.__getitem__)
    for i, j in zip(order, order[1:]):
        k = min(len(words[i]), len(words[j]))
        unlike = int.from_bytes(words[i][:k], "big") ^ int.from_bytes(words[j][:k], "big")
        k -= (unlike.bit_length() + 7) // 8
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def repeats(parts: list[tuple[bytes, int, int]]) -> list[list[int]]:
    """For each part (both sides, length of the left one, strings) the strings that another part has too.

    Parts with equal sides and core places must be given once. Strings hold the
    core, so bytes further from it than any other part agrees are cut off first,
    and parts that are too short then fall away.
    """
    before = _agreements([side[:left][::-1] for side, left, _ in parts])
    after = _agreements([side[left:] for side, left, _ in parts])
    held = [k for k in range(len(parts)) if before[k] + 1 + after[k] >= STEP]
    if len(held) < 2:
        return [[]] * len(parts)
    m, at = len(held), 0
    pieces, number = [], {}
    for i, k in enumerate(held):
        side, left, n = parts[k]
        cut = left - before[k]
        data = np.frombuffer(side[cut : left + after[k]], np.uint8).astype(np.uint16) + np.uint16(m + 1)
        pieces += [data[: before[k]], [m], data[before[k] :], [i]]
        # a string is the core and STEP - 1 bytes beside it
        number.update({at + j - cut: (k, j) for j in range(cut, min(n, left + 1))})
        at += len(data) + 2
    symbols = np.concatenate(pieces).astype(np.uint16)
    text = "".join(map(chr, symbols.tolist()))
    gone: dict[int, set[int]] = defaultdict(set)
    last = -1
    for s in suffix_array(symbols):
        if s in number and last in number and text[s : s + STEP] == text[last : last + STEP]:
            for k, j in (number[last], number[s]):
                gone[k].add(j)
        last = s
    return [sorted(gone[k]) if k in gone else [] for k in range(len(parts))]


def _runs(strings: list[int]):
    """(first, count) of the runs of consecutive numbers."""
    x = np.array(strings)
    cut = np.flatnonzero(np.diff(x) > 1) + 1
    for part in np.split(x, cut):
        yield int(part[0]), len(part)


def group_repeats(parts: DataFrame) -> DataFrame:
    """i1, i2, at, n: strings of items that repeat (n from at on), from parts grouped by their cores."""

    def run(batches):
        carry = None

        def work(table):
            out = []
            rows = zip(*(table.column(c).to_pylist() for c in ("c1", "c2", "i1", "i2", "at", "n", "side", "core")))
            key, held = None, []

            def close():
                sides = defaultdict(set)
                for i1, i2, at, n, side, core in held:
                    sides[side, core, n].add((i1, i2, at))
                if sum(map(len, sides.values())) < 2:
                    return
                kinds = list(sides)
                found = repeats([(side, core, n) for side, core, n in kinds]) if len(kinds) > 1 else [[]]
                for (side, core, n), again in zip(kinds, found):
                    owners = sides[side, core, n]
                    if len(owners) > 1:
                        again = list(range(n))
                    for first, count in _runs(again) if again else ():
                        out.extend((i1, i2, at + first, count) for i1, i2, at in owners)

            for c1, c2, *rest in rows:
                if (c1, c2) != key:
                    if len(held) > 1:
                        close()
                    key, held = (c1, c2), []
                held.append(rest)
            if len(held) > 1:
                close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 2 + [pa.int32()] * 2)], ["i1", "i2", "at", "n"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
            same = (c1 == c1[-1]) & (c2 == c2[-1])
            last = int(np.flatnonzero(same)[0])
            carry = table.slice(last)
            if last:
                yield from work(table.slice(0, last))
        if carry is not None and carry.num_rows:
            yield from work(carry)

    ordered = parts.repartition(shuffle_width(parts.sparkSession), "c1", "c2").sortWithinPartitions("c1", "c2", "i1", "i2")
    return ordered.mapInArrow(run, "i1 long, i2 long, at int, n int")


def crowd_repeats(parts: DataFrame) -> DataFrame:
    """The same from crowded groups, cut into single strings."""

    def run(batches):
        for batch in batches:
            out = []
            for c1, c2, i1, i2, at, n, side, core in zip(*(c.to_pylist() for c in batch.columns)):
                for j in range(n):
                    # string j: the left side from j on, the core, then as much as makes it whole
                    w1, w2 = np.frombuffer(blake2b(side[j : j + STEP - 1], digest_size=16, salt=(core - j).to_bytes(2, "big")).digest(), "<i8").tolist()
                    out.append((c1, c2, w1, w2, i1, i2, at + j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 6 + [pa.int32()])], ["c1", "c2", "w1", "w2", "i1", "i2", "at"])

    strings = parts.mapInArrow(run, "c1 long, c2 long, w1 long, w2 long, i1 long, i2 long, at int")
    key = ["c1", "c2", "w1", "w2"]
    again = strings.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*key)
    return strings.join(again, key).select("i1", "i2", "at", F.lit(1).alias("n"))


def _merged(spans) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] >= a:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed, n_spans, removed (the spans as (start, end) bytes) and n_repeated (bytes removed or in pieces that stand elsewhere too)."""
    docs = without(docs, "kept", "n_bytes", "n_removed", "n_spans", "removed", "n_repeated", "__t1", "__t2", "__salt", "__found", "__noted")
    own = docs.columns
    # rows are told apart by their texts: equal texts lose the same bytes
    told = {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}
    again = saved(anchor_rows(docs, text).groupBy("h", "piece").count().where("count > 1").select("h", "piece"), "suffix-anchors")
    slim = docs.select(F.col(text).alias("__text"), *[v.alias(k) for k, v in told.items()])
    both = saved(item_rows(slim, again, "__text"), "suffix-items")
    every, pieces = both.where("n > 0"), both.where("n = 0").select("t1", "t2", "start", "h")
    kinds = every.groupBy("h", "d1", "d2").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    whole = kinds.where("k > 1").select("d1", "d2", F.array(F.struct(F.lit(0).alias("at"), "n")).alias("runs"))
    open_ = saved(kinds.groupBy("h").count().where("count > 1").select("h"), "suffix-open")
    # parts of one item come from every text that holds it: they count once
    parts = saved(part_rows(docs, open_, text).dropDuplicates(["c1", "c2", "i1", "i2"]), "suffix-parts")
    crowds = parts.groupBy("c1", "c2").count().where(f"count > {CROWD}").select("c1", "c2")
    crowds = saved(crowds, "suffix-crowds")
    calm = parts.join(crowds, ["c1", "c2"], "left_anti")
    crowd = parts.join(crowds, ["c1", "c2"], "left_semi")
    found = group_repeats(calm).unionByName(crowd_repeats(crowd)).groupBy(F.col("i1").alias("d1"), F.col("i2").alias("d2")).agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    marked = saved(whole.unionByName(found), "suffix-found")
    spans = every.join(marked, ["d1", "d2"]).select("t1", "t2", F.explode("runs").alias("r"), "start")
    spans = spans.select("t1", "t2", (F.col("start") + F.col("r.at")).alias("a"), (F.col("start") + F.col("r.at") + F.col("r.n") + (LENGTH - 1)).alias("b"))
    per = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("__found"))
    noted = pieces.join(again.where("piece").select("h"), "h", "left_semi").groupBy("t1", "t2").agg(F.collect_set("start").alias("__noted"))
    per = per.join(noted, ["t1", "t2"], "full").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"t1": "__t1", "t2": "__t2"})

    def cut(batches):
        for batch in sliced(batches, text):
            texts, spans, places = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, "__found", "__noted"))
            kept, sizes, gone, runs, repeated = [], [], [], [], []
            for t, got, also in zip(texts, spans, places):
                data = (t or "").encode()
                merged = _merged((g["a"], g["b"]) for g in got or ())
                edges = [0, *(e for x in merged for e in x), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in merged))
                runs.append([{"start": a, "end": b} for a, b in merged])
                repeated.append(sum(b - a for a, b in _merged([*map(tuple, merged), *((a, a + PIECE) for a in also or ())])))
            left = batch.drop_columns(["__found", "__noted"])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*left.columns, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, span), pa.array(repeated, pa.int64())],
                [*left.schema.names, "kept", "n_bytes", "n_removed", "n_spans", "removed", "n_repeated"],
            )

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + ", kept binary, n_bytes long, n_removed long, n_spans long, removed array<struct<start: bigint, end: bigint>>, n_repeated long"
    salted = docs.withColumns({"__t1": told["t1"], "__t2": told["t2"], "__salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    return salted.join(per, ["__t1", "__t2", "__salt"], "left").select(*own, "__found", "__noted").mapInArrow(cut, schema)
