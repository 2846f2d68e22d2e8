"""N-gram Jaccard join: which texts share enough word n-grams, and their groups.

The sets hold 64-bit hashes of GRAM-word shingles of the text with A-Z in lower
case. Tokens get one order for the whole corpus: by hash, but those that are heavy
come last. Two sets that are alike enough share one of the first n - ceil(t n) + 1
tokens of both, whatever the order is. Heavy are the tokens that stand in more
than HEAVY_DOCS texts (among the first ones by hash, half as many again as a
prefix has); if they are more than MOST_HEAVY, the most frequent ones, so that what
is broadcast has a bound at any corpus size. Tables that grow with the corpus
are joined by sorting at any size.

1. Documents with one set count once; those with one prefix and size form a group.
2. Groups meet at the tokens of their prefixes; sizes and places of the token
   rule out pairs of groups, and lists without such a pair fall away.
3. The groups left are expanded to their members, with a parity map of each set,
   of about as many bits as the set has shingles: the bits in which two maps differ
   are a lower bound of the difference of the sets. The map of a larger set is
   folded to the size of the smaller one's.
4. Chains: in the lists of its first SEEDS tokens each member looks for the nearest
   larger one (long lists are dealt out in chunks for this). These pairs are
   verified and components formed, so that a cluster of near copies costs one pair
   a member.
5. While long lists hold several components, chains of one member of each join
   what they can, as long as each round halves what is left.
6. Then lists that hold more than one component are worked off whole: first the
   nearest pair of each two components, then, of those that have several and are
   still apart, every pair that no bound rules out. A pair inside a component can
   change nothing, so no link that matters is lost.

In step 6 lists of more than BLOCK members are cut into blocks. The members of the
list's largest component are dealt out once, as they need not meet each other;
the others meet them and themselves block by block. Pairs are verified on the
whole sets.

A text with fewer than GRAM words has one shingle, all of them; null and empty
texts and those without words have none, and are alone. Repeated rows have one
set and stay together; rows of one doc_id are one document. Rows without a doc_id
are documents told apart by their texts: they link as others do, and their
component_id is the least doc_id that they reach, null if there is none. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_hits, bloom_places, saved, shuffle_width, sliced
from .components import components

GRAM, PERCENT = 4, 85
HEAVY_DOCS, MOST_HEAVY = 50, 1 << 20
SEEDS, CHUNK, BLOCK = 4, 512, 2_000
#: Lists of up to so many members are paired many at once.
SMALL = 48
#: Parts into which the rows of one hot token are dealt where they meet a small table.
SALTS = 4
#: Rows without a doc_id are numbered from here on.
NO_ID = 2**62
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sets in a row, each set in rising order, and the size of each."""
    from xxhash import xxh3_64_intdigest

    low = pc.ascii_lower(pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null("")))
    parts = pc.ascii_split_whitespace(low)
    words = parts.flatten().dictionary_encode()
    counts = np.where(pc.equal(low, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(parts).to_numpy(zero_copy_only=False)).astype(np.int64)
    codes = words.indices.to_numpy(zero_copy_only=False)
    listed = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.string()))
    names = pc.binary_join(listed, " ")[0].as_py().split(" ") if len(words.dictionary) else []
    known = np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))
    h = known[codes]
    empty = np.array([x == "" for x in names], bool)
    if empty.any():
        h = h[~empty[codes]]
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        s = h[: max(len(h) - gram + 1, 0)].copy()
        for i in range(1, gram):
            s = s * _MULTIPLY + h[i : len(h) - gram + 1 + i]
        s = _mixed(s)
        whole = doc[: len(s)] == doc[gram - 1 :] if len(s) else np.zeros(0, bool)
        s, of = s[whole], doc[: len(s)][whole]
        short = np.flatnonzero((counts > 0) & (counts < gram))
        if len(short):
            first = np.cumsum(counts) - counts
            made = []
            for i in short.tolist():
                v = np.uint64(counts[i])
                for x in h[first[i] : first[i] + counts[i]]:
                    v = v * _MULTIPLY + x + np.uint64(1)
                made.append(v)
            s, of = np.concatenate([s, _mixed(np.array(made, np.uint64))]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            s, of = s[order], of[order]
    edges = np.searchsorted(of, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        s[a:b].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[fresh], np.bincount(of[fresh], minlength=len(counts))


def _prefix_size(n, percent: int):
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def token_counts(docs: DataFrame, text: str, gram: int, percent: int, least: int) -> DataFrame:
    """token and level, 8 log2 of its texts, of the tokens of `least` texts or more among the first ones of each; saved."""

    def run(batches):
        for batch in sliced(batches, text):
            s, n = shingle_sets(batch.column(0), gram)
            first = np.repeat(np.cumsum(n) - n, n)
            reach = np.repeat(_prefix_size(n, percent) * 3 // 2, n)
            token, count = np.unique(s[np.arange(len(s)) - first < reach], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], ["token", "n"])

    counts = docs.select(text).mapInArrow(run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return saved(counts.select("token", F.floor(8 * F.log2("n")).cast("int").alias("level")), "ngram-tokens")


def heavy_tokens(counts: DataFrame, least: int, most: int) -> np.ndarray:
    """Tokens of about `least` texts or more, rising; at most `most` of them, the most frequent ones."""
    held, floor = 0, math.ceil(8 * math.log2(least))
    for r in sorted(counts.where(F.col("level") >= floor).groupBy("level").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            floor = r["level"] + 1
            break
    return np.sort(counts.where(F.col("level") >= floor).select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64))


def _digest(data: bytes) -> list[int]:
    return np.frombuffer(blake2b(data, digest_size=16).digest(), "<i8").tolist()


def parity_map(s: np.ndarray) -> bytes:
    """Which bits an odd number of the set's hashes fall on; from 64 bits to the least power of two that is no less than the set."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    at = ((s >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def prefixes(docs: DataFrame, heavy: np.ndarray, text: str, key: str, gram: int, percent: int) -> DataFrame:
    """doc_id, n, digests of set and prefix, the prefix's tokens, how many of them are light, and the parity map."""
    told = docs.sparkSession.sparkContext.broadcast(heavy)
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("light", pa.int32()), ("map", pa.binary())]

    def run(batches):
        last = told.value
        near = np.zeros(1 << 22, bool)
        near[(last >> np.uint64(42)).astype(np.int64)] = True
        for batch in sliced(batches, text):
            s, n = shingle_sets(batch.column(1), gram)
            late = near[(s >> np.uint64(42)).astype(np.int64)]
            at = np.flatnonzero(late)
            found = np.searchsorted(last, s[at])
            late[at] = last[np.minimum(found, max(len(last) - 1, 0))] == s[at] if len(last) else False
            out = []
            ends = np.cumsum(n).tolist()
            any_late = np.add.reduceat(np.append(late, False), np.minimum(np.cumsum(n) - n, len(late))) if len(n) else late
            for i, (doc, b, size, p) in enumerate(zip(batch.column(0).to_pylist(), ends, n.tolist(), _prefix_size(n, percent).tolist())):
                own = s[b - size : b]
                if size and any_late[i]:
                    h = late[b - size : b]
                    light = min(p, size - int(h.sum()))
                    first = np.concatenate([own[~h], own[h]])[:p]
                else:
                    light, first = p, own[:p]
                out.append((doc, size, *_digest(own.tobytes()), *_digest(first.tobytes()), first.view(np.int64), light, parity_map(own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [f for f, _ in fields])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, p1 long, p2 long, prefix array<bigint>, light int, map binary")


def shared_lists(groups: DataFrame, percent: int) -> DataFrame:
    """token, gid, pos of the prefix tokens at which two groups of fitting size meet, or (the first token) the members of one group."""

    def run(batches):
        carry = None
        for batch in batches:
            if carry is not None:
                batch = pa.concat_batches([carry, batch])
            token, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            # in rising size, a row fits none of its list if it does not fit the next and the one before
            fits = np.zeros(len(token) + 1, bool)
            fits[1:-1] = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = fits[1:] | fits[:-1] | batch.column(4).to_numpy(zero_copy_only=False)
            # the last row waits for the next batch, with one that it fits
            hold = 2 if len(token) > 1 and fits[-2] else 1
            done = len(token) - hold
            carry = batch.slice(done)
            yield batch.slice(0, done).filter(pa.array(keep[:done])).select(["token", "gid", "pos"])
        if carry is not None:
            token, n = carry.column(0).to_numpy(), carry.column(2).to_numpy()
            both = len(token) == 2 and token[0] == token[1] and 100 * n[0] >= percent * n[1]
            keep = np.full(len(token), both) | carry.column(4).to_numpy(zero_copy_only=False)
            yield carry.filter(pa.array(keep)).select(["token", "gid", "pos"])

    posted = groups.select("gid", "n", "light", "several", F.posexplode("prefix").alias("pos", "token"))
    few = posted.where("pos < light").select("token", "gid", "n", "pos", (F.col("several") & (F.col("pos") == 0)).alias("meet"))
    ordered = few.repartition(shuffle_width(groups.sparkSession), "token").sortWithinPartitions("token", "n", "gid")
    # the lists of heavy tokens are long: their rows stay, and stay where they are
    many = posted.where("pos >= light").select("token", "gid", "pos")
    return saved(ordered.mapInArrow(run, "token long, gid long, pos int").unionByName(many), "ngram-lists")


def _by_token(rows: DataFrame, small: DataFrame, own: str, how: str = "inner") -> DataFrame:
    """rows with the columns of small (one row for each token); a hot token's rows are dealt out by their column own."""
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["token", "salt"], how).drop("salt")


def differing(words: np.ndarray, first: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the maps of x and y differ; maps: words[first : first + size], y's as long as x's or longer, then folded."""
    out = np.zeros(len(x), np.int64)
    shapes = size[x] * 64 + size[y] // size[x]
    for shape in np.unique(shapes).tolist():
        at, w, folds = np.flatnonzero(shapes == shape), shape // 64, shape % 64
        step = max(1, 1_000_000 // w)
        for a in range(0, len(at), step):
            i = at[a : a + step]
            u = words[first[x[i]][:, None] + np.arange(w)]
            for k in range(folds):
                u ^= words[first[y[i]][:, None] + np.arange(k * w, (k + 1) * w)]
            out[i] = np.bitwise_count(u).sum(1)
    return out


CHAIN, NEAREST, ALL = range(3)
LISTED = ("token", "b1", "b2", "block", "n", "pos", "member", "comp", "map")


def list_pairs(rows: DataFrame, percent: int, kind: int) -> DataFrame:
    """a, b, apart: pairs of members of one list in different components that no bound rules out; rows have LISTED.

    CHAIN: for each member (a) the nearest one after it by size; NEAREST: for each
    two components (in ca, cb) the nearest pair, and whether there are several; ALL:
    all, each at the least token that both members have in these lists; rows then also
    have `tokens`, those of the member.
    """

    def repeated(x, y, token, tokens):
        """Which pairs have met at a lesser token; they meet in each list that holds both."""
        flat = pc.list_flatten(tokens).to_numpy()
        sizes = pc.list_value_length(tokens).to_numpy()
        names, codes = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        earlier = flat < token[row]
        own = np.sort(row[earlier] * len(names) + codes[earlier])
        ends = np.searchsorted(own, np.arange(len(sizes) + 1) * len(names))
        out = np.zeros(len(x), bool)
        for a in range(0, len(x), 50_000):
            i, j = x[a : a + 50_000], y[a : a + 50_000]
            n = ends[i + 1] - ends[i]
            at = np.repeat(ends[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pair = np.repeat(np.arange(len(i)), n)
            want = own[at] % len(names) + j[pair] * len(names)
            place = np.minimum(np.searchsorted(own, want), max(len(own) - 1, 0))
            out[a + pair[own[place] == want]] = True
        return out

    def bounded(x, y, n, pos, comp, block, cell, maps):
        ok = (comp[x] != comp[y]) & (100 * n[x] >= percent * n[y]) & (cell[x] | (block[x] != block[y]))
        x, y = x[ok], y[ok]
        need = -(-percent * (n[x] + n[y]) // (100 + percent))
        ok = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        apart = differing(*maps, x, y)
        ok = apart <= n[x] + n[y] - 2 * need
        return x[ok], y[ok], apart[ok]

    def least(x, y, apart, comp):
        """The pairs that stay of those of one kind, and whether others of the same two went."""
        if kind == ALL or not len(x):
            return x, y, apart, np.zeros(len(x), bool)
        one = x if kind == CHAIN else np.minimum(comp[x], comp[y])
        two = one if kind == CHAIN else np.maximum(comp[x], comp[y])
        order = np.lexsort((-y, x, apart, two, one))  # ties go to the last one: then many choose the same
        first = np.ones(len(order), bool)
        first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        return x[order][first], y[order][first], apart[order][first], np.diff(np.append(np.flatnonzero(first), len(order))) > 1

    def long_pairs(low, high, n, comp):
        """Rows (x, y) of one long list, in pieces: all but pairs inside its largest component and of unlike sizes."""
        _, of, count = np.unique(comp[low:high], return_inverse=True, return_counts=True)
        inside = of == count.argmax()
        seek = np.flatnonzero(~inside) + low
        step = max(1, 1_000_000 // (high - low))
        for a in range(0, len(seek), step):
            i = seek[a : a + step]
            # in rising size; those inside are met on both sides, the others once
            first = low + int(np.searchsorted(n[low:high], -(-percent * n[i[0]] // 100)))
            last = low + int(np.searchsorted(n[low:high], n[i[-1]] * 100 // percent, "right"))
            j = np.arange(first, last)
            x, y = i.repeat(len(j)), np.tile(j, len(i))
            once = (y > x) | (inside[y - low] & (y != x))
            x, y = x[once], y[once]
            yield np.minimum(x, y), np.maximum(x, y)

    def pairs(group):
        b1, b2, block, n, pos, member, comp = (group.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in LISTED[1:-1])
        token = group.column("token").to_numpy(zero_copy_only=False)
        raw = group.column("map").cast(pa.large_binary()).combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 8
        maps = np.frombuffer(raw.buffers()[2], np.uint64), edges[:-1], np.diff(edges)
        head = np.concatenate([[True], (token[1:] != token[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])
        of = np.cumsum(head) - 1
        sizes = np.bincount(of)
        rest = n, pos, comp, block, b1 == b2, maps
        found = []
        small = sizes[of] <= SMALL
        for d in range(1, min(SMALL, int(sizes.max()))):
            x = np.flatnonzero(small[:-d] & (of[d:] == of[:-d]))
            if not len(x):
                break
            x, y, apart = bounded(x, x + d, *rest)
            found.append((x, y, apart, np.zeros(len(x), bool)))
        starts = np.flatnonzero(head)
        for k in np.flatnonzero(sizes > SMALL).tolist():
            for x, y in long_pairs(int(starts[k]), int(starts[k] + sizes[k]), n, comp):
                found.append(least(*bounded(x, y, *rest), comp))
        if not found:
            return
        x, y, apart, went = (np.concatenate(c) for c in zip(*found))
        if kind == ALL and len(x):
            fresh = ~repeated(x, y, token, group.column("tokens").combine_chunks())
            x, y, apart, went = x[fresh], y[fresh], apart[fresh], went[fresh]
        again = {(i, j) for i, j in zip(comp[x[went]].tolist(), comp[y[went]].tolist())}
        x, y, apart, several = least(x, y, apart, comp)
        if again:
            several |= np.array([(i, j) in again or (j, i) in again for i, j in zip(comp[x].tolist(), comp[y].tolist())], bool)
        if len(x):
            a, b = (member[x], member[y]) if kind == CHAIN else (np.minimum(member[x], member[y]), np.maximum(member[x], member[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart), pa.array(np.minimum(comp[x], comp[y])), pa.array(np.maximum(comp[x], comp[y])), pa.array(several)], ["a", "b", "apart", "ca", "cb", "several"])

    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            token, b1, b2 = (table.column(c).to_numpy() for c in ("token", "b1", "b2"))
            # only the last list, or pair of blocks, waits for the next batch
            other = np.flatnonzero((token != token[-1:]) | (b1 != b1[-1:]) | (b2 != b2[-1:]))
            last = int(other[-1]) + 1 if len(other) else 0
            carry = table.slice(last)
            if last:
                yield from pairs(table.slice(0, last))
        if carry is not None and carry.num_rows:
            yield from pairs(carry)

    ordered = rows.repartition(shuffle_width(rows.sparkSession), "token", "b1", "b2").sortWithinPartitions("token", "b1", "b2", "n", "member")
    return ordered.select(*LISTED, *(["tokens"] if kind == ALL else [])).mapInArrow(run, "a long, b long, apart long, ca long, cb long, several boolean").where("a <> b")


def member_sets(docs: DataFrame, pairs: DataFrame, text: str, key: str, gram: int) -> DataFrame:
    """member and set (uint64, binary) of the members of pairs, saved; a Bloom filter leaves out the texts of most other documents."""
    told = bloom_filter(pairs.select(F.explode(F.array("a", "b")).alias("member")), *bloom_places("member"), rows=2 * pairs.count())
    bloom = docs.sparkSession.sparkContext.broadcast(told)

    def run(batches):
        for batch in batches:
            hit = bloom_hits(bloom.value, *(batch.column(i).to_numpy() for i in (2, 3)))
            for part in sliced([batch.filter(pa.array(hit))], "text"):
                s, n = shingle_sets(part.column(1), gram)
                ends = np.cumsum(n).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[b - k : b].tobytes() for b, k in zip(ends, n.tolist())], pa.binary())], ["member", "set"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").select("doc_id", "text", *bloom_places("doc_id"))
    return saved(slim.mapInArrow(run, "member long, set binary"), "ngram-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([u, v]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * same >= percent * (len(u) + len(v) - same))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    # one way to join at any size: the pairs may be few, the sets are long
    one = pairs.hint("merge").join(sets.select(F.col("member").alias("a"), F.col("set").alias("sa")), "a")
    two = one.hint("merge").join(sets.select(F.col("member").alias("b"), F.col("set").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def chain_rows(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the lists of each group's first SEEDS tokens, long lists dealt out in chunks."""
    first = lists.withColumn("at", F.row_number().over(Window.partitionBy("gid").orderBy("token"))).where(F.col("at") <= SEEDS).drop("at")
    rows = first.join(members.hint("merge"), "gid")
    held = first.join(members.groupBy("gid").agg(F.count(F.lit(1)).alias("held")).hint("merge"), "gid").groupBy("token").agg(F.sum("held").alias("held"))
    long = held.where(F.col("held") > CHUNK).select("token", F.ceil(F.col("held") / CHUNK).cast("int").alias("chunks"))
    chunk = F.coalesce(F.pmod(F.xxhash64("member", "token"), F.col("chunks")), F.lit(0)).cast("int")
    dealt = _by_token(rows, long, "member", "left").withColumn("b1", chunk)
    return dealt.select("token", "b1", F.col("b1").alias("b2"), F.col("b1").alias("block"), "n", "pos", "member", F.col("member").alias("comp"), "map")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with comp, their component's label or themselves; found: node, label."""
    named = found.select(F.col("node").alias("member"), "label").hint("merge")
    return members.join(named, "member", "left").withColumn("comp", F.coalesce("label", "member")).drop("label")


def mixed_lists(lists: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """token, gid, pos and member of the lists that hold several components; saved."""
    slim = _labelled(members.select("gid", "member"), found)
    ends = slim.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = lists.join(ends.hint("merge"), "gid").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("token")
    kept = _by_token(lists, mixed, "gid")
    return saved(kept.join(members.select("gid", "member").hint("merge"), "gid").select("token", "gid", "pos", "member"), "ngram-mixed")


def placed(mixed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the lists with their components, and of each list with several: how many members and components, and the largest one."""
    listed = _labelled(mixed, found)
    per = listed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("held"), F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    return listed, saved(per.where("kinds > 1"), "ngram-cuts")


def head_rows(listed: DataFrame, cut: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of one member of each component in the lists of cut, dealt out in chunks."""
    heads = _by_token(listed, cut.select("token", F.ceil(F.col("kinds") / CHUNK).cast("int").alias("chunks")), "member").groupBy("token", "comp").agg(F.min(F.struct("member", "gid", "pos", "chunks")).alias("h")).select("token", "comp", "h.*")
    dealt = heads.withColumn("b1", F.pmod(F.xxhash64("member", "token"), F.col("chunks")).cast("int")).withColumns({"b2": F.col("b1"), "block": F.col("b1")})
    return dealt.join(members.hint("merge"), ["gid", "member"]).select(*LISTED)


def cross_rows(listed: DataFrame, cut: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the lists of cut, long ones cut into pairs of blocks."""
    long = F.col("held") > BLOCK
    tops = F.when(long, F.ceil(F.col("top.k") / BLOCK)).otherwise(1).cast("int")
    others = F.when(long, F.ceil((F.col("held") - F.col("top.k")) / BLOCK)).otherwise(0).cast("int")
    rows = _by_token(listed, cut.select("token", F.col("top.comp").alias("top"), tops.alias("tops"), others.alias("others")), "member").withColumn("is_top", (F.col("comp") == F.col("top")) & (F.col("others") > 0))
    own = F.when(F.col("others") == 0, F.lit(0)).when(F.col("is_top"), F.pmod(F.xxhash64("member"), F.col("tops"))).otherwise(F.col("tops") + F.pmod(F.xxhash64("member"), F.col("others"))).cast("int")
    meets = F.when(F.col("others") == 0, F.array(F.lit(0))).when(F.col("is_top"), F.sequence(F.col("tops"), F.col("tops") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("tops") + F.col("others") - 1))
    rows = rows.withColumn("block", own).withColumn("o", F.explode(meets)).select("token", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"), "block", "pos", "gid", "member", "comp")
    return rows.join(members.hint("merge"), ["gid", "member"]).select(*LISTED)


def text_key(docs: DataFrame, text: str = "text", low: int = -(2**63)) -> Column:
    """A long, `low` or more, for each text of docs: different texts have different ones, null as empty.

    Texts are told apart by their 128-bit digests. Of two texts with one hash (n texts have
    some n²/2^65 such pairs: 3 for 10^10 texts, 270 for 10^11) one is hashed anew, until all differ.
    """
    digest, moved = F.md5(F.coalesce(F.col(text), F.lit(""))), {}
    while True:
        salt = F.lit(0)
        if moved:
            salt = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in moved.items() for x in pair]), digest), salt)
        hashed = F.xxhash64(salt, F.coalesce(F.col(text), F.lit("")))
        key = hashed if low == -(2**63) else F.lit(low) + F.pmod(hashed, F.lit(2**63 - low))
        told = docs.select(key.alias("k"), digest.alias("d")).groupBy("k").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b")
        met = [r.b for r in told.select("b").collect()]
        if not met:
            return key
        for d in met:
            moved[d] = moved.get(d, 0) + 1


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    unnamed = docs.where("doc_id IS NULL AND text IS NOT NULL")
    if unnamed.isEmpty():
        return _groups(docs, "text", "doc_id", gram, percent)
    # numbers above all doc_ids: a component's least number is a doc_id if it has one
    if (docs.agg(F.max("doc_id")).first()[0] or 0) >= NO_ID:
        raise ValueError("doc_ids of 2^62 and more leave no numbers for rows without one")
    named = docs.withColumn("doc_id", F.coalesce("doc_id", F.when(F.col("text").isNotNull(), text_key(unnamed, "text", NO_ID))))
    real = [F.when(F.col(c) < NO_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id")]
    return _groups(named, "text", "doc_id", gram, percent).select(real[0], "n_shingles", real[1])


def _groups(docs: DataFrame, text: str, key: str, gram: int, percent: int) -> DataFrame:
    heavy = heavy_tokens(token_counts(docs, text, gram, percent, HEAVY_DOCS), HEAVY_DOCS, MOST_HEAVY)
    every = saved(prefixes(docs, heavy, text, key, gram, percent), "ngram-prefixes")
    full = every.where("n > 0 AND doc_id IS NOT NULL").withColumn("gid", F.xxhash64("p1", "p2", "n"))
    # documents with one set: the least doc_id stands for them
    classes = saved(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("member"), *(F.first(c).alias(c) for c in ("gid", "n", "map"))), "ngram-classes")
    several = (F.min("k1") < F.max("k1")) | (F.min("k2") < F.max("k2"))
    groups = full.groupBy("gid", "p1", "p2", "n").agg(several.alias("several"), F.first("prefix").alias("prefix"), F.first("light").alias("light"))
    lists = shared_lists(groups, percent)
    members = saved(classes.select("gid", "member", "n", "map").join(lists.select("gid").distinct(), "gid", "left_semi"), "ngram-members")

    def joined(found: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        """The components after those of pairs that are links are joined; None if none is."""
        pairs = saved(pairs.select("a", "b").distinct(), "ngram-pairs")
        if pairs.isEmpty():
            return None
        links = saved(verified(pairs, member_sets(docs, pairs, text, key, gram), percent), "ngram-links")
        if links.isEmpty():
            return None
        # the components found stand for their links
        return saved(components(links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b")))), "ngram-components")

    nearest = F.min_by("b", F.struct("apart", -F.col("b"))).alias("b")
    found = joined(None, list_pairs(chain_rows(lists, members), percent, CHAIN).groupBy("a").agg(nearest))
    if found is None:
        found = docs.sparkSession.createDataFrame([], "node long, label long")
    mixed = mixed_lists(lists, members, found)
    listed, cut = placed(mixed, found)
    held = math.inf
    while True:
        # as long as it at least halves the components in long lists; what is left is found below
        long = cut.where(F.col("held") > CHUNK)
        before, held = held, long.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
        if not held or held > before / 2 or (more := joined(found, list_pairs(head_rows(listed, long, members), percent, CHAIN).groupBy("a").agg(nearest))) is None:
            break
        found = more
        listed, cut = placed(mixed, found)
    pair = F.struct("apart", "a", "b")
    pairs = saved(list_pairs(cross_rows(listed, cut, members), percent, NEAREST).groupBy("ca", "cb").agg(F.min(pair).alias("p"), (F.bool_or("several") | (F.min(F.struct("a", "b")) < F.max(F.struct("a", "b")))).alias("several")), "ngram-nearest")
    more = joined(found, pairs.select("p.a", "p.b"))
    # two components with several pairs that are still apart: all of their pairs are tried
    ends = (found if more is None else more).select(F.col("node").alias("c"), "label")
    for c in ("ca", "cb"):
        pairs = pairs.join(ends.select(F.col("c").alias(c), F.col("label").alias(f"l{c}")).hint("merge"), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    open_ = saved(pairs.where("several AND lca <> lcb").select(F.explode(F.array("ca", "cb")).alias("comp")).distinct(), "ngram-open")
    if not open_.isEmpty():
        left = listed.join(open_.hint("merge"), "comp", "left_semi").select("token", "gid", "pos", "member")
        found = more or found
        left = saved(left, "ngram-left")
        # no more than a member's prefix has
        tokens = left.groupBy("member").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
        rows = cross_rows(*placed(left, found), members).join(tokens.hint("merge"), "member")
        more = joined(found, list_pairs(rows, percent, ALL))
    found = more or found
    named = classes.select("k1", "k2", "member").join(found.select(F.col("node").alias("member"), "label"), "member", "left").select("k1", "k2", F.coalesce("label", "member").alias("component_id"))
    return every.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
