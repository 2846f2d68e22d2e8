"""Ranked search against plain Python: ties, nulls, repeats, several shards and blocks, and blocks that are never unpacked."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairfield.llm import ranked as module
from pairfield.llm.ranked import Shard, packed, ranked, unpacked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_force(docs, items, top=20):
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    n_docs, n_terms = len(split), sum(n for _, _, n in split)
    df, out = Counter(t for _, c, _ in split for t in c), []
    for item, text in {x for x in items if x[1] is not None}:
        found = []
        for i, c, n in split:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 4))) for _ in range(90)]
    weights = [1 / (i + 1) for i in range(90)]
    said = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, said(rng.randint(1, 40))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # copies: ties
    docs += [docs[5]] * 4 + [(None, docs[3][1]), (None, docs[7][1]), (7, None), (8, ""), (9, " .,;\n"), (10, "\x00A\x01a__É-é" * 3), (11, said(30_000)), (12, "X" * 50_000)]
    items = [(i, said(rng.randint(1, 30)).upper()) for i in range(12)] + [(20, None), (21, ""), (22, "unheard of"), (23, "a a a a " + said(9)), (3, "é É 1"), (24, docs[3][1])]
    return docs, items + items[:2]


@pytest.mark.parametrize("shard, item_bytes", [(1_000_000, 4_000_000), (200, 300)])
def test_against_brute_force(spark, monkeypatch, shard, item_bytes):
    monkeypatch.setattr(module, "SHARD_POSTINGS", shard)
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = ranked(df, asked, item_bytes=item_bytes)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_force(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert ranked(docs.where("false"), items).count() == 0 and ranked(docs, items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in ranked(docs, items).collect()] == [("i", 1, 1)]


def test_blocks_survive_packing():
    rng = np.random.default_rng(1)
    for top in (3, 300, 10**6):
        slots = np.unique(rng.integers(0, top, 1000))
        tfs = rng.integers(1, 70_000, len(slots))
        heads, data = packed(slots, tfs, tfs)
        heads, start, before, got = np.frombuffer(heads, np.int64).reshape(-1, 3), 0, -1, []
        for last, most, end in heads.tolist():
            s, t = unpacked(data[start:end], before)
            assert s[-1] == last and t.max() == most
            got.append((s, t))
            start, before = end, last
        assert np.array_equal(np.concatenate([s for s, _ in got]), slots) and np.array_equal(np.concatenate([t for _, t in got]), tfs)


def test_blocks_without_candidates_stay_packed(spark):
    """A rare term fills the heap; the blocks of a frequent one are then opened for few documents."""
    import pyarrow as pa

    n = 50_000
    m = np.full(n, 100)
    rare = np.arange(0, 2000, 100)
    rows = [(-1, np.arange(n).tobytes(), m.tobytes() + np.zeros(n, bool).tobytes())]
    for code, slots in ((0, np.arange(n)), (1, rare)):
        tfs = np.ones(len(slots), np.int64) + (code == 1) * 3
        rows.append((code, *packed(slots, tfs, module.impact(tfs, m[slots]))))
    shard = Shard(pa.table({k: pa.array(v, t) for k, v, t in zip(("code", "heads", "data"), zip(*rows), (pa.int32(), pa.binary(), pa.binary()))}))
    hits = module.Hits(20)
    bounds = np.array([5 * module.impact(np.int64(1), np.int64(100)), 500 * module.impact(np.int64(4), np.int64(100))])
    module.search(shard, np.array([0, 1]), np.array([5, 500]), bounds, hits, window=2048)
    assert sorted(hits.ids.tolist()) == rare.tolist()
    assert sum(c == 0 for c, _ in shard.blocks) <= 16 < len(shard.lists[0][0]) / 10
