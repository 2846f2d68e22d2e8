"""Prefix tries against plain Python: bursts, long chains, copies, ties, nulls and conversations without turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pairfield.llm.prefix_trie import NODE, prefix_trie, rebuilt, sweep

SCHEMA = "conv_id long, turn long, role string, text string, depth int, head string"


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    ways = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        start = c - (c % 5 if c >= 0 else -(-c % 5))
        ways[c] = own.get(start, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, w in ways.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    kids = defaultdict(list)
    for way in members:
        if way:
            kids[way[:-1]].append(way)
    leaves, saved = {}, {}
    for way in sorted(members, key=len, reverse=True):
        leaves[way] = sum(leaves[k] for k in kids[way]) or 1
        saved[way] = (len(members[way]) - 1) * (len(way[-1][1].encode()) if way else 0) + sum(saved[k] for k in kids[way])
    out = []
    for way, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(ways[c]) == len(way))))
        out.append((min(own), len(way), min(members[way[:-1]]) if way else None, len(own), len(kids[way]), leaves[way], saved[way], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations():
    rng = random.Random(9)
    turns = [("user", "hi"), ("assistant", "hi"), ("user", None), (None, "what é 日本?"), ("user", "go on"), ("", "")]
    rows = []
    for c in range(60):
        rows += [(c, i, *rng.choice(turns[: 2 + c % 5])) for i in range(rng.randint(1, 12))]
    long = [(i, "user", f"turn {rng.randint(0, 3)}") for i in range(200)]
    for c in (100, 105, 110, 115):  # long copies, one a prefix, one that leaves at the end
        rows += [(c, *t) for t in long[: 150 if c == 110 else 200]]
    rows += [(115, 200, "user", "more")]
    for c in range(200, 260, 5):  # a crowd of copies
        rows += [(c, 0, "system", "same"), (c, 1, "user", "same"), (c, 2, "user", "same")]
    rows += [(400, 7, "user", "tie"), (400, 7, "user", "eit"), (400, None, "user", "first"), (400, 7, "user", "tie"), (-3, 0, "user", "hi"), (-7, 1, "user", "hi"), (-5, 0, "user", "hi"), (None, 0, "user", "hi")]
    rows += [(900, i, "user", f"line {i % 7}") for i in range(3_000)]  # a long one alone, over several ranges
    rows += [(c, 0, "user", "own only") for c in range(1001, 1040)]  # absent neighbours: many without a turn
    return rows


@pytest.mark.parametrize("container", [1, 40, 400, 100_000])
def test_against_brute_force(spark, container):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    got = prefix_trie(df, container)
    assert got.columns == [x.split()[0] for x in NODE.split(", ")] and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows)


def test_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", 1, "x"), (None, 0, "user", "hi", 1, "x")], SCHEMA)
    assert prefix_trie(df.where("false")).count() == 0 and prefix_trie(df.where("conv_id IS NULL")).count() == 0
    assert sorted(tuple(r) for r in prefix_trie(df).collect()) == brute_force([(1, 0, "user", "hi")])


def test_long_conversations_lie_in_segments(spark):
    rows = [(5, i, "user", str(i)) for i in range(1_000)] + [(6, i, "user", "x") for i in range(10)]
    convs, segs = rebuilt(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(9))
    assert {r.conv_id: r.n for r in convs.collect()} == {5: 1_000, 6: 10}
    sizes = {(r.conv_id, r.seg): len(r.ids) for r in segs.collect()}
    assert max(sizes.values()) == 64 and sum(sizes.values()) == 1_010


def test_sweep_gives_the_least_member():
    rows, head = sweep([([b"a", b"b"], [1, 2], 9), ([b"a"], [1], 7), ([b"c"], [5], 3), ([], [], 4)], 2, 10)
    assert head == (3, 2, None, 4, 2, 2, 3 * 10 + 1, [4])
    assert sorted(rows) == [(3, 3, 3, 1, 0, 1, 0, [3]), (7, 3, 3, 2, 1, 1, 1, [7]), (9, 4, 7, 1, 0, 1, 0, [9])]
