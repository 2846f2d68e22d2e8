"""The registered queries themselves on the smallest tables: against their SQL, or against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pairfield.llm.common import vocabulary
from pairfield.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))


def got(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine, want = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    columns = sorted(mine.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    mine = sorted((tuple(r[c] for c in columns) for r in mine.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
    assert mine == want


def test_bpe(spark, rows):
    from tokenizers import Tokenizer

    tk, mine = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), got(spark, "op2_bpe")
    tk.no_truncation()
    tk.no_padding()
    for i, t, _ in rows:
        ids = tk.encode(t, add_special_tokens=False).ids
        want = tk.decode(ids, skip_special_tokens=False)
        assert (mine[i].n_tokens, mine[i].ids_sha256, mine[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(want.encode()).hexdigest())


def test_suffix_dedup(spark, rows):
    data = {i: t.encode() for i, t, _ in rows}
    mine = got(spark, "op3_suffix_dedup")
    count = Counter(d[j : j + 400] for d in data.values() for j in range(len(d) - 399))
    for i, d in data.items():
        gone = bytearray(len(d))
        for j in range(len(d) - 399):
            if count[d[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        assert (mine[i].n_bytes, mine[i].n_removed, mine[i].n_spans) == (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert mine[i].kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()


def test_mixing(spark, rows):
    mine = got(spark, "op4_mixing")
    sizes = {i: len(WORD.findall(t)) for i, t, _ in rows}
    source, taken = Counter(), Counter()
    for i, _, s in rows:
        source[s] += sizes[i]
        taken[s] += mine[i].taken
    order = sorted((s for s in source if s is not None)) + [None] * (None in source)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(source.values())
    while True:
        level = (total - sum(3 * source[s] for s in capped)) / max(sum(w for s, w in weight.items() if s not in capped), 1)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * source[s]}
        if not over:
            break
        capped |= over
    for i, _, s in rows:
        r = mine[i]
        target = 3 * source[s] if s in capped else level * weight[s]
        assert r.size == sizes[i] and r.source_size == source[s] and math.isclose(r.target, target, rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
    for s in order:
        mean = source[s] / sum(x == s for _, _, x in rows)
        assert abs(taken[s] - (3 * source[s] if s in capped else level * weight[s])) <= max(0.02 * taken[s], mean)
    # the rates solve the dual: exp(lambda * size), cut at 3, with one lambda a source, found here by bisection
    for s in order:
        own = [(sizes[i], mine[i].rate) for i, _, x in rows if x == s and sizes[i]]
        want = min(3 * source[s], level * weight[s]) if s not in capped else 3 * source[s]
        low, high = -50.0, 50.0
        mean = source[s] / max(len(own), 1)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(3.0, math.exp(min(mid * n / mean, 5))) for n, _ in own) < want else (low, mid)
        assert s in capped or all(abs(rate - min(3.0, math.exp(min(low * n / mean, 5)))) < 1e-4 for n, rate in own)


def test_fingerprints(spark, rows):
    import xxhash

    mine = got(spark, "op6_fingerprints")

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    def fingerprint(text):
        w, found = WORD.findall(text), []
        for i in range(max(len(w) - 4, min(len(w), 1))):
            seed = 42
            for x in w[i : i + 5]:
                seed = xxhash.xxh64(x.encode(), seed=seed).intdigest()
            found.append((seed >> 24, -i))
        chosen = []
        for i in range(max(len(found) - 7, min(len(found), 1))):
            least = min(found[i : i + 8])
            if least not in chosen[-1:]:
                chosen.append(least)
        return chosen

    def likeness(a, b):
        x, y = {h for h, _ in a}, {h for h, _ in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for k, (i, t, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        r = mine[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ",".join(f"{h:X}@{-p}" for h, p in a) and r.edited_fingerprint == ",".join(f"{h:X}@{-p}" for h, p in b)
        assert math.isclose(r.near_edited, likeness(a, b)) and math.isclose(r.near_next, likeness(a, c))


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    tk, mine, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), got(spark, "op9_binary_tokens"), 0
    tk.no_truncation()
    tk.no_padding()
    for i, t, _ in rows:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        assert (mine[i].start, mine[i].n_tokens, mine[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tk.encode_special_tokens = True
    counts = got(spark, "op10_token_counts")
    assert all(counts[i].n_tokens == len(tk.encode(t, add_special_tokens=False).ids) for i, t, _ in rows)


def test_surrogates(spark, rows):
    mine = got(spark, "op8_pii_surrogates")
    for i, t, _ in rows:
        assert (mine[i].text == t) == (mine[i].n_entities == 0)
        mails = set(re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", t))
        assert not any(m in mine[i].text for m in mails)


def test_substring_dedup(spark, rows):
    from pairfield.llm.substring import LEAST_RUN, cuts

    mine, seen = got(spark, "op1_substring_dedup"), set()
    for i, t, _ in rows:
        data = t.encode()
        ends = cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist() if data else []
        runs, repeated = [], 0
        for a, b in zip([0, *ends], ends):
            if data[a:b] in seen:
                repeated += b - a
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(data[a:b])
        runs = [x for x in runs if x[1] - x[0] >= LEAST_RUN]
        assert (mine[i].n_removed, mine[i].n_spans, mine[i].n_repeated) == (sum(b - a for a, b in runs), len(runs), repeated)
