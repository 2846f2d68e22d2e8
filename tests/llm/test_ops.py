"""Each operator against a brute-force version on a small hostile table: nulls, empty texts, ties, copies, long texts, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfield.llm import suffix
from pairfield.llm.common import bloom_filter, vocabulary, word_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 7))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "one", "Two words.", "a" * 2000, "x " * 900, "日本語のテキスト。" * 60, "naïve café <|endoftext|> it's " * 30]
    base = [prose(rng, rng.randint(20, 220)) for _ in range(14)]
    passage = prose(rng, 110)
    texts += base + base[:3]  # exact copies
    texts += [b + " tail." for b in base[3:6]]  # near copies
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}" for _ in range(4)]
    for size in (280, 299, 300, 301, 399, 400, 401, 640):  # shared passages near the lengths of repeats, in two orders
        said = prose(rng, 200)[:size].strip()
        texts += [f"{prose(rng, 20)} {said}{prose(rng, 9)}", f"{said}{prose(rng, 30)}", f"{prose(rng, 60)}{said[: size * 9 // 10]}"]
    texts += [prose(rng, 6000)]
    return list(enumerate(texts))


DOCS = corpus()
KEY = b"a key of the tests"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in DOCS]
    df = spark.createDataFrame(rows + rows[9:11], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"n_removed": F.lit("x"), "count": F.lit(1), "kind": F.lit("y")}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


REPEATED = [*DOCS, *DOCS[9:11]]


def test_substring_dedup(docs, empty):
    from pairfield.llm.substring import dedup

    from pairfield.llm.substring import LEAST_RUN, cuts

    rows = dedup(docs).collect()
    assert len(rows) == len(REPEATED)
    seen, want = set(), {}
    for i, t in DOCS:
        data = (t or "").encode()
        ends = cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist() if data else []
        runs = []
        for a, b in zip([0, *ends], ends):
            if data[a:b] in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(data[a:b])
        runs = [x for x in runs if x[1] - x[0] >= LEAST_RUN]
        edges = [0, *(e for x in runs for e in x), len(data)]
        want[i] = ("".join(data[a:b].decode() for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in runs))
    assert all(((r.clean_text or ""), r.n_removed) == want[r.doc_id] for r in rows)
    # a copy goes, a passage shared by four texts stays in the first one only, texts of their own stay
    assert want[23][1] > 0.9 * len(DOCS[23][1]) and want[9][1] == 0 and want[29][1] == 0 and all(want[i][1] > 300 for i in (30, 31, 32))
    assert dedup(empty).count() == 0


def test_substring_dedup_resists_insertions(spark):
    from pairfield.llm.substring import dedup

    rng = random.Random(7)
    base = prose(rng, 1500)
    rows = [(0, base), (1, "An insertion. " + base), (2, base[:3001] + " and one more here " + base[3001:]), (3, base[:2000] + base[2100:]), (4, prose(rng, 800))]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed > len(rows[i][1]) - 800 for i in (1, 2, 3)) and got[4].n_removed == 0
    # a passage of 51 words is met in whatever surroundings
    said = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(51))
    rows = [(i, f"{prose(rng, 40 + i)} {said} {prose(rng, 40)}") for i in range(40)]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()
    assert sum(r.n_removed > 100 for r in got) >= 38 and all(r.n_removed == r.n_repeated for r in got)


def test_bpe_agrees_with_the_library(docs, empty):
    from tokenizers import Tokenizer

    from pairfield.llm.bpe import encode

    path = vocabulary("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rows = encode(docs, path).collect()
    assert len(rows) == len(REPEATED)
    for r in rows:
        ids = tk.encode(DOCS[r.doc_id][1] or "", add_special_tokens=False).ids
        want = tk.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(want.encode()).hexdigest()), r.doc_id
    assert encode(empty, path).count() == 0


def test_bpe_shuffles_ids_once(spark):
    """Pieces of one text, copied over many partitions, meet as a set; no shuffle before that one carries them."""
    from pairfield.llm.bpe import coder, digests, encode

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(8)
    line = prose(rng, 900)
    texts = [f"{prose(rng, 300)} {line} {prose(rng, 300)}" for _ in range(3)] * 20
    got = encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12), path)
    assert not re.search(r"hashpartitioning\(k1#\d+L, k2#\d+L, place#\d+, \d+\)", got._jdf.queryExecution().executedPlan().toString())
    enc = coder(path)
    want = {i: digests(enc.whole.encode(t, add_special_tokens=False).ids, enc) for i, t in enumerate(texts)}
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(texts)


def test_bpe_joins_are_repaired():
    from pairfield.llm.bpe import coder, joined

    enc = coder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(4)
    for text in ("hello there  my   friend's house\n\n 12345 it's", "日本語のテキスト", "aaaaaaaaaaaaaaaa bbbb", "x" + " " * 50 + "y<|endoftext|>z"):
        data = text.encode()
        for _ in range(30):
            cuts = sorted({0, len(data), *(c for c in (rng.randint(0, len(data)) for _ in range(3)) if c == len(data) or data[c] & 0xC0 != 0x80)})
            parts = [np.array(enc.encode(data[a:b]), np.uint16) for a, b in zip(cuts, cuts[1:])]
            ids, whole = joined(parts, enc)
            assert whole == data and ids.tolist() == enc.encode(data), (text, cuts)


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for size, letters in ((20, "ab"), (60, "a"), (200, "abc"), (300, "ab")):
        for _ in range(100):
            text = np.array([ord(rng.choice(letters)) for _ in range(rng.randint(1, size))], np.uint16)
            assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    for text in ("ab" * 150 + "a", "a" * 400 + "b" + "a" * 400, "abaababaabaab" * 20):
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint16)
        assert suffix.suffix_array(codes) == sorted(range(len(text)), key=lambda i: text[i:])


def test_removal_of_repeats(docs, empty, monkeypatch):
    data = [(t or "").encode() for _, t in REPEATED]

    size, want = suffix.LENGTH, {}
    count = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    for i, t in DOCS:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for j in range(len(d) - size + 1):
            if count[d[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        want[i] = bytes(b for b, g in zip(d, gone) if not g), sum(gone)
    assert any(w[1] for w in want.values())
    for crowd, bits in ((2_000, None), (1, 64)):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        monkeypatch.setattr(suffix, "bloom_filter", partial(bloom_filter, bits=bits))
        rows = suffix.remove_repeats(docs).collect()
        assert len(rows) == len(REPEATED)
        assert all((bytes(r.kept), r.n_removed) == want[r.doc_id] for r in rows)
    assert suffix.remove_repeats(empty).count() == 0


def test_mixing_meets_targets(spark, empty):
    from pairfield.llm.mixing import mix

    rng = random.Random(2)
    rows = [(i, None if s == 4 else f"s{s}", rng.randint(0, 400)) for s in range(5) for i in range(s * 100, s * 100 + (300 if s == 0 else 60))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mix(df).collect()
    again = {(r.doc_id, r.source, r.size, r.copies) for r in mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source, r.size, r.copies) for r in got}
    total, weights = sum(r[2] for r in rows), [5, 2, 1, 5, 2]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s), key=str) + [None]
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[i] for i, s in enumerate(order) if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weights[i] / w for i, s in enumerate(order)}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 * total
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= 0.01 * target[s] + 5
    assert all(0 <= r.copies <= 3 for r in got)
    assert mix(empty.withColumn("size", F.size(word_array(F.col("text"))).cast("long"))).count() == 0


def test_jaccard_groups(docs, empty, monkeypatch):
    from pairfield.llm import ngram_join

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in DOCS:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    # few and many chunks, blocks and heavy tokens; a filter that lets all pass
    for block, chunk, least, bits in ((2_000, 512, 50, None), (2, 2, 2, 64), (2, 3, 3, None)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        monkeypatch.setattr(ngram_join, "HEAVY_DOCS", least)
        monkeypatch.setattr(ngram_join, "SMALL", block)
        monkeypatch.setattr(ngram_join, "bloom_filter", partial(bloom_filter, bits=bits))
        rows = ngram_join.jaccard_groups(docs).collect()
        assert len(rows) == len(REPEATED)
        assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)) for r in rows)
    assert ngram_join.jaccard_groups(empty).count() == 0


def test_jaccard_keeps_heavy_tokens_bounded(docs):
    from pairfield.llm import ngram_join

    counts = ngram_join.token_counts(docs, "text", 4, 85, 2)
    every, few = (ngram_join.heavy_tokens(counts, 2, most) for most in (1 << 20, 3))
    assert len(every) > 3 >= len(few) and set(few) <= set(every) and (np.diff(every.astype(object)) > 0).all()


def test_parity_maps_bound_the_difference():
    from pairfield.llm.ngram_join import differing, parity_map

    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 700, 1500):
        u = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for v in (u, u[: len(u) * 9 // 10 + 1], np.unique(np.concatenate([u, rng.integers(0, 2**63, n // 5).astype(np.uint64)]))):
            x, y = sorted((u, v), key=len)
            maps = [parity_map(x), parity_map(y)]
            size = np.array([len(m) // 8 for m in maps])
            words = np.frombuffer(b"".join(maps), np.uint64)
            apart = int(differing(words, np.cumsum(size) - size, size, np.array([0]), np.array([1]))[0])
            assert apart <= len(np.setxor1d(u, v)) and (apart == 0) == (len(np.setxor1d(u, v)) == 0)


def test_jaccard_of_one_large_cluster(spark, monkeypatch):
    """20,000 near copies and texts that share only a passage with them: one component, few pairs, no long list in one task."""
    from pairfield.llm import ngram_join

    most, pairs, real = [], [], ngram_join.list_pairs

    def seen(rows, percent, kind):
        rows = ngram_join.saved(rows, "rows")
        most.append(rows.groupBy("token", "b1", "b2").count().agg(F.max("count")).first()[0] or 0)
        out = ngram_join.saved(real(rows, percent, kind), "pairs")
        pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "list_pairs", seen)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(words)), F.lit(" last"), F.col("id").cast("string")).alias("text"))
    other = [(20_000 + i, " ".join([*words[:40], *(f"v{rng.randrange(10**6)}" for _ in range(80))])) for i in range(300)]
    got = ngram_join.jaccard_groups(near.unionByName(spark.createDataFrame(other, "doc_id long, text string")).repartition(5)).collect()
    label = {r.doc_id: r.component_id for r in got}
    assert len(got) == 20_300 and all(label[i] == (0 if i < 20_000 else i) for i in label)
    assert max(most) <= 3 * ngram_join.BLOCK and max(pairs) <= 5 * 20_300


def test_components_of_a_path(spark):
    from pairfield.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(5, 5)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 0 if i <= 30 else 31) for i in range(61)}


def test_winnowing_guarantee(docs, empty):
    from pairfield.llm.winnowing import GRAM, WINDOW, chosen, half_replaced, hashes, with_next

    rows = {r.doc_id: r for r in with_next(docs).withColumn("edited", half_replaced(F.col("text"), F.col("next_text"))).select("*", hashes(chosen(F.col("text"))).alias("h"), hashes(chosen(F.col("edited"))).alias("e")).collect()}
    seen = {}
    for i, t in DOCS:
        r = rows[i]
        assert seen.setdefault(t or "", set(r.h)) == set(r.h)  # equal texts, equal fingerprints
        after = REPEATED_NEXT[i] or ""
        own = t or ""
        half = len(own) // 2
        if i not in (9, 10):
            assert r.edited == own[: len(own) - half] + after[:half]
        shared = WORD.findall(r.edited[: len(own) - half])
        if len(shared) > GRAM + WINDOW:
            assert set(r.h) & set(r.e)
    assert with_next(empty).count() == 0


REPEATED_NEXT = {i: DOCS[(i + 1) % len(DOCS)][1] for i, _ in DOCS}


def test_quality_counts(docs, empty):
    from pairfield.llm.quality import judge

    for r in judge(docs).collect():
        t = DOCS[r.doc_id][1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        count, covered = Counter(grams), set()
        for j, g in enumerate(grams):
            if count[g] > 1:
                covered.update((j, j + 1, j + 2))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert judge(empty).count() == 0


def test_quality_counts_do_not_depend_on_the_way(docs, monkeypatch):
    from pairfield.llm import quality

    want = {r.doc_id: r.n_repeat_words for r in quality.judge(docs).collect()}
    for few in (0, 1, 10**6):
        monkeypatch.setattr(quality, "FEW", few)
        assert {r.doc_id: r.n_repeat_words for r in quality.judge(docs).collect()} == want


def test_quality_boilerplate_is_told_from_prose(spark):
    from pairfield.llm.quality import judge

    clean = ["You can log in with a key that we sent you.", "A design in wood and a blog in Dutch.", "They assign in turn.", "The data is licensed to us.", "He drove under the influence without a license."]
    boiler = ["Log in.", "Sign in here.", "All rights reserved.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "See our privacy policy."]
    rows = [(i, t) for i, t in enumerate(clean + boiler)]
    got = {r.doc_id: r.n_lines_removed for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i >= len(clean)) for i in range(len(rows))}


def test_quality_lines(spark):
    from pairfield.llm.quality import judge

    good = prose(random.Random(3), 90) + "."
    nav = "Home | News | Sport | About us | Contact"
    rows = [(0, f"{nav}\n{good}\nAll rights reserved."), (1, "\n".join([nav] * 3 + [f"menu {i} | page {i} | shop {i} | more {i} | again {i} | last {i}" for i in range(20)])), (2, good)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept and got[0].clean_text == good and got[0].n_lines_removed == 2
    assert not got[1].kept and got[2].kept and got[2].clean_text == good


def test_surrogates(spark, empty):
    from pairfield.llm import pii

    said = "Write to Anna.Lee@mail.example.com or +1 (017) 555-7713, card 4929348385146306, host 97.51.17.173, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Mr Paul Smith met Mrs Eva Smith."
    rows = [(0, said), (1, "Again anna.lee@mail.example.com and 97.51.17.173."), (2, "Nothing here but words."), (3, None), (4, ""), (5, "Frau Müller; Господин Иванов")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for secret in ("Anna.Lee", "555-7713", "4929348385146306", "97.51.17.173", "04dbebab", "Paul Smith", "Eva"):
        assert secret not in got[0].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0].text) and re.search(r"\b\d{16}\b", got[0].text)
    mail = re.search(r"\S+@\S+\.com", got[0].text)[0]
    assert mail in got[1].text and got[0].n_entities == 7 and got[0].kinds["person"] == 2
    first, last = re.search(r"Mr (\w+) (\w+) met Mrs \w+ (\w+)", got[0].text).group(1, 2, 3)[0], re.search(r"Mr \w+ (\w+)", got[0].text)[1]
    assert first in pii.FIRST["Latin", "m"] and got[0].text.count(last) == 2
    assert (got[2].text, got[2].n_entities, got[3].text, got[4].text) == ("Nothing here but words.", 0, None, "")
    assert re.search(r"Господин [А-я]+$", got[5].text) and "Иванов" not in got[5].text and "Müller" not in got[5].text
    assert pii.pseudonymise(empty, KEY).count() == 0


def test_surrogates_are_distinct(spark, monkeypatch):
    from pairfield.llm import pii

    assert len({pii.permuted(KEY, "card", f"{n:04d}", 0) for n in range(10_000)}) == 10_000
    # with few surnames to draw from, people get the same one unless collisions are mended
    names = [f"Mr Aa B{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string").repartition(3)
    every = pii.corpus_entities(df.withColumn("__row", F.col("doc_id")))
    plain = Counter(pii.person(KEY, n[3:], "m") for n in names)
    again = pii.collisions(every, KEY)
    if max(plain.values()) > 1:
        assert again is not None
    texts = [r.text for r in pii.pseudonymise(df, KEY).collect()]
    assert len(set(texts)) == 40


def test_surrogates_of_all_spellings_agree(spark, monkeypatch):
    from pairfield.llm import pii

    pairs = [("phone", "+1 555 123 4567", "+15551234567"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("ip", "97.5.1.3", "97.05.01.3")]
    for kind, a, b in pairs:
        assert pii.normal(kind, a) == pii.normal(kind, b)
        for attempt in (0, 1, 12):
            assert pii.normal(kind, pii.surrogate(KEY, kind, a, attempt)) == pii.normal(kind, pii.surrogate(KEY, kind, b, attempt))
    rows = ["Mr Kim Lee", "Dr Kim Lee", "Dr KIM LEE", "Mr Jo Ray", "Mrs Jo Ray", "Call +1 555 123 4567", "Call +15551234567"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3), KEY).collect()}
    assert got[0][3:] == got[1][3:] and got[2][3:] == got[0][3:].upper() and got[0].split()[1] in pii.FIRST["Latin", "m"]
    assert got[3][3:] == got[4][4:] and got[3].split()[1] in pii.FIRST["Latin", "n"]
    assert re.sub(r"\D", "", got[5]) == re.sub(r"\D", "", got[6]) and got[5].startswith("Call +1 ")
    # collisions that no draw mends are told
    monkeypatch.setattr(pii, "person", lambda *_: "Same Name")
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(pii, "ROUNDS", 1)
        pii.collisions(spark.createDataFrame([("person", f"a{i}", f"A{i}", "m") for i in range(2)], "kind string, norm string, found string, gender string"), KEY)


def test_surrogates_of_names(spark):
    from pairfield.llm import pii

    rows = ["Paul Smith met Anna Jones. Later Smith and JONES left; Smithson stayed.", "Mr Kim Lee and Lee said. Ms Lee too.", "A Jones nobody named.", "+1 202 555 0123 or +12025550123 or +1 (202) 555-0123"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).collect()}
    m = re.fullmatch(r"(\w+) (\w+) met (\w+) (\w+)\. Later (\w+) and (\w+) left; Smithson stayed\.", got[0])
    assert m and m[5] == m[2] and m[6] == m[4].upper() and m[1] in pii.FIRST["Latin", "m"] and m[3] in pii.FIRST["Latin", "f"] and not {"Smith", "Jones"} & set(m.groups())
    m = re.fullmatch(r"Mr (\w+) (\w+) and (\w+) said\. Ms (\w+) too\.", got[1])
    assert m and m[2] == m[3] == m[4] != "Lee"
    assert got[2] == rows[2]
    numbers = [re.sub(r"\D", "", x) for x in got[3].split(" or ")]
    assert len(set(numbers)) == 1 and numbers[0] != "12025550123" and all(x.startswith("+1") for x in got[3].split(" or "))
    # another key, other surrogates
    other = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), b"other").collect()}
    assert all(other[i] != got[i] for i in (0, 1, 3))


def test_entities_of_a_long_text_take_linear_time():
    import time

    from pairfield.llm import pii

    text = " ".join(f"user{i}@mail.example.com" for i in range(20_000))
    began = time.time()
    assert len(pii.entities(text)) == 20_000 and time.time() - began < 10


def test_surrogates_by_brute_force(spark):
    """Every entity has one surrogate, all surrogates differ from each other and from all entities, and the rest of the text stays."""
    from pairfield.llm import pii

    rng = random.Random(6)
    people = [f"{rng.choice(['Mr', 'Mrs', 'Dr'])} {rng.choice(['Adam', 'Eva', 'Kim', 'Jo'])} {rng.choice(['Ray', 'Lee', 'Fox', 'Day', 'Poe'])}" for _ in range(60)]
    others = [f"u{i}@h{i % 3}.org" for i in range(30)] + [f"10.0.{i}.7" for i in range(30)] + [f"{i:03d}-22-{i:04d}" for i in range(100, 130)]
    said = [(i, f"Start {x} middle {y} end.", x, y) for i, (x, y) in enumerate(zip(rng.choices(people, k=150), rng.choices(others, k=150)))]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in said], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    made: dict = {}
    for i, _, x, y in said:
        m = re.fullmatch(r"Start (Mr|Mrs|Dr) (.+) middle (.+) end\.", got[i])
        assert m and x.startswith(m[1] + " ")
        for entity, fresh in ((x.split(" ", 1)[1], m[2]), (y, m[3])):
            assert made.setdefault(entity, fresh) == fresh
    assert len(set(made.values())) == len(made) and not set(made) & set(made.values())


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    from pairfield.llm.binary_tokens import decode_range, read_blocks, token_files
    from pairfield.llm.token_counts import count_tokens, write_flat

    path = vocabulary("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    files = token_files(docs, path)
    start = 0
    got = sorted(read_blocks(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in REPEATED)
    stream = []
    for r in got:
        ids = tk.encode(DOCS[r.doc_id][1] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    blocks = [r.asDict() for r in files.orderBy("shard", "block").collect()]
    at = 0
    for b in blocks:  # random access
        assert decode_range(b, b["n_ids"] // 3, b["n_ids"] // 2).tolist() == stream[at + b["n_ids"] // 3 : at + b["n_ids"] // 2]
        at += b["n_ids"]
    assert read_blocks(token_files(empty, path)).count() == 0
    tk.encode_special_tokens = True
    counts = count_tokens(write_flat(docs, path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts) == sorted((i, len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in REPEATED)
    assert count_tokens(write_flat(empty, path)).count() == 0


def test_separators_across_blocks(spark):
    from pairfield.llm.token_counts import END, count_tokens

    rng = random.Random(9)
    lengths = [rng.choice([0, 1, 5, 40]) for _ in range(30)]
    ids = [x for n in lengths for x in [7] * n + [END]] + [7, 7, 7]
    rows, done = [], 0
    for k, a in enumerate(range(0, len(ids), 13)):
        part = ids[a : a + 13]
        rows.append((0, k, bytearray(np.array(part, np.uint16).tobytes()), list(range(done, done + part.count(END)))))
        done += part.count(END)
    got = sorted(count_tokens(spark.createDataFrame(rows, "file int, block int, data binary, names array<bigint>").repartition(4)).collect(), key=lambda r: r.number)
    assert [r.n_tokens for r in got] == [*lengths, 3] and [r.doc_id for r in got] == [*range(30), None]


def test_repair_round_trip():
    from pairfield.llm.binary_tokens import BASE, compress, expand, rule_lengths

    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint16), np.full(1000, 5, np.uint16), rng.integers(0, 50, 5000).astype(np.uint16), (rng.zipf(1.5, 20_000) % 3000).astype(np.uint16)):
        ends = np.unique(np.concatenate([rng.integers(0, len(ids) + 1, 9), [len(ids)]]))
        symbols, at, rules = compress(ids, ends)
        assert (expand(symbols, rules) == ids).all() and len(at) == len(ends)
        size = np.ones(len(symbols), np.int64)
        size[symbols >= BASE] = rule_lengths(rules)[symbols[symbols >= BASE].astype(int) - BASE]
        assert (np.concatenate([[0], np.cumsum(size)])[at] == ends).all()


def test_repair_folds_long_copies():
    from pairfield.llm.binary_tokens import compress, expand

    rng = np.random.default_rng(1)
    for ids in (np.tile(rng.integers(2, 40_000, 1000), 40).astype(np.uint16), np.full(4096, 5, np.uint16)):
        symbols, _, rules = compress(ids, np.array([len(ids)]))
        assert (expand(symbols, rules) == ids).all() and len(ids) > 100 * len(symbols)


def test_rows_without_an_id_link_as_others_do(spark):
    from pairfield.llm.ngram_join import jaccard_groups, text_key

    rng = random.Random(21)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(5, a), (None, a), (None, a + " more"), (9, a + " more than"), (None, b), (None, b), (None, b + " tail"), (3, c), (None, None), (None, ""), (None, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()), key=str)
    sizes = [len({tuple(t.lower().split()[i : i + 4]) for i in range(len(t.split()) - 3)}) for _, t in rows[:8]]
    want = [(i, n, 5 if t.startswith(a) else 3 if t == c else None) for (i, t), n in zip(rows[:8], sizes)] + [(None, 0, None), (None, 0, None), (None, 1, None)]
    assert got == sorted(want, key=str)
    keyed = df.select("text", text_key(df).alias("k")).distinct().collect()
    assert len({r.k for r in keyed}) == len({r.text or "" for r in keyed})


def test_text_keys_after_collisions(spark, monkeypatch):
    """With hashes of a few bits texts collide at once, and are hashed again until they differ."""
    from pairfield.llm import ngram_join

    df = spark.createDataFrame([(f"text {i}",) for i in range(200)], "text string")
    key = ngram_join.text_key(df, "text", 2**63 - 4_000)
    got = df.select(key.alias("k")).collect()
    assert len({r.k for r in got}) == 200 and min(r.k for r in got) >= 2**63 - 4_000


def test_substring_dedup_without_ids(spark):
    from pairfield.llm.substring import dedup

    rng = random.Random(22)
    a = prose(rng, 400)
    df = spark.createDataFrame([(None, a), (None, a), (None, a + " and a tail of its own"), (4, a)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, len(r.text)): (r.n_removed, r.n_bytes) for r in dedup(df).collect()}
    assert got[4, len(a)][0] == 0
    assert all(gone > 0.9 * size for (i, _), (gone, size) in got.items() if i is None)


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    from pairfield.llm.mixing import mix

    rng = random.Random(23)
    rows = [(None if i % 3 else i // 30, f"t{i}", 40, "ab"[i % 7 == 0], 1.5, {"x": i}) for i in range(300)]
    schema = "doc_id long, text string, size long, source string, lam double, mean_size map<string,int>"
    seen = set()
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        got = mix(spark.createDataFrame(rows, schema).repartition(parts))
        assert set(schema.replace(",", " ").split()[::2]) >= {"lam"} and {"lam", "mean_size"} <= set(got.columns)
        seen.add(tuple(sorted((r.text, r.copies, r.rate) for r in got.collect())))
    assert len(seen) == 1 and len({c for _, c, _ in next(iter(seen))}) > 1


def test_suffix_dedup_keeps_columns_and_one_part_an_item(spark):
    rng = random.Random(24)
    line = prose(rng, 200)[:450]
    rows = [(i, f"{prose(rng, 12)} {line} {prose(rng, 12)}", "a", 1.0, i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string, t2 double, salt int").repartition(20)
    got = suffix.remove_repeats(df)
    assert {"t1", "t2", "salt"} <= set(got.columns)
    assert all(r.t1 == "a" and r.t2 == 1.0 and r.salt == r.doc_id and r.n_removed >= 450 for r in got.collect())


def test_suffix_items_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(32)
    texts = [prose(rng, rng.choice((0, 1, 50, 90, 400))) for _ in range(60)]
    texts[7:9] = ["a" * 3000, "日本語のテキスト。" * 60]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    whole = suffix.items(data, offsets, both=True)
    assert len(whole[0]) and len(whole[4])
    for block in (1, 700, 5_000):
        monkeypatch.setattr(suffix, "BLOCK", block)
        assert all(np.array_equal(x, y) for x, y in zip(whole, suffix.items(data, offsets, both=True)))
        assert all(np.array_equal(x, y) for x, y in zip(whole[:4], suffix.items(data, offsets)))


def test_suffix_dedup_counts_repeats_that_stay(spark, monkeypatch):
    """Passages of SHORT to LENGTH - 1 bytes stay, and documents that share one are told from those that share none."""
    rng = random.Random(31)
    word = lambda n, letters="etaoinshrdlu": " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    texts = [word(rng.choice((20, 60, 150))) for _ in range(40)] + [None, ""]
    sizes = [0] * len(texts)
    for k, size in enumerate((suffix.SHORT, 280, 330, suffix.LENGTH - 1)):
        for letters in ("etaoinshrdlu", "日本語のテキスト文章"):
            passage = word(150, letters).encode()[:size].decode(errors="ignore")
            passage += "." * (size - len(passage.encode()))
            texts += [f"{k}{word(rng.randint(0, 40))}|{passage}!{word(30)}", passage, f"{word(9)}?{passage}"]
            sizes += [size] * 3
    common = word(60)[:300]
    texts += [f"{word(5)}={common}#{i}{word(5)}" for i in range(150)]
    sizes += [300] * 150
    texts.append(f"{word(20)}<{passage}>{word(10)}[{passage}]")  # twice in one document
    sizes.append(2 * size)
    texts += [word(40)] * 3 + ["short, and given twice"] * 2
    sizes += [len(t.encode()) if len(t.encode()) >= suffix.SHORT else 0 for t in texts[-5:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    seen = set()
    for bits in (None, 64):
        monkeypatch.setattr(suffix, "bloom_filter", partial(bloom_filter, bits=bits))
        rows = sorted(suffix.remove_repeats(df).collect())
        seen.add(tuple(r.n_repeated for r in rows))
        for r in rows:
            if r.doc_id >= len(texts) - 5 and r.n_removed:
                continue
            assert r.n_removed == 0
            # a few bytes beside a passage may agree by chance
            assert (r.n_repeated == 0) if not sizes[r.doc_id] else suffix.PIECE <= r.n_repeated <= sizes[r.doc_id] + 8, (r, sizes[r.doc_id])
    assert len(seen) == 1
