"""The pipeline against plain Python on the smallest tables: what each stage keeps and returns."""

import hashlib
import re

import numpy as np

from pairfield.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"documents": docs.collect()}
    for name, stage in C.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == list(C.COLUMNS)
            assert all(r.n_chars == len(r.text) for r in kept[name])
    quality = {r.doc_id: r.text for r in kept["quality"]}
    assert 0 < len(quality) < len(kept["documents"])
    assert all(len(WORD.findall(r.text)) >= 50 for r in kept["documents"] if r.doc_id in quality)
    # near duplicates: by all pairs
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in quality.items():
        w = WORD.findall(t.translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j])) and 100 * n >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = least
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i in sets if label[i] == i}
    private = {r.doc_id: r.text for r in kept["personal_data"]}
    assert private.keys() == {r.doc_id for r in kept["near_duplicates"]}
    assert not any(re.search(r"@mail\d\.example\.com", t) for t in private.values())
    mixed = [r.doc_id for r in kept["mixing"]]
    assert set(mixed) <= private.keys() and max(mixed.count(i) for i in set(mixed)) <= 3
    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in private.items()}
    assert sorted((r.doc_id, r.ids_sha256) for r in kept["tokens"]) == sorted((i, want[i]) for i in mixed)


def test_near_duplicates_tell_rows_by_their_text(spark):
    import random

    import corpus_pipeline as C

    rng = random.Random(8)
    one, two, three, four = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    said = [(None, one), (None, one + " end"), (None, two), (7, two), (5, three), (5, four), (3, three + " end"), (7, two), (None, ""), (None, ""), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in said], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(3, three + " end"), (5, four), (7, two), (9, "")]) + [(None, "")] * 2
    for parts in (1, 5):
        got = [(r.doc_id, r.text) for r in C.near_duplicates(spark, docs.repartition(parts), "").collect()]
        assert sorted(x for x in got if x[0] is not None) == want[:4]
        mine = sorted(t for i, t in got if i is None)
        # of the two like texts without an id one stays, the same in each run
        assert mine[:2] == ["", ""] and mine[2:] == [min((one, one + " end"), key=lambda t: hashlib.md5(t.encode()).hexdigest())]


def test_stages_on_hostile_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, ids of several texts, clashing columns; and no rows at all."""
    import random

    from pyspark.sql import functions as F

    import corpus_pipeline as C

    rng = random.Random(4)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" + ("." if i % 9 == 8 else "") for i in range(n)) + "."

    one, two, long = prose(80), prose(90) + " Write to a.b@mail.example.com.", prose(40_000)
    said = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, one, None, None, 7), (None, one, "en", "s", None), (3, two, "en", None, 1), (3, two, "en", None, 1), (3, long, "en", "t", 1), (4, " \n ", "en", "t", 3), (5, one + " More.", "en", "s", 1)]
    docs = spark.createDataFrame(said, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("kept", "clean_text", "__key", "size", "copies", "rate", "target", "n_entities", "kinds", "ids", "component_id", "n")})
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, "")
        kept[name] = sorted(map(tuple, out.collect()), key=repr)
        if name == "tokens":
            assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and len(kept[name]) == len(kept["mixing"])
        else:
            assert out.columns == list(C.COLUMNS)
            docs = spark.createDataFrame(kept[name], out.schema).withColumn("extra", F.lit(1))
    texts = {name: sorted(r[1] for r in rows) for name, rows in kept.items() if name != "tokens"}
    assert texts["quality"] == sorted([one, one, two, two, long, one + " More."])
    # like texts: the least id that is known stays
    assert sorted((r[0], r[1]) for r in kept["near_duplicates"]) == sorted([(3, two), (3, long), (5, one + " More.")])
    assert len(texts["personal_data"]) == 3 and not any("a.b@" in t for t in texts["personal_data"]) and long in texts["personal_data"]
    assert set(texts["mixing"]) <= set(texts["personal_data"])
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
