"""Nearest rows against brute force, and that pivots rule blocks out."""

import numpy as np
import pytest

from pairfield.operators import nearest as N


def near(queries, db, k, metric):
    out = []
    for i, v in queries:
        found = []
        for j, w in db:
            if i != j:
                a, b = np.array(v), np.array(w)
                d = {"cosine": lambda: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), "euclidean": lambda: np.linalg.norm(a - b), "manhattan": lambda: np.abs(a - b).sum(), "hamming": lambda: (a != b).mean()}[metric]()
                found.append((round(d, 9), j))
        out += [(i, j, d, r + 1) for r, (d, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def vectors(metric):
    rng = np.random.default_rng(4)
    if metric == "hamming":
        return [(i, [float(x) for x in rng.integers(0, 3, 8)]) for i in range(500)]
    step = 1000 if metric == "cosine" else 8  # sums of eighths are exact, so ties are ties
    centres = rng.normal(size=(12, 6)) * 5
    rows = [(i, [round(float(x) * step) / step for x in centres[i % 12] + rng.normal(size=6) * 0.3]) for i in range(900)]
    return rows + [(1000 + i, rows[7][1]) for i in range(40)]  # equal rows: ties


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "hamming"])
def test_against_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    monkeypatch.setattr(N, "VISITS", 2)
    rows = vectors(metric)
    db = spark.createDataFrame([*rows, (None, rows[0][1]), (5000, None), (5001, [float("nan")] * len(rows[0][1]))], "id long, vec array<double>").repartition(5)
    told = {}
    got = N.knn_graph(db.where("id % 10 = 0"), db, 6, metric, block=25, told=told)
    want = near([r for r in rows if r[0] % 10 == 0], rows, 6, metric)
    assert sorted((r.id, r.neighbor, round(r.distance, 9), r.rank) for r in got.collect()) == want
    assert told["met"] < told["pairs"] / (1 if metric == "hamming" else 3)


def test_fewer_rows_than_asked_for(spark):
    db = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, vec array<float>")
    assert sorted(tuple(r)[:2] for r in N.knn_graph(db, db, 5).collect()) == [(1, 2), (2, 1)]
    assert N.knn_graph(db, db.where("false"), 5).count() == 0 and N.knn_graph(db.where("false"), db, 5).count() == 0
    assert {(r.id, r.neighbor) for r in N.find_nn(db, db).collect()} == {(1, 3), (2, 3), (3, 1)}
