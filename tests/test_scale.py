"""What must hold at any size: ranges of one key, trees of sums, tiles with halos, pools with a threshold."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairfield.functions import keyed as K
from pairfield.operators import matching as X
from pairfield.operators import profiling as R
from pairfield.operators import sampling as S
from pairfield.operators.order import running


def test_one_key_for_all_rows_is_spread(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(7).alias("k"), F.col("id"), F.lit("x").alias("row")).repartition(6)
    got = running(df, "k", name="no")
    assert got.agg(F.count("no"), F.min("no"), F.max("no"), F.countDistinct("no")).first()[:] == (n, 1, n, n)
    from pairfield.operators import order

    held = []
    before = order.saved
    order.saved = lambda d, name: held.append(before(d, name)) or held[-1]
    try:
        running(df, "k", ("id",)).count()
    finally:
        order.saved = before
    sizes = [r["count"] for r in held[0].groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < n / 2  # as many ranges as a shuffle has partitions


def test_running_sums_and_numbers_in_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 3 else int(g), float(k), int(w), i) for i, (g, k, w) in enumerate(zip(rng.integers(0, 5, 3000), rng.integers(0, 40, 3000), rng.integers(-3, 9, 3000)))]
    rows += [(1, None, 2, 9001), (1, float(3), None, 9002)]
    df = spark.createDataFrame(rows, "g long, k double, w int, i long").repartition(5)
    got = running(df, "k", ("i",), ("g",), "w", "upto", "before").collect()
    order = Window.partitionBy("g").orderBy("k", "i")
    w = F.coalesce("w", F.lit(0))
    want = df.withColumns({"upto": F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0)), "before": F.coalesce(F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert sorted(got[0].asDict()) == ["before", "g", "i", "k", "upto", "w"]
    assert running(df.where("false"), "k").count() == 0


@pytest.mark.parametrize("held", [1 << 28, 1])
def test_sums_of_a_thousand_tasks_merge_as_a_tree(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD_BYTES", held)
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(2500, 5)) @ rng.normal(size=(5, 5))
    rows = [("a" if i % 50 else "b", v.tolist()) for i, v in enumerate(vecs)] + [("a", None)]
    df = spark.createDataFrame(rows, "__g string, vec array<double>").repartition(1000)
    got = {r["__g"]: r for r in R.moments(df, 8).collect()}
    for g, at in (("a", np.arange(2500) % 50 > 0), ("b", np.arange(2500) % 50 == 0)):
        own = vecs[at]
        assert got[g].n == len(own)
        assert np.allclose(np.frombuffer(got[g].s), own.sum(0)) and np.allclose(np.frombuffer(got[g].q).reshape(5, 5), own.T @ own)


def test_tiles_with_halos(spark):
    """Grids over several tiles, with holes and cells left of zero."""
    rng = np.random.default_rng(8)

    def grid(image, share):
        return [(image, int(y), int(x), rng.integers(-3, 4, 3).astype(float).tolist()) for y in range(-3, 37) for x in range(-18, 18) if rng.random() < share]

    schema = "pair_id long, row_i long, col_i long, vec array<double>"
    a, b = grid(1, 0.7) + grid(2, 0.1), grid(1, 0.6) + grid(3, 0.05)
    offsets = [(0, 0), (1, -2), (-2, 2), (0, 2)]
    got = X.window_products(spark.createDataFrame(b, schema), spark.createDataFrame(a, schema), "pair_id", offsets).collect()
    at = {r[:3]: np.array(r[3]) for r in a}
    want = sorted((p, y, x, oy, ox, float(np.dot(v, at[p, y + oy, x + ox])) if (p, y + oy, x + ox) in at else 0.0) for p, y, x, v in b for oy, ox in offsets)
    assert sorted(map(tuple, got)) == want
    raw = X.correlate_local(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3, "raw").where("oy = 0 AND ox = 1").collect()
    assert all(np.isclose(r.score, np.dot(v, at[p, y, x + 1]) / 3 if (p, y, x + 1) in at else 0) for r in raw for p, y, x, v in [next(c for c in b if c[:3] == r[:3])][:1])


def test_vectors_are_copied_to_few_tiles(spark):
    cells = spark.range(64 * 64).select(F.lit(1).alias("pair_id"), F.floor(F.col("id") / 64).alias("row_i"), (F.col("id") % 64).alias("col_i"), F.array(F.lit(1.0)).alias("vec"))
    got = X.correlate_local(cells, cells, 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2
    reach, tile = 2, X.TILE
    copies = ((tile + 2 * reach) / tile) ** 2
    assert copies < 2 and got.count() == 64 * 64 * 25


@pytest.mark.parametrize("margin", [None, 3])
def test_pools_are_exact_below_and_beyond_the_threshold(spark, monkeypatch, margin):
    if margin is not None:  # a threshold that leaves epochs short
        monkeypatch.setattr(S, "pool_margin", lambda size: margin)
    calls = spark.createDataFrame([(i,) for i in (0, 5, 40, 41, 77)], "call_no long")
    catalog = spark.range(500).withColumnRenamed("id", "asset_id")
    got = sorted(tuple(r) for r in S.sample_pool(calls, catalog, 12, 10, 3).collect())
    draws = catalog.crossJoin(spark.createDataFrame([(0,), (4,), (7,)], "epoch long")).withColumn("u", K.unit(3, "pool", "epoch", "asset_id")).collect()
    want = [(e, r.asset_id, i + 1) for e in (0, 4, 7) for i, r in enumerate(sorted((d for d in draws if d.epoch == e), key=lambda d: (d.u, d.asset_id))[:12])]
    assert got == sorted(want)
    assert S.sample_pool(calls, catalog.where("false"), 12, 10, 3).count() == 0
    assert S.sample_pool(calls, catalog.limit(5), 12, 10, 3).count() == 15


def test_draws_in_blocks_are_the_keyed_draws(spark):
    ids = np.array([0, 9, 10, -5, 1_199_999, 10**17 + 3, 2**62, *range(300)])
    firsts = np.array([0, 7, 123, -2, 10**16])
    made = spark.createDataFrame([(int(f), int(i)) for f in firsts for i in ids], "f long, i long").select(K.unit(3, "pool", "f", "i")).toPandas().iloc[:, 0]
    assert (np.concatenate([h for _, h in K.heads(3, "pool", firsts, ids)]) / 2**32 == made).all()


def test_pools_make_no_row_for_a_draw_beyond_the_threshold(spark):
    calls = spark.createDataFrame([(i,) for i in (0, 5, 10**12)], "call_no long")  # epochs far apart
    catalog = spark.range(40_000).selectExpr("CAST(id * 3 AS INT) AS asset_id")
    got = S.sample_pool(calls, catalog, 12, 10, 3)
    draws = catalog.crossJoin(spark.createDataFrame([(0,), (10**11,)], "epoch long")).withColumn("u", K.unit(3, "pool", "epoch", "asset_id"))
    order = Window.partitionBy("epoch").orderBy("u", "asset_id")
    want = draws.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 12").select("epoch", "asset_id", "rank")
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("scores", [4_000_000, 7])
def test_best_matches_keep_ties(spark, monkeypatch, scores):
    monkeypatch.setattr(X, "SCORES", scores)
    rng = np.random.default_rng(9)
    schema = "pair_id long, pos long, vec array<double>"
    a, b = ([(p, int(i), rng.integers(-1, 2, 2).astype(float).tolist()) for p in ids for i in rng.permutation(n)] for ids, n in (((1, 2), 9), ((1, 3), 6)))
    a, b = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted((r.pair_id, r.src_pos, r.trg_pos, r.mutual, round(r.score, 9)) for r in X.best_matches(a, b).collect())
    corr = X.correlate(a, b).withColumn("score", F.round("score", 9))
    mutual = {(r.pair_id, r.src_pos) for r in X.mutual_nn_pairs(corr).collect()}
    want = [(r.pair_id, r.src_pos, r.trg_pos, (r.pair_id, r.src_pos) in mutual, r.score) for r in X.argmax_match(corr).collect()]
    assert got == sorted(want) and got
