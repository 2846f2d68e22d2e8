"""Steps that must not deal or sort their rows a second time, against plainer ways to the same rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairfield.operators import grids as G
from pairfield.operators import matching as X
from pairfield.operators import profiling as R
from pairfield.operators.order import running
from pairfield.plans.fixtures import FX, SPARK, fixture

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_keep_their_digits(spark):
    """the error of a sum of floats must not grow with the rows."""
    n = 100_000
    rows = running(spark.range(n).withColumn("w", F.exp(-F.pmod("id", F.lit(50)) / 7.0)), "id", weight="w", name="hi", before="lo").orderBy("id").toPandas()
    w = np.exp(-(np.arange(n) % 50) / 7.0)
    for k in (1, 777, 50_000, n):
        want = math.fsum(w[:k])
        assert abs(rows.hi[k - 1] - want) <= 2e-15 * want


def test_places_between_pixels_meet_the_grid_once(spark):
    """F6."""
    rng = np.random.default_rng(3)
    grid = [(p, y, x, float(rng.integers(-9, 9)), None if rng.random() < 0.2 else 2.0) for p in (1, 2) for y in range(5) for x in range(4) if rng.random() < 0.8]
    points = [(int(rng.integers(1, 4)), i, float(rng.uniform(-2, 5)), float(rng.uniform(-2, 6))) for i in range(60)] + [(None, 60, 1.0, 1.0), (1, 61, None, 1.0)]
    g, p = spark.createDataFrame(grid, "pair_id long, y long, x long, a double, b double"), spark.createDataFrame(points, "pair_id long, k long, px double, py double")
    at = {r[:3]: r[3:] for r in grid}
    for r in G.sample_bilinear(p, g, ["a", "b"], ["pair_id"], ["k"]).collect():
        pair, _, x, y = points[r.k]
        if x is None:
            assert r.a is None
            continue
        for i, v in enumerate((r.a, r.b)):
            want = sum((1 - abs(x - cx)) * (1 - abs(y - cy)) * (at.get((pair, cy, cx), (0, 0))[i] or 0) for cy in (math.floor(y), math.floor(y) + 1) for cx in (math.floor(x), math.floor(x) + 1))
            assert abs(v - want) < 1e-9
    kp = p.select("pair_id", F.col("k").alias("kp_idx"), F.col("px").alias("trg_x"), F.col("py").alias("trg_y"), F.lit(0.0).alias("src_x"), F.lit(0.0).alias("src_y"))
    assert plan(G.keypoint_distance(kp, g.select("pair_id", "y", "x", F.col("a").alias("dx"), F.col("a").alias("dy")))).count("Join Inner") == 0


def test_polygons_are_not_sorted_by_line(spark):
    """random outlines, one without some coordinate, against lines one by one."""
    rng = np.random.default_rng(4)
    rows = [(p, k, float(rng.uniform(-3, 12)), float(rng.integers(-3, 12)) if p % 2 else float(rng.uniform(-3, 12))) for p in range(12) for k in range(int(rng.integers(1, 9)))]
    rows += [(20, 0, 1.0, 1.0), (20, 1, 8.0, None), (20, 2, 8.0, 7.0), (20, 3, 2.0, 9.0), (21, 0, None, 1.0), (21, 1, 6.0, 5.0), (21, 2, 2.0, 8.0)]
    got = G.polygon_mask(spark.createDataFrame(rows, "pair_id long, kp_idx long, x double, y double").repartition(3), 9, 10)
    assert "Window" not in plan(got)
    want = []
    for p in sorted({r[0] for r in rows}):
        k = [r[2:] for r in rows if r[0] == p]
        after = [tuple(b if b is not None else f for b, f in zip(k[i + 1] if i + 1 < len(k) else (None, None), k[0])) for i in range(len(k))]
        for y in range(10):
            cut = [None if None in (a[0], b[0]) else a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(k, after) if None not in (a[1], b[1]) and a[1] != b[1] and min(a[1], b[1]) <= y < max(a[1], b[1])]
            cut.sort(key=lambda c: -math.inf if c is None else c)
            for a, b in zip(cut[::2], cut[1::2]):
                if b is not None:
                    want += [(p, y, x) for x in range(max(0, -math.inf if a is None else math.ceil(a)), min(8, math.ceil(b) - 1) + 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


POINTS = [(1, 0, 2.5, 3.25, 3, 2, 1.0), (1, 1, -0.5, 7.0, 7, 0, 1.0), (1, 2, 7.75, 7.75, 9, 9, 1.0), (2, 0, 3.0, 3.0, 0, 0, 0.5), (None, 0, 4.0, 4.5, 4, 4, 1.0), (3, 0, -5.0, 2.0, 2, 2, 1.0), (4, 0, None, 2.0, 2, 2, None)]
SCHEMA = "pair_id long, kp_idx long, x double, y double, sy long, sx long, score double"


def test_losses_of_points_without_rows_of_pixels(spark):
    """F8."""
    p = spark.createDataFrame(POINTS, SCHEMA)
    corr = p.select("pair_id", "kp_idx", F.col("sy").alias("y"), F.col("sx").alias("x"), "score")
    got = G.point_location_loss(p, 8, 8).first().loss
    assert abs(got - G.location_loss(G.probability_map(p.select("pair_id", "kp_idx", "x", "y"), 8, 8), corr).first().loss) < 1e-12
    from pairfield.plans.catalog import QUERIES

    made = QUERIES["q30b_location_loss"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange hashpartitioning") == 1


def test_groups_without_windows(spark):
    """few large groups must not come to few tasks."""
    df = spark.createDataFrame([(i % 3 if i % 7 else None, float(i * i % 11), i) for i in range(60)] + [(9, 4.0, 60)], "g long, v double, i long")
    w = Window.partitionBy("g")
    got, want = G.standardize_by(df, ["g"], ["v"]), df.withColumn("v", (F.col("v") - F.avg("v").over(w)) / (F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)) + 1e-6))
    assert "Window" not in plan(got)
    a, b = ({r.i: (r.g, round(r.v, 9)) for r in d.collect()} for d in (got, want))
    assert a == b
    got = G.minmax_rescale(df, ["g"], "v")
    assert "Window" not in plan(got) and got.columns == ["g", "v", "i", "c_min", "c_max"] and got.where("g = 9").first().v == 0 and got.count() == 61


def test_maps_of_single_points(spark):
    """F10."""
    p = spark.createDataFrame(POINTS, SCHEMA).select("pair_id", "kp_idx", "x", "y")
    got, want = G.probability_map(p, 8, 8, single=True), G.probability_map(p, 8, 8)
    assert "Window" not in plan(got) and "Aggregate" not in plan(got) and got.columns == want.columns
    a, b = ({(r.pair_id, r.kp_idx, r.y, r.x): round(r.p, 12) for r in d.collect()} for d in (got, want))
    assert a == b and len(a) == got.count()


@pytest.mark.parametrize("name", sorted(SPARK))
def test_rows_of_fixtures_for_spark(spark, name):
    """F6 to F13: the same rows as the SQL's, and groups of them are not dealt again."""
    mine = fixture(spark, SF, name)
    plain = spark.sql(FX[name], lineitem=spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert mine.schema.simpleString() == plain.schema.simpleString()
    assert mine.exceptAll(plain).isEmpty() and plain.exceptAll(mine).isEmpty()
    grouped = mine.groupBy("pair_id" if name == "fx_kp" else ["object_id", "image_id"]).agg(F.max("kp_idx" if name == "fx_kp" else "y"))
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_curvature_sorts_lines_by_one_number(spark):
    """images with holes against their pixels one by one; the windows' first key tells lines apart."""
    rng = np.random.default_rng(12)
    rows = [(o, i, y, x, *map(float, rng.uniform(-1, 1, 3)), *map(float, rng.uniform(-0.5, 0.5, 3))) for o in (1, 2) for i in (1, 3) for y in range(7) for x in range(6) if rng.random() < 0.85]
    rows.append((1, 1, None, 3, *[0.5] * 6))
    got = R.curvature(spark.createDataFrame(rows, "object_id long, image_id long, y long, x long, cx double, cy double, cz double, nx double, ny double, nz double"))
    # each window sorts by its hash first: both hold the line, not the image alone
    assert len(set(re.findall(r"windowspecdefinition\((_w\d+#\d+L), object_id#\d+L, image_id#\d+L, [yx]#\d+L, [yx]#\d+L ASC", plan(got)))) == 2
    at = {r[:4]: np.array(r[4:]) for r in rows}

    def bend(a, b):
        return 2 * math.sin(math.acos(max(-1, min(1, float(a[3:] @ b[3:])))) / 2) / math.dist(a[:3], b[:3])

    want = {}
    for (o, i, y, x), _ in at.items():
        ends = [] if y is None else [at.get((o, i, y + dy, x + dx)) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        if ends and all(e is not None for e in ends):
            want[o, i, y, x] = (bend(*ends[:2]), bend(*ends[2:]))
    found = {(r.object_id, r.image_id, r.y, r.x): (r.k1, r.k2) for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 20
    assert all(np.allclose(found[k], want[k], rtol=1e-12) for k in want)


def test_pairs_of_a_pixel_are_not_shuffled(spark):
    """a pixel's pairs meet in one cube; keys of two types still meet; pixels without a match stay where that is asked for."""
    rng = np.random.default_rng(13)
    a, b = ([(int(o), i // 8, i % 8, *map(float, p)) for i, (o, p) in enumerate(zip(rng.integers(1, 4, 60), rng.integers(0, 9, (60, 3)) / 256))] for _ in range(2))
    rest = "y long, x long, cx double, cy double, cz double"
    want = {}
    for o, y2, x2, *q in b:
        near = [(sum((u - v) ** 2 for u, v in zip(p, q)), y1, x1) for k, y1, x1, *p in a if k == o and any(p)]
        d, y1, x1 = min(near) if any(q) else (1, 0, 0)
        want[o, y2, x2] = (y1, x1) if d <= 5e-5 else (None, None)
    for kind in ("long", "int"):
        src, trg = spark.createDataFrame(a, f"o {kind}, {rest}"), spark.createDataFrame(b, f"o long, {rest}")
        got = X.match_surfaces(src, trg, ["o"], unmatched=True)
        assert {(r.o, r.y2, r.x2): (r.y1, r.x1) for r in got.collect()} == want
        assert X.match_surfaces(src, trg, ["o"]).count() == sum(v[0] is not None for v in want.values()) < len(want)
    views = spark.createDataFrame([(1, *r) for r in a], f"object_id long, image_id long, {rest}")
    assert X.pairwise_matches(views)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
