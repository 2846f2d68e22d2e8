"""Hand-made cases: sentinels, ties, zero divisors, round trips, partition invariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfield.functions import points as P
from pairfield.functions.keyed import unit
from pairfield.functions.sql import compose, register
from pairfield.operators import filters as L
from pairfield.operators import geometry as Y
from pairfield.operators import grids as G
from pairfield.operators import matching as X
from pairfield.operators import metrics as M
from pairfield.operators import sampling as S
from pairfield.operators import tracking as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pck_without_points_is_zero(spark):
    pairs = frame(spark, [(1, 100, 100), (2, 100, 50)], "pair_id long, w long, h long")
    kp = frame(spark, [(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 0.0, 0.0, 10.1, 0.0)], "pair_id long, kp_idx long, src_x double, src_y double, pred_x double, pred_y double")
    got = {r.pair_id: r.pck_pct for r in M.pck_per_pair(kp, Y.pck_threshold(pairs), 0.1).collect()}
    assert got == {1: 50.0, 2: 0.0}  # the border counts, no points is 0


def test_two_rules_for_invalid_flow(spark):
    f = frame(spark, [(1, 0, 0, 0.0, 0.0), (1, 0, 1, float("inf"), 1.0), (1, 0, 2, None, 1.0), (1, 0, 3, 1.0, 2.0)], "pair_id long, y long, x long, dx double, dy double")
    assert [r.x for r in L.valid_flow(f, "inf").orderBy("x").collect()] == [0, 3]
    assert [r.x for r in L.valid_flow(f, "zero").orderBy("x").collect()] == [1, 3]
    assert L.to_null(f, "inf").where("x = 1").first().dx is None
    assert L.from_null(L.to_null(f, "zero"), "zero").where("x = 0").first().dx == 0.0


def test_outliers_with_zero_flow(spark):
    t = frame(spark, [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 100.0, 0.0)], "pair_id long, y long, x long, dx double, dy double")
    p = frame(spark, [(1, 0, 0, 4.0, 0.0), (1, 0, 1, 104.0, 0.0)], "pair_id long, y long, x long, dx double, dy double")
    assert M.kitti_f1(p, t).first().f1_pct == 50.0


def test_best_epoch_is_the_first_of_equal_ones(spark):
    m = frame(spark, [("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 0, 0.1)], "benchmark string, epoch long, value double")
    assert {r.benchmark: r.checkpoint for r in T.training_summary(m).collect()} == {"a": "epoch_2", "b": "N/A"}
    assert [r.is_best for r in T.running_best(m).where("benchmark = 'a'").orderBy("epoch").collect()] == [True, True, False]


def test_flow_and_mapping_round_trip(spark):
    f = frame(spark, [(1, 2, 3, 0.5, -1.5)], "pair_id long, y long, x long, dx double, dy double")
    back = Y.mapping_to_flow(Y.flow_to_mapping(f, (16, 16)), (16, 16)).first()
    assert math.isclose(back.dx, 0.5) and math.isclose(back.dy, -1.5)


def test_keypoint_cells_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-10, 140, (60, 2)))]
    got = {(r.i, r.row, r.col) for r in X.cells_for_points(frame(spark, pts, "i long, trg_x double, trg_y double"), (8, 8), 16, 30).collect()}
    lo, hi = [16 * c + 8 - 15 for c in range(8)], [16 * c + 8 + 15 for c in range(8)]
    assert got == {(i, r, c) for i, x, y in pts for r in range(8) for c in range(8) if lo[r] <= y <= hi[r] and lo[c] <= x <= hi[c]}


def test_surface_match_against_brute_force(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [(1, int(i // 8), int(i % 8), *map(float, v)) for i, v in enumerate(rng.uniform(0.01, 0.05, (n, 3)))]
    a, b = make(64), make(64)
    schema = "object_id long, y long, x long, cx double, cy double, cz double"
    got = {(r.y2, r.x2): (r.y1, r.x1) for r in X.match_surfaces(frame(spark, a, schema), frame(spark, b, schema), ["object_id"]).collect()}
    want = {}
    for _, y2, x2, *q in b:
        d, y1, x1 = min((sum((u - v) ** 2 for u, v in zip(p, q)), y1, x1) for _, y1, x1, *p in a)
        if d <= 5e-5:
            want[y2, x2] = (y1, x1)
    assert got == want and want


def test_pixels_within_the_radius_meet_once(spark):
    """Points on a lattice whose cubes' edges and halves fall on points; each source pixel stands in 8 cubes, not 27."""
    radius = 2.0
    grid = [(1, i, 0, *map(float, p)) for i, p in enumerate((x, y, z) for x in range(-5, 6) for y in range(-2, 4) for z in range(1, 4))]
    a = frame(spark, grid, "o long, y1 long, x1 long, sx double, sy double, sz double")
    b = frame(spark, grid, "o long, y2 long, x2 long, cx double, cy double, cz double")
    near = X.near_pixels(a, b, ["o"], radius * radius)
    got = sorted((r.y1, r.y2) for r in near.collect())
    want = sorted((i, j) for _, i, _, *p in grid for _, j, _, *q in grid if sum((u - v) ** 2 for u, v in zip(p, q)) <= radius * radius)
    assert got == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and next(x for x in plan.splitlines() if "Generate explode" in x).count("xxhash64") == 8


def test_overlap_counts_pixels_of_wide_images(spark):
    rng = np.random.default_rng(8)
    rows = [(o, i, int(k // 200), int(k % 200), *map(float, rng.integers(1, 9, 3) / 256)) for o in (1, 2) for i in range(3) for k in rng.choice(600, 80 + 40 * (i == 1), False)]
    got = {(r.object_id, r.image1, r.image2): r.overlap for r in X.view_overlap(frame(spark, rows, "object_id long, image_id long, y long, x long, cx double, cy double, cz double")).collect()}
    assert len(got) == 6
    for (o, a, b), overlap in got.items():
        one, two = ([r[4:] for r in rows if r[:2] == (o, i)] for i in (a, b))
        assert len(one) > len(two) or (len(one) == len(two) and a < b)
        hits = sum(any(sum((u - v) ** 2 for u, v in zip(p, q)) <= 5e-5 for p in one) for q in two)
        assert math.isclose(overlap, hits / (0.5 * (len(one) + len(two))))


def test_blocked_correlation_agrees(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i, v.tolist()) for p in range(3) for i, v in enumerate(rng.normal(size=(6, 5)))]
    a = frame(spark, rows, "pair_id long, pos long, vec array<float>")
    one = {(r.pair_id, r.src_pos, r.trg_pos): r.score for r in X.correlate(a, a).collect()}
    two = {(r.pair_id, r.src_pos, r.trg_pos): r.score for r in X.correlate_blocked(a, a).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_bilinear_and_resize(spark):
    g = frame(spark, [(1, y, x, float(10 * y + x)) for y in range(4) for x in range(4)], "pair_id long, y long, x long, v double")
    at = frame(spark, [(1, 0, 1.25, 2.5), (1, 1, 3.5, 0.0)], "pair_id long, k long, px double, py double")
    got = {r.k: r.v for r in G.sample_bilinear(at, g, ["v"], ["pair_id"], ["k"]).collect()}
    assert got == {0: 26.25, 1: 1.5}  # outside counts 0
    same = G.resize_grid(g, (4, 4), (4, 4), ["v"], ["pair_id"]).collect()
    assert all(r.v == 10 * r.y + r.x for r in same)


def test_polygon_square(spark):
    p = frame(spark, [(1, 0, 1.0, 1.0), (1, 1, 4.0, 1.0), (1, 2, 4.0, 3.0), (1, 3, 1.0, 3.0)], "pair_id long, kp_idx long, x double, y double")
    assert {(r.y, r.x) for r in G.polygon_mask(p, 8, 8).collect()} == {(y, x) for y in (1, 2) for x in (1, 2, 3)}


def test_depth_ties(spark):
    rows = frame(spark, [(1, 0, 0, 1, 5.0), (1, 0, 0, 2, 5.0), (1, 0, 1, 1, None)], "image_id long, y long, x long, layer long, depth double")
    assert [(r.x, r.layer) for r in G.merge_depth(rows, ["image_id"], ["layer"]).collect()] == [(0, 1)]
    one, two = (rows.where("y = 0 AND x = 0").where(f"layer = {n}") for n in (1, 2))
    assert G.merge_depth_pair(one, two, ["image_id"]).first().layer == 2


def test_overlapping_bins(spark):
    f = frame(spark, [(1, 0, x, float(v), 0.0) for x, v in enumerate([1, -5, 3, 2, -1])], "pair_id long, y long, x long, dx double, dy double")
    got = {r.x: r.dx for r in G.sparse_downsample(f, (5, 1), (2, 1)).collect()}
    assert got == {0: 3.0 - 5.0, 1: 3.0 - 1.0}  # pixel 2 lies in both


def test_bidirectional_twice(spark):
    kp = frame(spark, [(1, 1.0, 2.0)], "pair_id long, src_x double, trg_x double")
    got = Y.make_bidirectional(kp).orderBy("reverse").collect()
    assert [(r.src_x, r.trg_x) for r in got] == [(1.0, 2.0), (2.0, 1.0)]


def test_pca_signs_and_groups(spark):
    from pairfield.operators.profiling import pca_project

    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (rng.normal(size=4) * [5, 2, 1, 0.1]).tolist()) for i in range(80)]
    got = pca_project(frame(spark, rows, "id long, g long, vec array<double>"), ["id", "g"], 2, per="g").collect()
    assert len(got) == 80 and all(len(r.components) == 2 and 0 < r.components[0] < 1 for r in got)


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(200)
    one, seven = ({r.id: r.u for r in ids.repartition(n).select("id", unit(7, "s", "id").alias("u")).collect()} for n in (1, 7))
    assert one == seven and 0.4 < sum(one.values()) / 200 < 0.6
    assert abs(spark.range(1).select(F.conv(F.substring(F.md5(F.lit("7|0")), 1, 8), 16, 10).cast("double").alias("v")).first().v / 2**32 - 0.27568049542605877) < 1e-15


def test_mask_split_checks_lengths(spark):
    rows = frame(spark, [(0, 1), (1, 2)], "line_no long, v long")
    good = frame(spark, [(0, 1), (1, 0)], "line_no long, flag int")
    assert [r.is_train for r in S.mask_split(rows, good).orderBy("line_no").collect()] == [True, False]
    with pytest.raises(Exception, match="number of lines"):
        S.mask_split(rows, good.where("line_no = 0")).collect()


def test_sql_functions_and_chains(spark):
    register(spark)
    r = spark.sql("SELECT normalize_coord(0, 16) a, unnormalize_coord(1, 16) b, path_segment('a/b/c', -1) c, keyed_uniform('7|0') d").first()
    assert (r.a, r.b, r.c) == (-1.0, 15.0, "c") and abs(r.d - 0.27568049542605877) < 1e-15
    assert compose(lambda d: d.where("id > 1"), lambda d: d.limit(1))(spark.range(5)).count() == 1


def test_unknown_names_raise(spark):
    from pairfield.sources.readers import load_benchmark

    with pytest.raises(ValueError, match="no benchmark"):
        load_benchmark(spark, "other", "/nowhere")
    with pytest.raises(ValueError, match="no metric"):
        M.evaluate(spark.range(1), spark.range(1), "accuracy")
    with pytest.raises(Exception, match="no alpha"):
        M.multi_benchmark(frame(spark, [("a", 1.0)], "benchmark string, pck_pct double"), frame(spark, [("a", 0, 1.0)], "benchmark string, batch long, loss double"), {"b": 0.1}).collect()


def test_path_and_suffix(spark):
    r = spark.range(1).select(P.path_seg(F.lit("a/b"), 0).alias("a"), P.path_seg(F.lit("a/b"), 5).alias("n"), P.pad_suffix(F.lit("im_7"), 3).alias("p"), P.pad_suffix(F.lit("im_12345"), 3).alias("q")).first()
    assert (r.a, r.n, r.p, r.q) == ("a", None, "im_007", "im_12345")


