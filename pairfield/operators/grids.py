"""Pixel grids: lookups, resizing, binning, rasterising: JON-15..18, 20, 22, AGG-13..19, 32, 40..42."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..sources.shared import saved


def sample_flow(points: DataFrame, flow: DataFrame, w: int, h: int, clamp_base: bool = False, x: str = "trg_x", y: str = "trg_y") -> DataFrame:
    """JON-15: flow at the pixel of a point, cut to whole numbers and kept in the image; the prediction starts at the floored point, or at the kept one with clamp_base."""
    fx, fy = F.floor(x), F.floor(y)
    kx, ky = F.greatest(F.lit(0), F.least(F.lit(w - 1), fx)), F.greatest(F.lit(0), F.least(F.lit(h - 1), fy))
    at = points.withColumns({"__x": kx.cast("long"), "__y": ky.cast("long")})
    f = flow.select("pair_id", F.col("y").alias("__y"), F.col("x").alias("__x"), "dx", "dy")
    base = (F.col("__x"), F.col("__y")) if clamp_base else (fx, fy)
    out = at.join(f, ["pair_id", "__y", "__x"], "left")
    return out.withColumns({"pred_x": base[0] + F.col("dx"), "pred_y": base[1] + F.col("dy")}).drop("__x", "__y", "dx", "dy")


def sample_bilinear(points: DataFrame, grid: DataFrame, values: list[str], by: list[str], key: list[str], x: str = "px", y: str = "py") -> DataFrame:
    """JON-16: values of a grid (by, y, x) at places between pixels; pixels outside count 0."""
    x0, y0 = F.floor(x).cast("long"), F.floor(y).cast("long")
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    at = [(j, i) for j in (0, 1) for i in (0, 1)]
    # the four pixels around a place as one row, so that points meet the grid once; only of grids that have points
    asked = grid.select(*by, "y", "x", *values).join(points.select(*by).distinct(), by, "left_semi")
    near = asked.select(*by, *values, F.explode(F.array(*[F.struct((F.col("y") - j).alias("y"), (F.col("x") - i).alias("x"), F.lit(2 * j + i).alias("c")) for j, i in at])).alias("c"))
    cells = near.groupBy(*by, F.col("c.y").alias("__y"), F.col("c.x").alias("__x")).agg(*[F.sum(F.when(F.col("c.c") == 2 * j + i, F.col(v))).alias(f"__{v}{j}{i}") for v in values for j, i in at])
    joined = points.select(*by, *key, x0.alias("__x"), y0.alias("__y"), fx.alias("__fx"), fy.alias("__fy")).join(cells, [*by, "__y", "__x"], "left")

    def read(v: str) -> Column:
        parts = [(F.col("__fx") if i else 1 - F.col("__fx")) * (F.col("__fy") if j else 1 - F.col("__fy")) * F.coalesce(F.col(f"__{v}{j}{i}"), F.lit(0.0)) for j, i in at]
        return sum(parts[1:], parts[0])

    return joined.select(*by, *key, *[read(v).alias(v) for v in values])


def resize_grid(grid: DataFrame, from_wh: tuple[int, int], to_wh: tuple[int, int], values: list[str], by: list[str], mode: str = "bilinear", align_corners: bool = False) -> DataFrame:
    """JON-17: a grid in another size; places off the edge take the edge's value."""
    (w, h), (ow, oh) = from_wh, to_wh
    cells = grid.select(*by).distinct()
    out = cells.withColumn("oy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(oh - 1).cast("long")))).withColumn("ox", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ow - 1).cast("long"))))

    def place(c: str, n: int, m: int) -> Column:
        if mode == "nearest":
            return F.floor(F.col(c) * (n / m)).cast("double")
        if align_corners:
            return F.col(c) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (F.col(c) + 0.5) * (n / m) - 0.5))

    at = out.withColumns({"px": place("ox", w, ow), "py": place("oy", h, oh)})
    got = sample_bilinear(at, grid, values, by, ["oy", "ox"])
    return got.withColumnsRenamed({"oy": "y", "ox": "x"})


def warp_grid(grid: DataFrame, flow: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """JON-18: the grid's values at x + dx, y + dy."""
    at = flow.select(*by, F.col("y").alias("oy"), F.col("x").alias("ox"), (F.col("x") + F.col("dx")).alias("px"), (F.col("y") + F.col("dy")).alias("py")).where("px IS NOT NULL AND py IS NOT NULL")
    return sample_bilinear(at, grid, values, by, ["oy", "ox"]).withColumnsRenamed({"oy": "y", "ox": "x"})


def merge_depth(layers: DataFrame, by: list[str], rank: list[str], background: float = 1000.0) -> DataFrame:
    """JON-20: the nearest layer of each pixel; of equal ones the first in rank; a NULL depth lies at the background and never wins."""
    rows = layers.where(F.col("depth") < background)
    rest = [c for c in layers.columns if c not in (*by, "y", "x", "depth", *rank)]
    best = rows.groupBy(*by, "y", "x").agg(F.min(F.struct("depth", *rank, *rest)).alias("m"))
    return best.select(*by, "y", "x", "m.*")


def merge_depth_pair(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """JON-20, two inputs: the second wins ties."""
    both = first.withColumn("__r", F.lit(1)).unionByName(second.withColumn("__r", F.lit(0)))
    return merge_depth(both, by, ["__r"]).drop("__r")


def add_flow(base: DataFrame, residual: DataFrame, base_wh: tuple[int, int], wh: tuple[int, int], scale: float = 1.0) -> DataFrame:
    """JON-22: a coarse flow brought to the finer grid, times scale, plus the residual."""
    up = resize_grid(base, base_wh, wh, ["dx", "dy"], ["pair_id"])
    r = residual.select("pair_id", "y", "x", F.col("dx").alias("rx"), F.col("dy").alias("ry"))
    return up.join(r, ["pair_id", "y", "x"]).select("pair_id", "y", "x", (F.col("dx") * scale + F.col("rx")).alias("dx"), (F.col("dy") * scale + F.col("ry")).alias("dy"))


def keypoint_distance(kp: DataFrame, flow: DataFrame, x: str = "trg_x", y: str = "trg_y") -> DataFrame:
    """AGG-13: mean distance between the source point and the mapping read between pixels at the target point."""
    grid = flow.where("dx IS NOT NULL").select("pair_id", "y", "x", (F.col("x") + F.col("dx")).alias("mx"), (F.col("y") + F.col("dy")).alias("my"))
    at = kp.select("pair_id", "src_x", "src_y", F.col(x).alias("px"), F.col(y).alias("py"))
    got = sample_bilinear(at, grid, ["mx", "my"], ["pair_id"], ["src_x", "src_y"])
    return got.groupBy("pair_id").agg(F.avg(F.hypot(F.col("mx") - F.col("src_x"), F.col("my") - F.col("src_y"))).alias("distance"))


def _four(w: int, h: int) -> tuple[list[tuple[Column, Column, Column, Column]], Column]:
    """The four pixels around (x, y): row, column, weight and whether it is in the image; and the length of the weights that are."""
    x0, y0 = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    cells = [((y0 + j).cast("long"), (x0 + i).cast("long"), (2 - F.abs(fx - i) - F.abs(fy - j)) / 4) for j in (0, 1) for i in (0, 1)]
    cells = [(cy, cx, p, F.coalesce(cy.between(0, h - 1) & cx.between(0, w - 1), F.lit(False))) for cy, cx, p in cells]
    squares = [F.when(ok, p * p).otherwise(F.lit(0.0)) for _, _, p, ok in cells]
    return cells, F.sqrt(sum(squares[1:], squares[0]))


def probability_map(points: DataFrame, w: int, h: int, kernel: list[list[float]] | None = None, key: list[str] = ("pair_id", "kp_idx"), single: bool = False) -> DataFrame:
    """AGG-14: a point's four pixels by their normalised closeness, smoothed by a kernel if given, with length 1 for each point.

    The weight of a pixel is 1 - |distance along x and y| shared over the four.
    single: no two points have one key; without a kernel a point's pixels are then worked out in its row.
    """
    key = list(key)
    x0, y0 = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    if single and kernel is None:
        cells, length = _four(w, h)
        ready = points.select(*key, "x", "y", length.alias("__length"))
        four = F.array(*[F.struct(cy.alias("y"), cx.alias("x"), F.try_divide(p, F.col("__length")).alias("p")) for cy, cx, p, _ in cells])
        return ready.select(*key, F.explode(four).alias("c")).select(*key, "c.y", "c.x", "c.p").where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    corners = F.array(*[F.struct((y0 + j).cast("long").alias("py"), (x0 + i).cast("long").alias("px"), ((2 - F.abs(fx - i) - F.abs(fy - j)) / 4).alias("p")) for j in (0, 1) for i in (0, 1)])
    rows = points.select(*key, F.explode(corners).alias("c")).select(*key, F.col("c.py").alias("y"), F.col("c.px").alias("x"), F.col("c.p").alias("p"))
    if kernel is not None:
        r = len(kernel) // 2
        offsets = F.array(*[F.struct(F.lit(j - r).alias("j"), F.lit(i - r).alias("i"), F.lit(float(v)).alias("v")) for j, line in enumerate(kernel) for i, v in enumerate(line)])
        rows = rows.withColumn("o", F.explode(offsets)).select(*key, (F.col("y") + F.col("o.j")).alias("y"), (F.col("x") + F.col("o.i")).alias("x"), (F.col("p") * F.col("o.v")).alias("p"))
    rows = rows.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)).groupBy(*key, "y", "x").agg(F.sum("p").alias("p"))
    length = F.sqrt(F.sum(F.col("p") * F.col("p")).over(Window.partitionBy(*key)))
    return rows.withColumn("p", F.try_divide(F.col("p"), length))


def location_loss(maps: DataFrame, corr: DataFrame, key: list[str] = ("pair_id",)) -> DataFrame:
    """AGG-15: mean over pairs of the Frobenius distance of two tables (key, kp_idx, y, x, p) and (..., score)."""
    cell = [*key, "kp_idx", "y", "x"]
    alone = F.array_contains(F.array(*[F.col(c).isNull() for c in cell]), True)  # no cell equals one without a key
    a = maps.select(*cell, F.coalesce("p", F.lit(0.0)).alias("v"), F.when(alone, 1).alias("__side"))
    b = corr.select(*cell, (-F.coalesce("score", F.lit(0.0))).alias("v"), F.when(alone, 2).alias("__side"))
    d = a.unionByName(b).groupBy(*cell, "__side").agg(F.sum("v").alias("d"))
    return d.groupBy(*key).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("loss")).agg(F.avg("loss").alias("loss"))


def point_location_loss(points: DataFrame, w: int, h: int, key: list[str] = ("pair_id",)) -> DataFrame:
    """AGG-14 and AGG-15 at once, where each point (key, kp_idx, x, y), named once, has a correlation of one pixel (sy, sx, score): no pixel becomes a row."""
    cells, length = _four(w, h)
    known = F.array_contains(F.array(*[F.col(c).isNotNull() for c in (*key, "kp_idx")]), False) == F.lit(False)
    score = F.coalesce("score", F.lit(0.0))
    hits = [F.coalesce(known & ok & (cy == F.col("sy")) & (cx == F.col("sx")), F.lit(False)) for cy, cx, _, ok in cells]
    away = [F.coalesce(F.try_divide(p, F.col("__length")), F.lit(0.0)) - F.when(hit, score).otherwise(F.lit(0.0)) for (_, _, p, _), hit in zip(cells, hits)]
    squares = [F.when(ok, d * d).otherwise(F.lit(0.0)) for (_, _, _, ok), d in zip(cells, away)]
    alone = F.when(hits[0] | hits[1] | hits[2] | hits[3], F.lit(0.0)).otherwise(score * score)
    rows = points.withColumn("__length", length).select(*key, sum(squares, alone).alias("__d2"))
    return rows.groupBy(*key).agg(F.sqrt(F.sum("__d2")).alias("loss")).agg(F.avg("loss").alias("loss"))


def keypoints_to_flow(cells: DataFrame, image: int, feat: int) -> DataFrame:
    """AGG-16: per cell the source of the highest kp_idx less the mean of the targets, over image / feat; cells: the rows of JON-5."""
    top = F.max(F.struct("kp_idx", "src_x", "src_y"))
    got = cells.groupBy("pair_id", "row", "col").agg(F.avg("trg_x").alias("tx"), F.avg("trg_y").alias("ty"), top.alias("m"))
    s = image / feat
    return got.select("pair_id", F.col("row").cast("long").alias("y"), F.col("col").cast("long").alias("x"), ((F.col("m.src_x") - F.col("tx")) / s).alias("dx"), ((F.col("m.src_y") - F.col("ty")) / s).alias("dy"))


def keypoints_to_sparse_flow(kp: DataFrame, w: int, h: int) -> DataFrame:
    """AGG-16, FLT-9: flow at the pixels of target points; points outside are left out, the highest kp_idx wins."""
    rows = kp.withColumns({"y": F.floor("trg_y").cast("long"), "x": F.floor("trg_x").cast("long")}).where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    m = F.max(F.struct("kp_idx", (F.col("src_x") - F.col("trg_x")).alias("dx"), (F.col("src_y") - F.col("trg_y")).alias("dy")))
    return rows.groupBy("pair_id", "y", "x").agg(m.alias("m")).select("pair_id", "y", "x", F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"))


def _bins(c: str, n: int, m: int) -> Column:
    """Bins of adaptive pooling that hold pixel c: bin i covers floor(i n / m) to ceil((i + 1) n / m), so bins may overlap."""
    lo, hi = F.floor(F.col(c) * m / n), F.ceil((F.col(c) + 1) * m / n) - 1
    candidates = F.sequence(F.greatest(F.lit(0), lo - 1).cast("long"), F.least(F.lit(m - 1), hi + 1).cast("long"))
    return F.filter(candidates, lambda i: (F.floor(i * n / m) <= F.col(c)) & (F.col(c) < F.ceil((i + 1) * n / m)))


def sparse_downsample(flow: DataFrame, from_wh: tuple[int, int], to_wh: tuple[int, int], by: list[str] = ("pair_id",)) -> DataFrame:
    """AGG-17: per bin the greatest positive less the greatest negative size of the valid values; bins without any are left out."""
    rows = flow.where("dx IS NOT NULL AND dy IS NOT NULL").withColumn("by_", F.explode(_bins("y", from_wh[1], to_wh[1]))).withColumn("bx_", F.explode(_bins("x", from_wh[0], to_wh[0])))

    def extreme(c: str) -> Column:
        return (F.max(F.greatest(F.col(c), F.lit(0.0))) - F.max(F.greatest(-F.col(c), F.lit(0.0)))).alias(c)

    return rows.groupBy(*by, F.col("by_").alias("y"), F.col("bx_").alias("x")).agg(extreme("dx"), extreme("dy"))


def mean_downsample(flow: DataFrame, size: tuple[int, int], feat: tuple[int, int], by: list[str] = ("pair_id",)) -> DataFrame:
    """AGG-18: per bin the sum of valid values over all its pixels and over the mean scale; bins of which half or fewer pixels are valid are (0, 0)."""
    ky, kx = size[1] / feat[1], size[0] / feat[0]
    rows = flow.withColumns({"by_": F.floor(F.col("y") / ky).cast("long"), "bx_": F.floor(F.col("x") / kx).cast("long"), "ok": (F.col("dx").isNotNull() & F.col("dy").isNotNull()).cast("int")})
    got = rows.groupBy(*by, F.col("by_").alias("y"), F.col("bx_").alias("x")).agg(F.sum(F.when(F.col("ok") == 1, F.col("dx"))).alias("sx"), F.sum(F.when(F.col("ok") == 1, F.col("dy"))).alias("sy"), F.sum("ok").alias("n"))
    good, over = F.col("n") / (ky * kx) > 0.5, ky * kx * (ky + kx) / 2
    return got.select(*by, "y", "x", F.when(good, F.col("sx") / over).otherwise(F.lit(0.0)).alias("dx"), F.when(good, F.col("sy") / over).otherwise(F.lit(0.0)).alias("dy"))


def points_to_flow(matches: DataFrame, relative: bool = True, by: list[str] = ("pair_id",)) -> DataFrame:
    """AGG-19: flow of matched points; several at one target pixel are averaged."""
    x, y = (F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) if relative else (F.col("x1"), F.col("y1"))
    return matches.groupBy(*by, F.col("y2").alias("y"), F.col("x2").alias("x")).agg(F.avg(x).alias("dx"), F.avg(y).alias("dy"))


def polygon_mask(points: DataFrame, w: int, h: int, by: list[str] = ("pair_id",)) -> DataFrame:
    """AGG-32: pixels inside a polygon (by, kp_idx, x, y) by the even-odd rule.

    A pixel belongs if its centre line y crosses the outline an odd number of times
    at or left of x: an edge from y1 to y2 counts where min <= y < max, and spans
    run from the first crossing, rounded up, to before the second; spans of a line do not
    overlap, so no pixel comes twice. A polygon's outline is one row, from which its lines are made;
    nothing is sorted but points by polygon.
    """
    lines = F.sort_array(F.collect_list(F.struct("kp_idx", "x", "y")))
    polygons = points.select(*by, "kp_idx", "x", "y").groupBy(*by).agg(lines.alias("k"))

    def edge(p: Column, i: Column) -> Column:
        after = F.get("k", i + 1)
        nx, ny = F.coalesce(after["x"], F.get("k", F.lit(0))["x"]), F.coalesce(after["y"], F.get("k", F.lit(0))["y"])
        lo, hi = F.ceil(F.least(p["y"], ny)), F.ceil(F.greatest(p["y"], ny)) - 1
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), nx.alias("nx"), ny.alias("ny"), F.greatest(F.lit(0), lo).cast("long").alias("lo"), F.least(F.lit(h - 1), hi).cast("long").alias("hi"))

    whole = F.forall("k", lambda p: F.coalesce((F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300), F.lit(False))).alias("whole")
    edges = polygons.select(*by, whole, F.filter(F.transform("k", edge), lambda e: (e["y"] != e["ny"]) & (e["lo"] <= e["hi"])).alias("e")).where(F.size("e") > 0)
    # lines of a closed outline have crossings in pairs, so all of them are paired at once; without some coordinate line by line
    first, last = F.array_min(F.transform("e", lambda e: e["lo"])), F.array_max(F.transform("e", lambda e: e["hi"]))
    parts = F.when(F.col("whole"), F.array(F.struct(first.alias("lo"), last.alias("hi")))).otherwise(F.transform(F.sequence(first, last), lambda p: F.struct(p.alias("lo"), p.alias("hi"))))
    rows = edges.select(*by, "e", F.explode(parts).alias("s"))

    def crossings(e: Column) -> Column:
        at = F.sequence(F.greatest(e["lo"], F.col("s.lo")), F.least(e["hi"], F.col("s.hi")))
        return F.transform(at, lambda p: F.struct(p.alias("y"), (e["x"] + (p - e["y"]) * (e["nx"] - e["x"]) / (e["ny"] - e["y"])).alias("cx")))

    crossed = F.sort_array(F.flatten(F.transform(F.filter("e", lambda e: (e["lo"] <= F.col("s.hi")) & (e["hi"] >= F.col("s.lo"))), crossings)))

    def span(i: Column) -> Column:
        c, end = F.get("c", 2 * i), F.get("c", 2 * i + 1)["cx"]
        return F.struct(c["y"].alias("y"), F.greatest(F.lit(0), F.ceil(c["cx"])).alias("a"), F.when(end.isNotNull(), F.least(F.lit(w - 1), F.ceil(end) - 1)).alias("b"))

    paired = rows.select(*by, crossed.alias("c")).where(F.size("c") > 1)
    spans = paired.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), span)).alias("s")).where("s.a <= s.b")
    return spans.select(*by, F.col("s.y").alias("y"), F.explode(F.sequence(F.col("s.a").cast("long"), F.col("s.b").cast("long"))).alias("x"))


def minmax_rescale(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """AGG-40: c_min, c_max and the column between them; a flat group is 0."""
    out = with_groups(df, by, {"c_min": F.min(col), "c_max": F.max(col)})
    return out.withColumn(col, F.coalesce(F.try_divide(F.col(col) - F.col("c_min"), F.col("c_max") - F.col("c_min")), F.lit(0.0)))


def standardize_by(df: DataFrame, by: list[str], cols: list[str], eps: float = 1e-6) -> DataFrame:
    """AGG-41: (v - mean) / (std + eps) in each group."""
    stats = {f"__{k}{i}": f(c) for i, c in enumerate(cols) for k, f in (("mean", F.avg), ("std", F.stddev_samp))}
    out = with_groups(df, by, stats)
    return out.withColumns({c: (F.col(c) - F.col(f"__mean{i}")) / (F.coalesce(f"__std{i}", F.lit(0.0)) + eps) for i, c in enumerate(cols)}).drop(*stats)


def with_groups(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """df with aggregates of each row's group (equal `by`, null included).

    They are written first: Spark then knows their size and broadcasts them if they are small,
    so that a few large groups do not come to a few tasks, as in a window.
    """
    groups = saved(df.groupBy(*by).agg(*[v.alias(c) for c, v in values.items()]), "groups").withColumnsRenamed({c: f"__by{i}" for i, c in enumerate(by)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)])
    return df.join(groups, same).drop(*[f"__by{i}" for i in range(len(by))])


def respread(df: DataFrame, by: list[str], col: str, mean: tuple[float, float], std: tuple[float, float], seed: int) -> DataFrame:
    """AGG-42: standardise a field in each sample, spread it by a drawn mean and deviation, and squash it."""
    z = standardize_by(df, by, [col])
    spread = F.col(col) * uniform(std[0], std[1], seed, "std", *by) + uniform(mean[0], mean[1], seed, "mean", *by)
    return z.withColumn(col, 1 / (1 + F.exp(-spread)))
