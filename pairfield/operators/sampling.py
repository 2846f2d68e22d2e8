"""Keyed, reproducible sampling: GEN-2..23, WIN-8. All draws are columns of `functions.keyed`."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed as K
from ..functions import points as P
from ..sources.shared import saved
from .order import running


def draw(spec: dict, seed: int, stream: str, *keys) -> Column:
    """GEN-2: one draw of a named distribution: uniform, norm, expon, triang, or beta with whole parameters.

    beta(a, b) is the a-th least of a + b - 1 uniforms.
    """
    kind = spec["name"]
    if kind == "uniform":
        return K.uniform(spec.get("lo", 0.0), spec.get("hi", 1.0), seed, stream, *keys)
    if kind == "norm":
        return K.normal(spec.get("mean", 0.0), spec.get("std", 1.0), seed, stream, *keys)
    if kind == "expon":
        return spec.get("loc", 0.0) + K.exponential(spec.get("scale", 1.0), seed, stream, *keys)
    if kind == "triang":
        return K.triangular(spec["lo"], spec["mode"], spec["hi"], seed, stream, *keys)
    if kind == "beta":
        a, b = int(spec["a"]), int(spec["b"])
        return F.element_at(F.array_sort(F.array(*[K.unit(seed, f"{stream}/{i}", *keys) for i in range(a + b - 1)])), a)
    raise ValueError(f"no distribution named {kind}")


def sample_distribution(ids: DataFrame, spec: dict | list[dict], key: str, seed: int, out: str = "value", stream: str = "dist") -> DataFrame:
    """GEN-2: a column of draws; a list is a mixture by the specs' weights."""
    if isinstance(spec, dict):
        return ids.withColumn(out, draw(spec, seed, stream, key))
    total, upto, value = sum(s.get("weight", 1.0) for s in spec), 0.0, None
    u = K.unit(seed, f"{stream}/pick", key)
    for i, s in enumerate(spec):
        upto += s.get("weight", 1.0) / total
        d = draw(s, seed, f"{stream}/{i}", key)
        value = F.when(u < upto, d) if value is None else value.when(u < upto, d) if i < len(spec) - 1 else value.otherwise(d)
    return ids.withColumn(out, value)


def sample_scales(ids: DataFrame, first: dict, change: dict, key: str, seed: int) -> DataFrame:
    """GEN-3: a scale and another that depends on it, scale_a and scale_a + r."""
    return ids.withColumn("scale_a", draw(first, seed, "scale/a", key)).withColumn("scale_b", F.col("scale_a") + draw(change, seed, "scale/r", key))


def sample_angles(ids: DataFrame, spec: dict, bounds: tuple[float, float], key: str, seed: int) -> DataFrame:
    """GEN-4: two views around a common centre within bounds."""
    out = ids
    for axis in ("az", "el"):
        centre = K.uniform(bounds[0], bounds[1], seed, f"angle/{axis}/centre", key)
        out = out.withColumns({f"{axis}1": centre + draw(spec, seed, f"angle/{axis}/1", key), f"{axis}2": centre + draw(spec, seed, f"angle/{axis}/2", key)})
    return out


def erf(x: Column) -> Column:
    """A rational polynomial, right to 2e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def grid_weight(score: Column, spec: dict) -> Column:
    """GEN-5: weight of a scored cell: normal, skew (skew-normal) or band."""
    if spec["name"] == "band":
        return F.when(score.between(spec["lo"], spec["hi"]), F.lit(1.0)).otherwise(F.lit(0.0))
    z = (score - spec["mean"]) / spec["std"]
    bell = F.exp(-z * z / 2)
    return bell * (1 + erf(spec["skew"] * z / math.sqrt(2))) if spec["name"] == "skew" else bell


def sample_grid(grid: DataFrame, ids: DataFrame, spec: dict, key: str, seed: int, radius: float = 0.0, buckets: int = 1024) -> DataFrame:
    """GEN-5: for each id a cell (cell_id, x, y, score) drawn by weight with replacement, moved within radius.

    Cells lie on [0, 1) by cumulative weight. That line is cut into buckets: a cell
    stands in every bucket it reaches into, a draw in one, and they meet on equal keys.
    """
    weighted = grid.withColumn("w", grid_weight(F.col("score"), spec)).where("w > 0")
    line = running(weighted, "cell_id", weight="w", name="hi", before="lo")
    whole = line.agg(F.max("hi")).first()[0] or 1.0
    line = line.withColumns({c: F.col(c) / F.lit(whole) for c in ("lo", "hi")})
    reach = F.sequence(F.floor(F.col("lo") * buckets), F.least(F.lit(buckets - 1), F.floor(F.col("hi") * buckets)))
    cells = line.withColumn("bucket", F.explode(reach)).select("bucket", "lo", "hi", "cell_id", "x", "y", "score")
    draws = ids.withColumn("u", K.unit(seed, "grid", key)).withColumn("bucket", F.floor(F.col("u") * buckets))
    got = draws.join(cells, "bucket").where("u >= lo AND u < hi")
    move = {c: F.col(c) + K.uniform(-radius, radius, seed, f"grid/{c}", key) for c in ("x", "y")} if radius else {}
    return got.withColumns(move).drop("bucket", "lo", "hi", "u")


def sample_quaternions(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """GEN-6: a direction in four dimensions times a beta(12, 4) radius."""
    axes = {f"q{i}": K.normal(0, 1, seed, f"quat/{i}", key) for i in range(4)}
    out = ids.withColumns(axes)
    scale = draw({"name": "beta", "a": 12, "b": 4}, seed, "quat/r", key) / F.sqrt(sum((F.col(f"q{i}") * F.col(f"q{i}") for i in range(1, 4)), F.col("q0") * F.col("q0")))
    return out.withColumn("s", scale).withColumns({f"q{i}": F.col(f"q{i}") * F.col("s") for i in range(4)}).drop("s")


def sample_colors(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """GEN-7: a random hue at full strength, as r, g, b."""
    r, g, b = P.hsv_to_rgb(K.unit(seed, "hue", key), K.uniform(0.5, 1, seed, "sat", key), K.uniform(0.5, 1, seed, "val", key))
    return ids.withColumns({"r": r, "g": g, "b": b})


def build_render_manifest(objects: DataFrame, n_images: int, seed: int, grid: tuple[int, int] | None = None, zooms: tuple[float, ...] = (1.0,)) -> DataFrame:
    """GEN-8: per object its images with view, zoom, light and material; grid (azimuths, elevations) gives a regular camera grid times zooms instead of draws."""
    n = n_images if grid is None else grid[0] * grid[1] * len(zooms)
    rows = objects.withColumn("image_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = ("object_id", "image_no")
    if grid is None:
        az, el, zoom = K.unit(seed, "az", *key), K.unit(seed, "el", *key), K.uniform(0.8, 1.2, seed, "zoom", *key)
    else:
        i = F.col("image_no")
        az, el = (i % grid[0]) / float(grid[0]), (F.floor(i / grid[0]) % grid[1] + 0.5) / float(grid[1])
        zoom = F.element_at(F.array(*[F.lit(z) for z in zooms]), (F.floor(i / (grid[0] * grid[1])) + 1).cast("int"))
    x, y, z = P.on_sphere(az, el, 1.0)
    light = {f"light_{c}": v + K.uniform(-0.3, 0.3, seed, f"light/{c}", *key) for c, v in (("x", x), ("y", y), ("z", z))}
    scales = {"ambient": K.uniform(0.1, 0.4, seed, "ambient", *key), "diffuse": K.uniform(0.4, 0.9, seed, "diffuse", *key), "specular": K.uniform(0.0, 0.5, seed, "specular", *key)}
    return rows.withColumns({"camera_x": x, "camera_y": y, "camera_z": z, "zoom": zoom} | light | scales)


def sample_matched(ids: DataFrame, n_objects: int, value: dict, p: float, p0: float, key: str, seed: int) -> DataFrame:
    """GEN-9: per object slot a source value and a target one: the same with probability p (p0 for slot 0), else drawn anew."""
    rows = ids.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_objects - 1).cast("long"))))
    k = (key, "slot")
    keep = F.when(F.col("slot") == 0, K.bernoulli(p0, seed, "match0", *k)).otherwise(K.bernoulli(p, seed, "match", *k))
    src = draw(value, seed, "src", *k)
    return rows.withColumns({"src_value": src, "trg_value": F.when(keep, src).otherwise(draw(value, seed, "trg", *k))})


def sample_affine(ids: DataFrame, angle: float, scale: tuple[float, float], shear: float, shift: float, key: str, seed: int) -> DataFrame:
    """GEN-10: affine parameters and their matrix, rotation and shear times scale, then a shift."""
    a, h, s = K.uniform(-angle, angle, seed, "angle", key), K.uniform(-shear, shear, seed, "shear", key), K.uniform(scale[0], scale[1], seed, "scale", key)
    tx, ty = K.uniform(-shift, shift, seed, "tx", key), K.uniform(-shift, shift, seed, "ty", key)
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(s * F.cos(a), -s * F.sin(a + h), tx, s * F.sin(a), s * F.cos(a + h), ty, zero, zero, one)
    return ids.withColumn("mat", m)


def square_to_quad(x: list[Column], y: list[Column]) -> Column:
    """The homography of the unit square's corners (0,0), (1,0), (1,1), (0,1) to four points."""
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    d = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / d, (dx1 * sy - sx * dy1) / d
    return F.array(x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, F.lit(1.0))


def sample_homography(ids: DataFrame, sigma: float, key: str, seed: int) -> DataFrame:
    """GEN-11: the corners of the square [-1, 1]^2 moved by up to sigma, and the homography that moves them."""
    base = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    xs = [b[0] + K.uniform(-sigma, sigma, seed, f"corner/x{i}", key) for i, b in enumerate(base)]
    ys = [b[1] + K.uniform(-sigma, sigma, seed, f"corner/y{i}", key) for i, b in enumerate(base)]
    half, one, zero = F.lit(0.5), F.lit(1.0), F.lit(0.0)
    unit = F.array(half, zero, half, zero, half, half, zero, zero, one)
    out = ids.withColumn("quad", square_to_quad(xs, ys))
    return out.withColumn("mat", P.compose(F.col("quad"), unit)).drop("quad")


def location_masks(ids: DataFrame, w: int, h: int, sigma: float, key: str, seed: int) -> DataFrame:
    """GEN-12: per pixel min(1, 2 exp(-d^2 / 2 sigma^2)) around a drawn centre."""
    from .geometry import pixel_grid

    centred = ids.withColumns({"mx": K.uniform(0, w, seed, "mask/x", key), "my": K.uniform(0, h, seed, "mask/y", key)})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return pixel_grid(centred, w, h).withColumn("mask", F.least(F.lit(1.0), 2 * F.exp(-(dx * dx + dy * dy) / (2.0 * sigma * sigma)))).drop("mx", "my")


def warp_pairs(ids: DataFrame, w: int, h: int, key: str, seed: int, sigma: float = 0.2) -> DataFrame:
    """GEN-13: per pixel of the target the source place under affine after homography; places outside [-1, 1] are NULL; flow in pixels."""
    from .geometry import pixel_grid

    mats = sample_affine(sample_homography(ids, sigma, key, seed).withColumnRenamed("mat", "hom"), 0.2, (0.9, 1.1), 0.1, 0.1, key, seed)
    grid = pixel_grid(mats.withColumn("m", P.compose(F.col("mat"), F.col("hom"))).drop("mat", "hom"), w, h)
    nx, ny = P.homography(F.col("m"), P.normalize(F.col("x"), w), P.normalize(F.col("y"), h))
    grid = grid.withColumns({"nx": nx, "ny": ny})
    inside = F.col("nx").between(-1, 1) & F.col("ny").between(-1, 1)
    return grid.withColumns({"dx": F.when(inside, P.unnormalize(F.col("nx"), w) - F.col("x")), "dy": F.when(inside, P.unnormalize(F.col("ny"), h) - F.col("y"))}).drop("m", "nx", "ny")


def random_split(df: DataFrame, frac: float | None, key: str, seed: int, default: float = 0.9) -> DataFrame:
    """GEN-14: is_train with probability frac; NULL takes the default, 0 puts all into the test."""
    return df.withColumn("is_train", K.bernoulli(default if frac is None else frac, seed, "split", key))


def mask_split(df: DataFrame, mask: DataFrame, line: str = "line_no") -> DataFrame:
    """GEN-14: is_train from a file of flags (line_no, flag) by position; other numbers of lines are an error."""
    flags = mask.select(line, (F.col("flag") == 1).alias("is_train"))
    joined = df.join(flags, line, "full")
    bad = F.col("is_train").isNull() | F.col(df.columns[0]).isNull()
    return joined.withColumn("is_train", F.when(bad, F.raise_error(F.lit("the mask has another number of lines")).cast("boolean")).otherwise(F.col("is_train")))


def subsample_flow(flow: DataFrame, rate: float, seed: int, min_keep: int = 10) -> DataFrame:
    """GEN-15: valid pixels kept with probability rate, and at least min_keep of each pair (the least draws); the others become NULL."""
    valid = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    u = flow.withColumn("u", K.unit(seed, "sub", "pair_id", "y", "x"))
    order = Window.partitionBy("pair_id").orderBy(F.when(valid, F.col("u")).asc_nulls_last(), "y", "x")
    kept = valid & ((F.col("u") < rate) | (F.row_number().over(order) <= min_keep))
    return u.withColumn("keep", kept).withColumns({"dx": F.when(F.col("keep"), F.col("dx")), "dy": F.when(F.col("keep"), F.col("dy"))}).drop("u", "keep")


def augment_pairs(pairs: DataFrame, p_flip: float, p_swap: float, key: str, seed: int) -> DataFrame:
    """GEN-16: source and target changed over with probability p_swap; one side mirrored with p_flip."""
    swap = K.bernoulli(p_swap, seed, "swap", key)
    cols = {c: F.when(swap, F.col("trg_" + c[4:] if c.startswith("src_") else "src_" + c[4:])).otherwise(F.col(c)) for c in pairs.columns if c[:4] in ("src_", "trg_")}
    return pairs.withColumns(cols | {"swapped": swap, "flip_trg": K.bernoulli(p_flip, seed, "flip", key)})


def sample_offsets(ids: DataFrame, n: int, key: str, seed: int, places: int = 21) -> DataFrame:
    """GEN-17: n objects at different ones of the places from -1 to 1, in drawn order, times a scale in [1, 1.5)."""
    rows = ids.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    order = F.row_number().over(Window.partitionBy(key).orderBy(K.unit(seed, "place", key, "place"), "place"))
    rows = rows.withColumn("slot", (order - 1).cast("long")).where(F.col("slot") < n)
    return rows.withColumn("offset", (F.col("place") * (2.0 / (places - 1)) - 1) * K.uniform(1.0, 1.5, seed, "place/scale", key)).drop("place")


def sample_lighting(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """GEN-18: light around the view and material scales."""
    spans = {"light_az": (-0.1, 0.1), "light_el": (-0.1, 0.1), "ambient": (0.2, 0.5), "diffuse": (0.5, 1.0), "specular": (0.0, 0.6), "exponent": (1.0, 30.0)}
    return ids.withColumns({c: K.uniform(a, b, seed, f"light/{c}", key) for c, (a, b) in spans.items()})


def sample_power(ids: DataFrame, lo: float, off: float, key: str, seed: int, debug: bool = False) -> DataFrame:
    """GEN-19: an exponent in [lo, lo + off), its middle in debug mode."""
    return ids.withColumn("power", F.lit(lo + off / 2) if debug else K.uniform(lo, lo + off, seed, "power", key))


#: Assets and epochs of one block of draws.
POOL_BLOCK, EPOCH_BLOCK = 16_384, 1_024


def _under(seed: int, limit: int):
    """Draws below limit / 2^32 of blocks of epochs and assets, as rows epoch, asset_id, u."""

    def run(batches):
        for batch in batches:
            for firsts, ids in zip(batch.column(0), batch.column(1)):
                firsts, ids = (np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64) for v in (firsts, ids))
                for epoch, heads in K.heads(seed, "pool", firsts, ids):
                    at = np.flatnonzero(heads < limit)
                    yield pa.RecordBatch.from_pydict({"epoch": np.full(len(at), epoch, np.int64), "asset_id": ids[at], "u": heads[at] / 4294967296.0})

    return run


def sample_pool(calls: DataFrame, catalog: DataFrame, size: int, every: int, seed: int) -> DataFrame:
    """GEN-20: the pool of each epoch of `every` calls: the `size` assets with the least draws; calls: call_no.

    Every asset is drawn in every epoch, in blocks; a draw becomes a row only if it is under
    a threshold that some more than `size` draws of the catalogue pass; epochs that it
    leaves short are ranked once more without one. Assets without a whole number go the second way.
    """
    epochs = saved(calls.select(F.floor(F.col("call_no") / every).cast("long").alias("epoch")).where("epoch IS NOT NULL").distinct(), "pool-epochs")
    assets = catalog.select("asset_id")
    order = Window.partitionBy("epoch").orderBy("u", "asset_id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.select("epoch", "asset_id", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= size)

    def all_drawn(wanted: DataFrame, of: DataFrame) -> DataFrame:
        return of.crossJoin(wanted).withColumn("u", K.unit(seed, "pool", "epoch", "asset_id"))

    kind, total = assets.schema["asset_id"].dataType.simpleString(), assets.count()
    if kind not in ("tinyint", "smallint", "int", "bigint") or total <= pool_margin(size):
        return ranked(all_drawn(epochs, assets))
    limit = math.ceil(2**32 * pool_margin(size) / total)
    width = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ids = assets.where("asset_id IS NOT NULL").select(F.col("asset_id").cast("long").alias("id"))
    ids = ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(-(-total // POOL_BLOCK)))).agg(F.collect_list("id").alias("ids"))
    firsts = epochs.groupBy(F.floor(F.col("epoch") / EPOCH_BLOCK)).agg(F.collect_list("epoch").alias("firsts"))
    blocks = firsts.select("firsts").crossJoin(ids.select("ids")).repartition(width)
    near = blocks.mapInArrow(_under(seed, limit), "epoch long, asset_id long, u double").withColumn("asset_id", F.col("asset_id").cast(kind))
    most = saved(ranked(near.unionByName(all_drawn(epochs, assets.where("asset_id IS NULL")))), "pool")
    short = saved(epochs.join(most.groupBy("epoch").count(), "epoch", "left").where(F.coalesce("count", F.lit(0)) < min(size, total)).select("epoch"), "pool-short")
    if not short.isEmpty():
        most = most.join(short, "epoch", "left_anti").unionByName(ranked(all_drawn(short, assets)))
    return most


def pool_margin(size: int) -> float:
    """How many draws should pass so that fewer than `size` pass but once in some 10^9 epochs."""
    return size + 6 * math.sqrt(size) + 10


def adapt_pool(hits: DataFrame, step: int = 5, low: float = 0.5, high: float = 0.8) -> DataFrame:
    """GEN-20: a pool's next size by its hit rate (size, hit_rate)."""
    return hits.withColumn("next_size", F.when(F.col("hit_rate") > high, F.col("size") - step).when(F.col("hit_rate") < low, F.col("size") + step).otherwise(F.col("size")))


def sample_frames(ids: DataFrame, n: int, key: str, seed: int, length: str = "length") -> DataFrame:
    """GEN-21: n frames from a drawn start, going round at the end."""
    start = K.randint(F.col(length), seed, "frame", key)
    return ids.withColumn("frames", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(start + i, F.col(length))))


def sample_assets(catalog: DataFrame, n: int, random: bool, seed: int) -> DataFrame:
    """GEN-23: the first n assets by id, or n drawn with replacement (pick, asset_id)."""
    ranked = running(catalog, "asset_id", name="r").withColumn("r", (F.col("r") - 1).cast("long"))
    if not random:
        return ranked.where(F.col("r") < n).withColumnRenamed("r", "pick")
    total = catalog.agg(F.count(F.lit(1)).alias("total"))
    picks = total.withColumn("pick", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("r", K.randint(F.col("total"), seed, "asset", "pick"))
    return picks.select("pick", "r").join(ranked, "r").drop("r")


def sample_points(matches: DataFrame, m: int, seed: int, order: list[str] = ("y2", "x2")) -> DataFrame:
    """WIN-8: m evenly spaced matches of each pair from a drawn phase: places rint(k + i r), r = n / m, k in [0, r); all of them if a pair has m or fewer."""
    w = Window.partitionBy("pair_id")
    ranked = matches.withColumns({"i": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(w)})
    r = F.col("n") / float(m)
    # place i is taken if some j has rint(k + j r) = i; that j is near (i - k) / r
    k = K.unit(seed, "phase", "pair_id") * r
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.rint((F.col("i") - k) / r) + d)
    taken = F.exists(near, lambda j: (j >= 0) & (j < m) & (F.least(F.rint(k + j * r), F.col("n") - 1) == F.col("i")))
    return ranked.where((F.col("n") <= m) | taken).drop("i", "n")
