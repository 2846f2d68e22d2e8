"""Points, boxes and pixel tables: PRJ-1..7, 9..11, 14..17, 22, 28, 31, 32."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import points as P
from ..functions.keyed import bernoulli, unit


def rescale_points(df: DataFrame, cols: list[tuple[str, str]], from_wh: tuple, to_wh: tuple, align_corners: bool = False, as_int: bool = False) -> DataFrame:
    """PRJ-1, PRJ-2: the (x, y) column pairs from images of one size to another."""
    out = {}
    for x, y in cols:
        for c, a, b in ((x, from_wh[0], to_wh[0]), (y, from_wh[1], to_wh[1])):
            out[c] = P.rescale_corners(F.col(c), a, b, as_int) if align_corners else F.col(c) * (b / a)
    return df.withColumns(out)


def rescale_box(df: DataFrame, box: str, from_wh: tuple, to_wh: tuple) -> DataFrame:
    """PRJ-3."""
    sx, sy = to_wh[0] / from_wh[0], to_wh[1] / from_wh[1]
    b = F.col(box)
    return df.withColumn(box, F.struct((b["x1"] * sx).alias("x1"), (b["y1"] * sy).alias("y1"), (b["x2"] * sx).alias("x2"), (b["y2"] * sy).alias("y2")))


def hflip(df: DataFrame, xs: list[str], width: float, when: Column, boxes: list[str] = ()) -> DataFrame:
    """PRJ-4: mirror points and boxes of the rows where the flag holds."""
    return df.withColumns({x: P.flip_x(F.col(x), width, when) for x in xs} | {b: P.flip_box(F.col(b), width, when) for b in boxes})


def crop_window(df: DataFrame, box: str, image: tuple, p: float, seed: int, key: str) -> DataFrame:
    """PRJ-5: crop (left, top, right, bottom) drawn by key so that the box stays inside; with probability 1 - p the whole image."""
    b, (w, h) = F.col(box), image
    take = bernoulli(p, seed, "crop", key)

    def draw(lo: Column, hi: Column, name: str) -> Column:
        return F.floor(lo + (hi - lo) * unit(seed, name, key))

    zero = F.lit(0.0)
    return df.withColumns({
        "crop_left": F.when(take, draw(zero, b["x1"], "left")).otherwise(F.lit(0)).cast("double"),
        "crop_top": F.when(take, draw(zero, b["y1"], "top")).otherwise(F.lit(0)).cast("double"),
        "crop_right": F.when(take, draw(b["x2"], F.lit(float(w)), "right")).otherwise(F.lit(w)).cast("double"),
        "crop_bottom": F.when(take, draw(b["y2"], F.lit(float(h)), "bottom")).otherwise(F.lit(h)).cast("double"),
    })


def crop_points(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """PRJ-5: points into the crop, scaled to size, kept within [0, size - 1]."""

    def into(c: str, a: str, b: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), (F.col(c) - F.col(a)) * size / (F.col(b) - F.col(a))))

    return df.withColumns({x: into(x, "crop_left", "crop_right"), y: into(y, "crop_top", "crop_bottom")})


def pack_keypoints(kp: DataFrame, max_pts: int, cols: tuple[str, str] = ("src_x", "src_y")) -> DataFrame:
    """PRJ-6: pair_id, xs, ys padded with -1 to max_pts, and n_pts; points in the order of kp_idx, those past max_pts left out."""
    packed = kp.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("kp_idx", *cols))).alias("p"))
    pad = F.array_repeat(F.lit(-1.0), max_pts)

    def padded(c: str) -> Column:
        return F.slice(F.concat(F.transform("p", lambda s: s[c]), pad), 1, max_pts)

    return packed.select("pair_id", padded(cols[0]).alias("xs"), padded(cols[1]).alias("ys"), F.least(F.size("p"), F.lit(max_pts)).cast("long").alias("n_pts"))


def unpack_keypoints(df: DataFrame) -> DataFrame:
    """PRJ-6: the inverse; padding disappears."""
    rows = df.select("pair_id", "n_pts", F.posexplode(F.arrays_zip("xs", "ys")).alias("kp_idx", "p"))
    return rows.where(F.col("kp_idx") < F.col("n_pts")).select("pair_id", F.col("kp_idx").cast("long").alias("kp_idx"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


#: The threshold mode of each benchmark.
THRESHOLD_MODES = {"pfpascal": "img", "pfwillow": "bbox-kp", "spair": "bbox", "caltech": "bbox", "cub": "bbox", "awa": "img", "tss": "img"}


def pck_threshold(pairs: DataFrame, kp: DataFrame | None = None, mode: str = "img", side: str = "src") -> DataFrame:
    """PRJ-7: pairs with thr, the length that alpha is relative to.

    img: the image's greater side; bbox: the greater side of the box struct
    `<side>_box`; bbox-kp: the greater range of the points of that side; auto: by
    the pair's benchmark.
    """
    image = F.greatest("w", "h").cast("double")
    box = F.col(f"{side}_box") if f"{side}_box" in pairs.columns else None
    by_box = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"]).cast("double") if box is not None else F.lit(None).cast("double")
    if mode in ("bbox-kp", "auto") and kp is not None:
        ranges = kp.groupBy("pair_id").agg(F.greatest(F.max(f"{side}_x") - F.min(f"{side}_x"), F.max(f"{side}_y") - F.min(f"{side}_y")).cast("double").alias("kp_range"))
        pairs = pairs.join(ranges, "pair_id", "left")
    by_points = F.col("kp_range") if "kp_range" in pairs.columns else F.lit(None).cast("double")
    options = {"img": image, "bbox": by_box, "bbox-kp": by_points}
    if mode != "auto":
        return pairs.withColumn("thr", options[mode]).drop("kp_range")
    chosen = F.lit(None).cast("double")
    for name, m in THRESHOLD_MODES.items():
        chosen = F.when(F.col("benchmark") == name, options[m]).otherwise(chosen)
    return pairs.withColumn("thr", F.coalesce(chosen, image)).drop("kp_range")


def mapping_to_flow(df: DataFrame, normalized: tuple | None = None) -> DataFrame:
    """PRJ-9: mx, my to dx, dy; normalized: (w, h) if the mapping is in [-1, 1]."""
    mx, my = F.col("mx"), F.col("my")
    if normalized:
        mx, my = P.unnormalize(mx, normalized[0]), P.unnormalize(my, normalized[1])
    return df.withColumns({"dx": mx - F.col("x"), "dy": my - F.col("y")})


def flow_to_mapping(df: DataFrame, normalized: tuple | None = None) -> DataFrame:
    """PRJ-9: dx, dy to mx, my."""
    mx, my = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    if normalized:
        mx, my = P.normalize(mx, normalized[0]), P.normalize(my, normalized[1])
    return df.withColumns({"mx": mx, "my": my})


def scale_flow(df: DataFrame, from_wh: tuple, to_wh: tuple, cols: tuple[str, str] = ("dx", "dy")) -> DataFrame:
    """PRJ-10."""
    return df.withColumns({cols[0]: F.col(cols[0]) * (to_wh[0] / from_wh[0]), cols[1]: F.col(cols[1]) * (to_wh[1] / from_wh[1])})


#: Channel means and deviations by preset.
PRESETS = {"imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), "half": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))}


def standardize(df: DataFrame, preset: str, channels: tuple[str, str, str] = ("r", "g", "b"), inverse: bool = False) -> DataFrame:
    """PRJ-11: (v - mean) / std for each channel, or back."""
    mean, std = PRESETS[preset]
    return df.withColumns({c: F.col(c) * s + m if inverse else (F.col(c) - m) / s for c, m, s in zip(channels, mean, std)})


def warp_points(df: DataFrame, matrix: str, x: str = "x", y: str = "y", projective: bool = False, eps: float = 0.0) -> DataFrame:
    """PRJ-13, PRJ-14: points under the 3x3 in a column, as wx, wy."""
    a, b = P.homography(F.col(matrix), F.col(x), F.col(y), eps) if projective else P.affine(F.col(matrix), F.col(x), F.col(y))
    return df.withColumns({"wx": a, "wy": b})


def pixel_grid(df: DataFrame, w: int, h: int) -> DataFrame:
    """Every row with every pixel (y, x) of a w by h image."""
    rows = df.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))))


def homography_flow(h_df: DataFrame, w: int, h: int, matrix: str = "mat") -> DataFrame:
    """PRJ-16: per pixel of the target the place in the source under the inverse homography, and flow; places outside are NULL."""
    grid = warp_points(pixel_grid(h_df, w, h), matrix, projective=True, eps=1e-8)
    inside = F.col("wx").between(0, w - 1) & F.col("wy").between(0, h - 1)
    return grid.withColumns({"valid": F.coalesce(inside, F.lit(False)), "dx": F.when(inside, F.col("wx") - F.col("x")), "dy": F.when(inside, F.col("wy") - F.col("y"))}).drop("wx", "wy")


def warp_tps(points: DataFrame, centers: DataFrame, key: list[str]) -> DataFrame:
    """PRJ-17: points (key, warp_id, x, y) under thin-plate splines with given weights.

    centers: warp_id, cx, cy, kx, ky (kernel weights) and the affine part a0x, ax, bx,
    a0y, ay, by, the same in all rows of a warp_id; U(r) = r^2 log r^2, and 0 at 0.
    """
    rows = points.join(centers, "warp_id")
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    u = F.when(d2 == 0, F.lit(0.0)).otherwise(d2 * F.log(d2))
    affine = [F.first(c).alias(c) for c in ("a0x", "ax", "bx", "a0y", "ay", "by")]
    out = rows.groupBy("warp_id", *key, "x", "y").agg(F.sum(F.col("kx") * u).alias("sx"), F.sum(F.col("ky") * u).alias("sy"), *affine)
    return out.select("warp_id", *key, "x", "y", (F.col("a0x") + F.col("ax") * F.col("x") + F.col("bx") * F.col("y") + F.col("sx")).alias("wx"), (F.col("a0y") + F.col("ay") * F.col("x") + F.col("by") * F.col("y") + F.col("sy")).alias("wy"))


def category_index(df: DataFrame, names: list[str] | None = None, col: str = "category") -> DataFrame:
    """PRJ-22, SET-5: category_id from a list of names, or from the sorted distinct ones."""
    spark = df.sparkSession
    if names is not None:
        table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{col} string, category_id long")
    else:
        table = df.select(col).where(F.col(col).isNotNull()).distinct()
        table = table.withColumn("category_id", (F.row_number().over(Window.orderBy(col)) - 1).cast("long"))
    return df.join(table, col, "left")


def make_bidirectional(df: DataFrame) -> DataFrame:
    """PRJ-28, SET-2: every pair in both directions; src_* and trg_* columns change places, others repeat."""
    turned = {c: ("trg_" + c[4:] if c.startswith("src_") else "src_" + c[4:] if c.startswith("trg_") else c) for c in df.columns}
    back = df.select(*[F.col(turned[c]).alias(c) if turned[c] in df.columns else F.col(c) for c in df.columns])
    return df.withColumn("reverse", F.lit(False)).unionByName(back.withColumn("reverse", F.lit(True)))


def next_run(paths: DataFrame, col: str = "path") -> DataFrame:
    """PRJ-31: one more than the greatest run-N, 0 without any."""
    n = F.regexp_extract(col, "run-(\\d+)", 1)
    return paths.agg(F.coalesce(F.max(F.when(n != "", n.cast("long"))) + 1, F.lit(0)).cast("long").alias("next_run"))


def crop_pixels(df: DataFrame, top: int, left: int, h: int, w: int) -> DataFrame:
    """PRJ-32: the pixels of a window, numbered from its corner."""
    inside = F.col("y").between(top, top + h - 1) & F.col("x").between(left, left + w - 1)
    return df.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def interpolate_config(a: dict, b: dict, x: Column) -> dict:
    """PRJ-24 over a config: numbers move from a to b with x, strings stay those of a."""
    return {k: P.interpolate(float(v), float(b[k]), x) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(v) for k, v in a.items()}
