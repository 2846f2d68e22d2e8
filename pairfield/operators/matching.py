"""Joins of annotations, surfaces and features: JON-1..13, 19, 21, WIN-1, 2, AGG-33..37, TOP-6, SET-3, 4."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import bernoulli, randint

RADIUS_SQ = 5e-5


def attach_annotations(pairs: DataFrame, ann: DataFrame) -> DataFrame:
    """JON-1: points of both images of a pair, aligned by kp_idx; ann: image, kp_idx, x, y."""
    src = pairs.join(ann.select(F.col("image").alias("src_image"), "kp_idx", F.col("x").alias("src_x"), F.col("y").alias("src_y")), "src_image")
    trg = ann.select(F.col("image").alias("trg_image"), "kp_idx", F.col("x").alias("trg_x"), F.col("y").alias("trg_y"))
    return src.join(trg, ["trg_image", "kp_idx"])


def common_joints(pairs: DataFrame, joints: DataFrame) -> DataFrame:
    """JON-2, SET-3: joints that both images name, with both coordinates of both seen (not -1)."""
    seen = joints.where((F.col("x") != -1) & (F.col("y") != -1))
    a = seen.select(F.col("image").alias("src_image"), "joint", F.col("x").alias("src_x"), F.col("y").alias("src_y"))
    b = seen.select(F.col("image").alias("trg_image"), "joint", F.col("x").alias("trg_x"), F.col("y").alias("trg_y"))
    return pairs.join(a, "src_image").join(b, ["trg_image", "joint"])


def common_visible(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """JON-3: parts visible in both images (the product of the flags is 1)."""
    a = parts.select(F.col("image").alias("src_image"), "part_id", F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.col("visible").alias("v1"))
    b = parts.select(F.col("image").alias("trg_image"), "part_id", F.col("x").alias("trg_x"), F.col("y").alias("trg_y"), F.col("visible").alias("v2"))
    return pairs.join(a, "src_image").join(b, ["trg_image", "part_id"]).where(F.col("v1") * F.col("v2") == 1).drop("v1", "v2")


def assemble_images(images: DataFrame, classes: DataFrame, boxes: DataFrame, splits: DataFrame) -> DataFrame:
    """JON-4: one row for each image with its class, box and split; the small tables are for Spark to broadcast."""
    return images.join(boxes, "image_id").join(splits, "image_id").join(classes, "class_id", "left")


def exists_in(df: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """JON-21."""
    return df.join(listing.select(key), key, "left_semi")


def missing_from(df: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """JON-21."""
    return df.join(listing.select(key), key, "left_anti")


def cells_for_points(points: DataFrame, feat: tuple[int, int], stride: int, rf: int, x: str = "trg_x", y: str = "trg_y") -> DataFrame:
    """JON-5: the cells (row, col) of a feature grid whose receptive fields hold the point, ends included.

    Cell c covers stride * c + stride // 2 -/+ rf // 2; turned round, a point lies in
    a run of rows and of columns, so nothing is joined.
    """
    half, centre = rf // 2, stride // 2

    def run(c: str, n: int) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((F.col(c) - centre - half) / stride).cast("int"))
        hi = F.least(F.lit(n - 1), F.floor((F.col(c) - centre + half) / stride).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("array()"))

    return points.withColumn("row", F.explode(run(y, feat[0]))).withColumn("col", F.explode(run(x, feat[1])))


def _edge(max_sq: float) -> tuple[float, float]:
    """Radius, with a little to spare for rounding, and the edge of a cube."""
    radius = math.sqrt(max_sq) * (1 + 1e-9)
    return radius, 2 * radius


def _cube(places: list[Column]) -> Column:
    """One number for a cube; two cubes with one number only meet in vain."""
    return F.xxhash64(*places)


def near_pixels(src: DataFrame, trg: DataFrame, by: list[str], max_sq: float, also: Column | None = None, unmatched: bool = False) -> DataFrame:
    """Pairs of a source pixel (y1, x1) and a target pixel (y2, x2) within the radius, with d2 and the target's __cube; background (0, 0, 0) has none.

    src: by, y1, x1, sx, sy, sz; trg: by, y2, x2, cx, cy, cz; both may have more columns.
    Space is cut into cubes of an edge of twice the radius. A target pixel stands in
    its own cube; what is within the radius of a source pixel can only lie in the 8 cubes on
    its nearer halves, so there it stands 8 times and a pair meets once, and all pairs of a
    target pixel meet in one cube. The join is on one number for `by` and cube, as Spark sorts by one
    number without comparing rows, and by sorting: Spark's guess of a size knows nothing of the copies.
    also: a condition of the pairs. unmatched: target pixels without a pair give one row, whose source is NULL.
    """
    radius, edge = _edge(max_sq)
    own = {c: F.floor(F.col(f"s{c}") / edge).cast("long") for c in "xyz"}
    sides = {c: (v, v + F.when(F.col(f"s{c}") - v * edge >= radius, 1).otherwise(-1)) for c, v in own.items()}
    # equal values of two types have two hashes: such columns stay keys of the join
    kinds = [dict(df.dtypes) for df in (src, trg)]
    hashed = [c for c in by if kinds[0][c] == kinds[1][c]]
    part = [F.col(c) for c in hashed]
    # sides first, as columns: the explode would work them out again for each of its cubes
    s = src.where("NOT (sx = 0 AND sy = 0 AND sz = 0)").withColumns({f"__{c}{k}": v for c, two in sides.items() for k, v in enumerate(two)})
    s = s.withColumn("__meet", F.explode(F.array(*[_cube([*part, *(F.col(f"__{c}{i >> k & 1}") for k, c in enumerate("xyz"))]) for i in range(8)]))).drop(*[f"__{c}{k}" for c in "xyz" for k in (0, 1)])
    s = s.withColumnsRenamed({c: f"__{c}" for c in by})
    t = trg.withColumn("__cube", _cube([*part, *(F.floor(F.col(f"c{c}") / edge).cast("long") for c in "xyz")]))
    d2 = sum(((F.col(f"c{c}") - F.col(f"s{c}")) * (F.col(f"c{c}") - F.col(f"s{c}")) for c in "yz"), (F.col("cx") - F.col("sx")) * (F.col("cx") - F.col("sx")))
    near = F.col("__cube") == F.col("__meet")
    near = (near if also is None else near & also) & (d2 <= max_sq) & ~((F.col("cx") == 0) & (F.col("cy") == 0) & (F.col("cz") == 0))
    for c in by:
        # said as no equality, which would become a key
        near &= (F.col(c) >= F.col(f"__{c}")) & (F.col(c) <= F.col(f"__{c}")) if c in hashed else F.col(c) == F.col(f"__{c}")
    pairs = t.join(s.hint("merge"), near, "left" if unmatched else "inner")
    return pairs.withColumn("d2", d2).drop("__meet", *[f"__{c}" for c in by])


def _sources(df: DataFrame, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.col("y").alias("y1"), F.col("x").alias("x1"), *[F.col(f"c{c}").alias(f"s{c}") for c in "xyz"])


def _targets(df: DataFrame, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.col("y").alias("y2"), F.col("x").alias("x2"), "cx", "cy", "cz")


def _nearest(near: DataFrame, by: list[str]) -> DataFrame:
    """The nearest source pixel of each target pixel; its pairs lie in one cube, so they are not shuffled again. The first key is a hash, as Spark compares rows only where the first key ties."""
    best = near.groupBy(F.xxhash64(*by, "y2", "x2").alias("__pixel"), *by, "y2", "x2", "__cube").agg(F.min(F.when(F.col("y1").isNotNull(), F.struct("d2", "y1", "x1"))).alias("m"))
    return best.select(*by, "y2", "x2", F.col("m.y1").alias("y1"), F.col("m.x1").alias("x1"), F.col("m.d2").alias("d2"))


def match_surfaces(src: DataFrame, trg: DataFrame, by: list[str], max_sq: float = RADIUS_SQ, unmatched: bool = False) -> DataFrame:
    """JON-6: for each target pixel the nearest source pixel in 3-D, if the squared distance is at most max_sq; ties go to the least (y, x). unmatched: target pixels without one are NULL, not left out."""
    return _nearest(near_pixels(_sources(src, *by), _targets(trg, *by), by, max_sq, unmatched=unmatched), by)


def matches_to_flow(matches: DataFrame, by: list[str], grid: DataFrame | None = None) -> DataFrame:
    """JON-7: source minus target at the target pixel; with a grid (by, y, x) pixels without a match are NULL."""
    flow = matches.select(*by, F.col("y2").alias("y"), F.col("x2").alias("x"), (F.col("x1") - F.col("x2")).cast("double").alias("dx"), (F.col("y1") - F.col("y2")).cast("double").alias("dy"))
    return flow if grid is None else grid.select(*by, "y", "x").join(flow, [*by, "y", "x"], "left")


def image_pairs(images: DataFrame) -> DataFrame:
    """JON-8: all unordered pairs of an object's images."""
    a = images.select("object_id", F.col("image_id").alias("image1"))
    b = images.select("object_id", F.col("image_id").alias("image2"))
    return a.join(b, "object_id").where("image1 < image2")


def _view_pairs(surface: DataFrame, max_sq: float, later: Column, *keep: str) -> DataFrame:
    """Pixels within the radius in the image pairs of all objects for which `later` holds; keep: columns of the surface, as name1 and name2.

    The join runs on (object, cube), never on images alone.
    """
    kept = [[F.col(c).alias(f"{c}{i}") for c in keep] for i in (1, 2)]
    s = _sources(surface, "object_id", F.col("image_id").alias("image1"), *kept[0])
    t = _targets(surface, "object_id", F.col("image_id").alias("image2"), *kept[1])
    return near_pixels(s, t, ["object_id"], max_sq, later)


def pairwise_matches(surface: DataFrame, max_sq: float = RADIUS_SQ) -> DataFrame:
    """JON-9: matches of all image pairs a < b of each object, keyed 'a-b'; b's pixels query a's."""
    best = _nearest(_view_pairs(surface, max_sq, F.col("image1") < F.col("image2")), ["object_id", "image1", "image2"])
    return best.withColumn("pair", F.concat_ws("-", F.col("image1").cast("string"), F.col("image2").cast("string")))


def view_overlap(surface: DataFrame, max_sq: float = RADIUS_SQ) -> DataFrame:
    """AGG-20, TOP-2: matches of two views over their mean of visible pixels; the view with fewer pixels (then the greater id) queries.

    Which pixel matches is not asked for: target pixels that have a match are bits of
    64-pixel words, or-ed before they are shuffled and counted after.
    """
    seen = surface.where("NOT (cx = 0 AND cy = 0 AND cz = 0)").groupBy("object_id", "image_id").agg(F.count(F.lit(1)).alias("n"))
    later = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("image1") < F.col("image2")))
    near = _view_pairs(surface.join(seen, ["object_id", "image_id"]), max_sq, later, "n")
    column = F.expr("CAST(floor(x2 / 64) AS BIGINT)").alias("word")
    words = near.groupBy("object_id", "image1", "image2", "y2", column).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(x2, 64) AS INT))")).alias("bits"))
    counts = words.groupBy("object_id", "image1", "image2").agg(F.sum(F.bit_count("bits")).alias("matches"))
    a, b = (seen.select("object_id", F.col("image_id").alias(f"image{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    every = a.join(b, "object_id").where(later)
    return every.join(counts, ["object_id", "image1", "image2"], "left").select("object_id", "image1", "image2", (F.coalesce("matches", F.lit(0)) / (0.5 * (F.col("n1") + F.col("n2")))).alias("overlap"))


def rank_overlaps(df: DataFrame) -> DataFrame:
    """TOP-1."""
    return df.orderBy(F.col("overlap").desc(), "object_id", "image1", "image2")


def unit_vec(vec: Column, eps: float = 0.0) -> Column:
    """A vector over its length, sqrt(sum of squares + eps)."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) + F.lit(eps))
    return F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(norm, F.size(v)).alias("n")), lambda s: F.try_divide(s["v"], s["n"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def correlate(src: DataFrame, trg: DataFrame, clamp: bool = False, eps: float = 1e-5) -> DataFrame:
    """JON-10: cosine of every source and target patch of a pair; both: pair_id, pos, vec."""
    a = src.select("pair_id", F.col("pos").alias("src_pos"), unit_vec(F.col("vec"), eps).alias("a"))
    b = trg.select("pair_id", F.col("pos").alias("trg_pos"), unit_vec(F.col("vec"), eps).alias("b"))
    score = dot(F.col("a"), F.col("b"))
    return a.join(b, "pair_id").select("pair_id", "src_pos", "trg_pos", (F.greatest(score, F.lit(0.0)) if clamp else score).alias("score"))


def correlate_blocked(src: DataFrame, trg: DataFrame, top: int | None = None, eps: float = 1e-5) -> DataFrame:
    """JON-10 by matrix products, a pair at a time; top keeps each source patch's best, so that the volume stays sparse."""

    def matrix(table: pa.Table) -> np.ndarray:
        m = np.array(table.column("vec").to_pylist(), float).reshape(table.num_rows, -1)
        return m / np.sqrt((m * m).sum(1, keepdims=True) + eps)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"pair_id": pa.array([], pa.int64()), "src_pos": pa.array([], pa.int64()), "trg_pos": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        c = matrix(left) @ matrix(right).T
        s, t = left.column("pos").to_numpy(), right.column("pos").to_numpy()
        k = len(t) if top is None else min(top, len(t))
        best = np.argsort(-c, axis=1, kind="stable")[:, :k]
        return pa.table({"pair_id": pa.array(np.full(len(s) * k, left.column("pair_id")[0].as_py())), "src_pos": pa.array(np.repeat(s, k)), "trg_pos": pa.array(t[best].ravel()), "score": pa.array(np.take_along_axis(c, best, 1).ravel())})

    a, b = src.select("pair_id", "pos", "vec").groupBy("pair_id"), trg.select("pair_id", "pos", "vec").groupBy("pair_id")
    return a.cogroup(b).applyInArrow(run, "pair_id long, src_pos long, trg_pos long, score double")


#: Scores that a task works out at once.
SCORES = 4_000_000


def best_matches(src: DataFrame, trg: DataFrame, eps: float = 1e-5) -> DataFrame:
    """JON-10, WIN-2, TOP-6 at once: each source patch's best target, its score, and whether each is the other's best; ties go to the least position.

    The scores of a pair run through a task in blocks of rows; none of them becomes a row.
    """

    def matrix(table: pa.Table) -> np.ndarray:
        m = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        return m / np.sqrt((m * m).sum(1, keepdims=True) + eps)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.sort_by(t.column_names[1]) for t in (left, right))
        n, m = (left.num_rows, right.num_rows) if left.num_rows and right.num_rows else (0, 0)
        to, score = np.zeros(n, np.int64), np.zeros(n)
        top, back = np.full(m, -np.inf), np.zeros(m, np.int64)
        if n:
            a, b, step = matrix(left), matrix(right), max(1, SCORES // m)
            for i in range(0, n, step):
                c = a[i : i + step] @ b.T
                to[i : i + step] = c.argmax(1)
                score[i : i + step] = c.max(1)
                more = c.max(0) > top
                back[more], top[more] = c[:, more].argmax(0) + i, c[:, more].max(0)
        s, t = (x.column(1).to_numpy() if n else np.zeros(0, np.int64) for x in (left, right))
        names = left.column(0).combine_chunks() if n else pa.array([], pa.int64())
        return pa.table({"pair_id": names, "src_pos": s, "trg_pos": t[to] if n else s, "mutual": back[to] == np.arange(n) if n else np.zeros(0, bool), "score": score})

    # names of their own, as both sides may come from one table
    a = src.select(*[F.col(c).alias(f"src_{c}") for c in ("pair_id", "pos", "vec")]).groupBy("src_pair_id")
    b = trg.select(*[F.col(c).alias(f"trg_{c}") for c in ("pair_id", "pos", "vec")]).groupBy("trg_pair_id")
    return a.cogroup(b).applyInArrow(run, "pair_id long, src_pos long, trg_pos long, mutual boolean, score double")


#: Cells of a tile's side.
TILE = 16


def window_products(cells: DataFrame, around: DataFrame, key: str, offsets: list[tuple[int, int]], cosine: bool = False, mean: bool = False) -> DataFrame:
    """key, row_i, col_i, oy, ox, score: products of each cell's vector with those of `around` at the offsets; where that has no cell 0.

    Cells go to tiles of TILE by TILE, those of `around` to each tile whose halo, as wide
    as the offsets reach, they lie in: one to four for most. Products run inside the tile, so no
    vector is copied for each offset. cosine: vectors of length 1; a vector of no length has score
    NULL. mean: over the channels. Both tables: key, row_i, col_i, vec, with one row a cell.
    """
    reach = max((max(abs(y), abs(x)) for y, x in offsets), default=0)
    kind = dict(cells.dtypes)[key]

    def tile(c: str, to: int) -> Column:
        return F.floor((F.col(c) + to) / TILE).cast("long")

    def spread(c: str) -> Column:
        return F.explode(F.sequence(tile(c, -reach), tile(c, reach)))

    own = cells.select(key, "row_i", "col_i", "vec", tile("row_i", 0).alias("tr"), tile("col_i", 0).alias("tc"))
    # names of its own: of a table that meets itself, Spark would else drop columns of one side
    halo = around.withColumn("tr", spread("row_i")).withColumn("tc", spread("col_i")).select(*[F.col(c).alias(f"around_{c}") for c in (key, "row_i", "col_i", "vec", "tr", "tc")])

    def matrix(table: pa.Table) -> np.ndarray:
        m = table.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        if cosine:
            n = np.sqrt((m * m).sum(1, keepdims=True))
            m = np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)
        return m

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        y, x = (left.column(c).to_numpy().astype(np.int64) for c in ("row_i", "col_i"))
        names, out = left.column(key).combine_chunks(), []
        if left.num_rows:
            top, side = (left.column("tr")[0].as_py() * TILE - reach, left.column("tc")[0].as_py() * TILE - reach), TILE + 2 * reach
            at = np.full((side, side), -1)
            if right.num_rows:
                at[right.column(1).to_numpy().astype(np.int64) - top[0], right.column(2).to_numpy().astype(np.int64) - top[1]] = np.arange(right.num_rows)
            b, a = matrix(left), matrix(right) if right.num_rows else None
            for oy, ox in offsets:
                j = at[y + oy - top[0], x + ox - top[1]]
                score, there = np.zeros(len(y)), j >= 0
                if there.any():
                    score[there] = np.einsum("ij,ij->i", b[there], a[j[there]]) / (b.shape[1] if mean else 1)
                out.append((oy, ox, score))
        n = left.num_rows
        score = np.concatenate([s for *_, s in out] or [np.zeros(0)])
        return pa.table({
            key: pa.concat_arrays([names] * len(out)) if out else names.slice(0, 0), "row_i": np.tile(y, len(out)), "col_i": np.tile(x, len(out)),
            "oy": pa.array(np.repeat(np.array([o[0] for o in out], np.int32), n)), "ox": pa.array(np.repeat(np.array([o[1] for o in out], np.int32), n)), "score": pa.array(score, mask=np.isnan(score)),
        })

    return own.groupBy(key, "tr", "tc").cogroup(halo.groupBy(*[f"around_{c}" for c in (key, "tr", "tc")])).applyInArrow(run, f"{key} {kind}, row_i long, col_i long, oy int, ox int, score double")


def _square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def correlate_local(src: DataFrame, trg: DataFrame, k: int, mode: str = "cosine") -> DataFrame:
    """JON-11: each target cell against the k by k source cells around it; outside the grid 0. mode raw: dot over channels."""
    return window_products(trg, src, "pair_id", _square(k), cosine=mode == "cosine", mean=mode != "cosine")


def correlate_blocks(src: DataFrame, trg: DataFrame, coarse: DataFrame, ratio: int) -> DataFrame:
    """JON-12: patches inside coarse blocks that match; coarse: pair_id, src_block (row, col), trg_block; ratio patches a side of a block."""

    def blocked(df: DataFrame, side: str) -> DataFrame:
        return df.select("pair_id", F.floor(F.col("row_i") / ratio).cast("long").alias(f"{side}_brow"), F.floor(F.col("col_i") / ratio).cast("long").alias(f"{side}_bcol"), F.col("pos").alias(f"{side}_pos"), unit_vec(F.col("vec")).alias(side))

    joined = coarse.join(blocked(src, "src"), ["pair_id", "src_brow", "src_bcol"]).join(blocked(trg, "trg"), ["pair_id", "trg_brow", "trg_bcol"])
    return joined.select("pair_id", "src_pos", "trg_pos", dot(F.col("src"), F.col("trg")).alias("score"))


#: JON-13: offsets of the four directions without the centre.
_DIRECTIONS = {"diagonal": (1, 1), "column": (1, 0), "anti": (1, -1), "row": (0, 1)}


def self_similarity(feat: DataFrame, k: int, pattern: str = "full") -> DataFrame:
    """JON-13: dot products of each cell with its neighbourhood, 0 outside; full: k by k, sparse: four directions without the centre."""
    r = k // 2
    offsets = _square(k) if pattern == "full" else [(d[0] * i, d[1] * i) for d in _DIRECTIONS.values() for i in range(-r, r + 1) if i]
    return window_products(feat, feat, "image_id", offsets)


def mutual_nn(corr: DataFrame, eps: float = 1e-7) -> DataFrame:
    """WIN-1: score times its share of the row's and of the column's maximum; a maximum of 0 counts as eps."""

    def share(key: str) -> Column:
        m = F.max("score").over(Window.partitionBy("pair_id", key))
        return F.col("score") / F.when(m == 0, F.lit(eps)).otherwise(m)

    return corr.withColumn("filtered", F.col("score") * share("src_pos") * share("trg_pos"))


def mutual_nn_pairs(corr: DataFrame) -> DataFrame:
    """WIN-2: pairs that are each other's best; ties go to the least position."""
    a = F.row_number().over(Window.partitionBy("pair_id", "src_pos").orderBy(F.col("score").desc(), "trg_pos"))
    b = F.row_number().over(Window.partitionBy("pair_id", "trg_pos").orderBy(F.col("score").desc(), "src_pos"))
    return corr.withColumns({"ra": a, "rb": b}).where("ra = 1 AND rb = 1").drop("ra", "rb")


def argmax_match(corr: DataFrame) -> DataFrame:
    """TOP-6: the best target of each source cell; ties go to the least position."""
    best = corr.groupBy("pair_id", "src_pos").agg(F.max(F.struct("score", (-F.col("trg_pos")).alias("t"))).alias("m"))
    return best.select("pair_id", "src_pos", (-F.col("m.t")).alias("trg_pos"), F.col("m.score").alias("score"))


def soft_argmax(corr: DataFrame, width: int, beta: float = 0.02, normalized: int | None = None) -> DataFrame:
    """AGG-33: expected (x, y) of the target under a softmax over the source cell's scores; normalized: grid size for [-1, 1]."""
    w = Window.partitionBy("pair_id", "src_pos")
    e = corr.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / beta))
    x, y = F.col("trg_pos") % width, F.floor(F.col("trg_pos") / width)
    if normalized:
        x, y = 2 * x / (normalized - 1) - 1, 2 * y / (normalized - 1) - 1
    return e.groupBy("pair_id", "src_pos").agg((F.sum(F.col("e") * x) / F.sum("e")).alias("x"), (F.sum(F.col("e") * y) / F.sum("e")).alias("y"))


def gaussian_gate(corr: DataFrame, width: int, sigma: float = 5.0) -> DataFrame:
    """AGG-34: scores times a Gaussian around the best match of the source cell."""
    w = Window.partitionBy("pair_id", "src_pos")
    best = -F.max(F.struct("score", (-F.col("trg_pos")).alias("t"))).over(w)["t"]
    dx, dy = F.col("trg_pos") % width - best % width, F.floor(F.col("trg_pos") / width) - F.floor(best / width)
    return corr.withColumn("score", F.col("score") * F.exp(-(dx * dx + dy * dy) / F.lit(2.0 * sigma * sigma)))


def max_pool4d(corr: DataFrame, src_width: int, trg_width: int, k: int) -> DataFrame:
    """AGG-35: the greatest score of k^4 blocks and where in the block it was; ties go to the least offsets."""

    def cell(pos: str, width: int) -> tuple[Column, Column]:
        return F.floor(F.col(pos) / width), F.col(pos) % width

    (a, b), (c, d) = cell("src_pos", src_width), cell("trg_pos", trg_width)
    offset = ((a % k * k + b % k) * k + c % k) * k + d % k
    rows = corr.select("pair_id", *[F.floor(v / k).cast("long").alias(n) for v, n in ((a, "i"), (b, "j"), (c, "k"), (d, "l"))], "score", (-offset).cast("long").alias("o"))
    return rows.groupBy("pair_id", "i", "j", "k", "l").agg(F.max(F.struct("score", "o")).alias("m")).select("pair_id", "i", "j", "k", "l", F.col("m.score").alias("score"), (-F.col("m.o")).alias("offset"))


def covisibility(corr: DataFrame) -> DataFrame:
    """AGG-36: sums of scores of each source and each target cell."""
    a = corr.groupBy("pair_id", F.col("src_pos").alias("pos")).agg(F.sum("score").alias("total")).withColumn("side", F.lit("src"))
    b = corr.groupBy("pair_id", F.col("trg_pos").alias("pos")).agg(F.sum("score").alias("total")).withColumn("side", F.lit("trg"))
    return a.unionByName(b)


def covisibility_loss(corr: DataFrame, matched: DataFrame) -> DataFrame:
    """AGG-36: 1 - tanh(3 v) on average, v the mean score of matched less that of other cells of a pair; matched: pair_id, src_pos, trg_pos."""
    marked = corr.join(matched.withColumn("m", F.lit(1)), ["pair_id", "src_pos", "trg_pos"], "left")
    v = marked.groupBy("pair_id").agg((F.avg(F.when(F.col("m") == 1, F.col("score"))) - F.avg(F.when(F.col("m").isNull(), F.col("score")))).alias("v"))
    return v.agg(F.avg(1 - F.tanh(3 * F.col("v"))).alias("loss"))


def mean_corr(corrs: list[DataFrame]) -> DataFrame:
    """AGG-37: the mean over layers."""
    every = corrs[0]
    for c in corrs[1:]:
        every = every.unionByName(c)
    return every.groupBy("pair_id", "src_pos", "trg_pos").agg(F.avg("score").alias("score"))


def assign_match(df: DataFrame, key: str, group: str, p: float, seed: int) -> DataFrame:
    """JON-19, SET-4: each row's own id with probability p, else another of its group, found by a shift of its rank: no row is compared with all others."""
    w = Window.partitionBy(group).orderBy(key)
    ranked = df.withColumns({"rank": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(group))})
    shift = F.when(bernoulli(p, seed, "match", key) | (F.col("n") < 2), F.lit(0)).otherwise(1 + randint(F.col("n") - 1, seed, "other", key))
    wanted = ranked.withColumn("want", (F.col("rank") + shift) % F.col("n"))
    pool = ranked.select(group, F.col("rank").alias("want"), F.col(key).alias("match_id"))
    return wanted.join(pool, [group, "want"]).drop("rank", "n", "want")
