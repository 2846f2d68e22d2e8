"""Filters and sentinels: FLT-1..11."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ("src_x", "src_y", "trg_x", "trg_y")


def valid_keypoints(df: DataFrame, cols: tuple[str, ...] = POINT) -> DataFrame:
    """FLT-1: neither NULL nor NaN on either side."""
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols]))


def foreground(df: DataFrame, cols: tuple[str, ...] = ("cx", "cy", "cz")) -> DataFrame:
    """FLT-2: some coordinate is not 0."""
    return df.where(reduce(Column.__or__, [F.col(c) != 0 for c in cols]))


def flow_is_valid(dx: str = "dx", dy: str = "dy", invalid: str = "inf") -> Column:
    """FLT-3: NULL is never valid; 'inf' rules out infinities and NaN, 'zero' rules out (0, 0)."""
    there = F.col(dx).isNotNull() & F.col(dy).isNotNull()
    if invalid == "zero":
        return there & ~((F.col(dx) == 0) & (F.col(dy) == 0))
    big = F.lit(float("inf"))
    return there & (F.abs(F.col(dx)) < big) & (F.abs(F.col(dy)) < big)


def valid_flow(df: DataFrame, invalid: str = "inf") -> DataFrame:
    return df.where(flow_is_valid(invalid=invalid))


#: FLT-4: which values of a rule stand for NULL.
_SENTINELS = {
    "inf": lambda c: (F.abs(c) == float("inf")) | F.isnan(c),
    "large": lambda c: F.abs(c) > 1e9,
    "minus_one": lambda c: c == -1,
}


def to_null(df: DataFrame, rule: str, cols: tuple[str, ...] = ("dx", "dy")) -> DataFrame:
    """FLT-4: a row's columns become NULL together where one holds the sentinel; 'zero' asks that all are 0."""
    cells = [F.col(c).cast("double") for c in cols]
    bad = reduce(Column.__and__, [c == 0 for c in cells]) if rule == "zero" else reduce(Column.__or__, [_SENTINELS[rule](c) for c in cells])
    return df.withColumns({c: F.when(~F.coalesce(bad, F.lit(True)), F.col(c)) for c in cols})


def from_null(df: DataFrame, rule: str, cols: tuple[str, ...] = ("dx", "dy")) -> DataFrame:
    """FLT-4: the sentinel for NULL."""
    value = {"inf": float("inf"), "large": 1e10, "minus_one": -1.0, "zero": 0.0}[rule]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def in_bounds(df: DataFrame, w: int, h: int, x: str = "mx", y: str = "my") -> DataFrame:
    """FLT-5: the mapped place lies in the image."""
    return df.where(F.col(x).between(0, w - 1) & F.col(y).between(0, h - 1))


def nonzero_border(df: DataFrame, eps: float, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """FLT-6: not all channels are below eps."""
    return df.where(reduce(Column.__or__, [F.col(c) >= eps for c in cols]))


def select_occlusion(df: DataFrame, mode: str, occ: str = "valid_occ", noc: str = "valid_noc") -> DataFrame:
    """FLT-7: occ keeps all valid pixels, noc the visible ones, only_occ the occluded ones."""
    keep = {"occ": F.col(occ), "noc": F.col(noc), "only_occ": F.col(occ) & ~F.col(noc)}
    return df.where(keep[mode])


def crop_matches(df: DataFrame, crop1: tuple, crop2: tuple) -> DataFrame:
    """FLT-8: both ends of a match lie in their crops (top, left, h, w); places count from the crops' corners."""
    out = df.withColumns({"y1": F.col("y1") - crop1[0], "x1": F.col("x1") - crop1[1], "y2": F.col("y2") - crop2[0], "x2": F.col("x2") - crop2[1]})
    return out.where(reduce(Column.__and__, [(F.col(c) >= 0) & (F.col(c) < size - 1) for c, size in (("y1", crop1[2]), ("x1", crop1[3]), ("y2", crop2[2]), ("x2", crop2[3]))]))


def select_split(df: DataFrame, split: str, flags: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """FLT-10: by the split column, or by a table (key, is_train)."""
    if flags is None:
        return df.where(F.col("split") == split)
    return df.join(flags.where(F.col("is_train") == F.lit(split == "train")).select(key), key, "left_semi")


def sample_flow_grid(flow: DataFrame, w: int, h: int, density: int) -> DataFrame:
    """FLT-11: valid flow at regular steps, as lines from (x, y) to (ex, ey)."""
    step_y, step_x = (max(1, int(n / max(density, min(h, w) / 20))) for n in (h, w))
    kept = valid_flow(flow).where((F.col("y") % step_y == 0) & (F.col("x") % step_x == 0))
    return kept.withColumns({"ex": F.col("x") + F.col("dx"), "ey": F.col("y") + F.col("dy")})
