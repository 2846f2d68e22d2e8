"""Scalar geometry as columns: PRJ-1..5, 8..16, 18..21, 23..27, 29, 30, 33."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale(v: Column, old: Column | float, new: Column | float) -> Column:
    """PRJ-1: one coordinate from an image of size old to one of size new."""
    return v * (new / F.lit(old) if not isinstance(old, Column) else new / old)


def rescale_corners(v: Column, old: Column | float, new: Column | float, as_int: bool = False) -> Column:
    """PRJ-2: first and last pixel stay first and last; as_int cuts the fraction off."""
    out = v * (F.lit(new) - 1) / (F.lit(old) - 1)
    return out.cast("long") if as_int else out


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    """PRJ-3."""
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def flip_x(x: Column, width: Column | float, when: Column) -> Column:
    """PRJ-4: mirror a point where the flag holds."""
    return F.when(when, F.lit(width) - x).otherwise(x)


def flip_box(box: Column, width: Column | float, when: Column) -> Column:
    """PRJ-4: mirroring a box swaps its sides."""
    turned = F.struct((F.lit(width) - box["x2"]).alias("x1"), box["y1"].alias("y1"), (F.lit(width) - box["x1"]).alias("x2"), box["y2"].alias("y2"))
    return F.when(when, turned).otherwise(box)


def normalize(v: Column, size: Column | float) -> Column:
    """PRJ-8: pixel to [-1, 1]."""
    return 2 * v / (F.lit(size) - 1) - 1


def unnormalize(v: Column, size: Column | float) -> Column:
    """PRJ-8: [-1, 1] to pixel."""
    return (v + 1) * (F.lit(size) - 1) / 2


def clip_rescale(v: Column, lo: float, hi: float) -> Column:
    """PRJ-12."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))


def affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """PRJ-13: m is a row-major 3x3 as an array of nine."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def homography(m: Column, x: Column, y: Column, eps: float = 0.0) -> tuple[Column, Column]:
    """PRJ-14: with the perspective divide; a zero divisor gives NULL."""
    d = m[6] * x + m[7] * y + m[8] + eps
    return F.try_divide(m[0] * x + m[1] * y + m[2], d), F.try_divide(m[3] * x + m[4] * y + m[5], d)


def compose(a: Column, b: Column) -> Column:
    """PRJ-14: the matrix product a b."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def inverse3(m: Column) -> Column:
    """PRJ-15: the inverse of a 3x3 by cofactors; NULL entries if it has none."""
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return F.array(*[F.try_divide(r, det) for r in rows])


def rescale_homography(m: Column, src_old: tuple, src_new: tuple, trg_old: tuple, trg_new: tuple) -> Column:
    """PRJ-15: S2 H S1^-1 for sizes (w, h)."""
    left = [trg_new[0] / trg_old[0], trg_new[1] / trg_old[1], 1.0]
    right = [src_old[0] / src_new[0], src_old[1] / src_new[1], 1.0]
    return F.array(*[m[3 * i + j] * (left[i] * right[j]) for i in range(3) for j in range(3)])


def on_sphere(azimuth: Column, elevation: Column, distance: float = 1.0) -> tuple[Column, Column, Column]:
    """PRJ-18: view angles in [0, 1] (a turn, and pole to pole) to a place on a sphere."""
    a, e = azimuth * 2 * F.pi(), (elevation - 0.5) * F.pi()
    return distance * F.cos(e) * F.cos(a), distance * F.cos(e) * F.sin(a), distance * F.sin(e)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """PRJ-19: by the sextant of the hue."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    six = F.pmod(i, F.lit(6))

    def pick(*options: Column) -> Column:
        out = F.when(six == 0, options[0])
        for k, o in enumerate(options[1:5], 1):
            out = out.when(six == k, o)
        return out.otherwise(options[5])

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def uv_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """PRJ-20: longitude and latitude of a point, both in [-1, 1]."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.atan2(y, x) / F.pi(), 2 * F.asin(F.try_divide(z, r)) / F.pi()


def uv_cube(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """PRJ-20: the face of the greatest axis; the other two over it, within [-1, 1]."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    major = F.greatest(ax, ay, az)
    u = F.when((ax >= ay) & (ax >= az), y).otherwise(x)
    w = F.when((az >= ax) & (az >= ay) & ~((ax >= ay) & (ax >= az)), y).otherwise(z)

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(c, major)))

    return clamp(u), clamp(w)


def path_seg(path: Column, index: int) -> Column:
    """PRJ-21: a segment of a path; a negative index counts from the end."""
    return F.try_element_at(F.split(path, "/"), F.lit(index + 1 if index >= 0 else index))


def parse_ints(text: Column) -> Column:
    """PRJ-29."""
    return F.transform(F.regexp_extract_all(text, F.lit("-?\\d+"), F.lit(0)), lambda x: x.cast("long"))


def points_to_string(values: Column, sep: str = ",") -> Column:
    """PRJ-30."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def string_to_points(text: Column, sep: str = ",") -> Column:
    """PRJ-30."""
    return F.transform(F.split(text, sep), lambda s: F.trim(s).cast("double"))


def pad_suffix(name: Column, width: int) -> Column:
    """PRJ-33: zero-pad the number after the last underscore, never cutting it."""
    number = F.regexp_extract(name, "_(\\d+)$", 1)
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit("0"))
    return F.when(number == "", name).otherwise(F.concat(F.regexp_replace(name, "\\d+$", ""), padded))


def schedule(step: Column, end: float, kind: str = "linear", power: float = 2.0) -> Column:
    """PRJ-23: progress in [0, 1] of a step towards end, bent by kind: linear, poly, exp or sin."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / F.lit(float(end))))
    if kind == "linear":
        return x
    if kind == "poly":
        return F.pow(x, F.lit(power))
    if kind == "exp":
        return (F.exp(x * power) - 1) / (F.exp(F.lit(power)) - 1)
    if kind == "sin":
        return F.sin(x * F.pi() / 2)
    raise ValueError(f"no schedule named {kind}")


def interpolate(a: Column | float, b: Column | float, x: Column) -> Column:
    """PRJ-24."""
    return (1 - x) * a + x * b


def remember_rate(epoch: Column, start: int, cutoff: int, base: float, top: float = 0.9) -> Column:
    """PRJ-25: base until start, then straight to top within cutoff epochs."""
    ramp = base + (top - base) * (epoch - start) / float(cutoff)
    return F.when(epoch < start, F.lit(base)).when(epoch >= start + cutoff, F.lit(top)).otherwise(ramp)


def warp_strength(step: Column, base: float, factor: float, interval: int, cap: float) -> Column:
    """PRJ-26: times factor every interval steps, up to cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(factor), F.floor(step / F.lit(interval)).cast("double")))


def linear_scale(batch: Column | float, base: float, nodes: Column | float = 1, gpus: Column | float = 1) -> Column:
    """PRJ-27."""
    return F.lit(batch) / base * nodes * gpus if not isinstance(batch, Column) else batch / base * nodes * gpus
