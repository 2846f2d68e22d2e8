"""Reproducible draws (GEN-1): every number depends on a seed, a stream name and row keys only.

u = first 32 bits of md5('seed|stream|key|...') / 2^32, the same in any SQL engine,
under any partitioning and after any retry.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int, stream: str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1)."""
    parts = [F.lit(str(seed)), F.lit(stream), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(lo: float | Column, hi: float | Column, seed: int, stream: str, *keys: Column | str) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return lo + (hi - lo) * unit(seed, stream, *keys)


def bernoulli(p: float, seed: int, stream: str, *keys: Column | str) -> Column:
    return unit(seed, stream, *keys) < F.lit(float(p))


def randint(n: int | Column, seed: int, stream: str, *keys: Column | str) -> Column:
    """A whole number in [0, n)."""
    return F.floor(unit(seed, stream, *keys) * n).cast("long")


def normal(mean: float, std: float, seed: int, stream: str, *keys: Column | str) -> Column:
    """Box-Muller over two keyed uniforms."""
    a, b = unit(seed, stream + "/a", *keys), unit(seed, stream + "/b", *keys)
    return F.lit(float(mean)) + F.lit(float(std)) * F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(F.lit(2 * math.pi) * b)


def exponential(scale: float, seed: int, stream: str, *keys: Column | str) -> Column:
    return -F.lit(float(scale)) * F.log(1.0 - unit(seed, stream, *keys))


def triangular(lo: float, mode: float, hi: float, seed: int, stream: str, *keys: Column | str) -> Column:
    u, cut = unit(seed, stream, *keys), (mode - lo) / (hi - lo)
    return F.when(u < cut, lo + F.sqrt(u * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1.0 - u) * (hi - lo) * (hi - mode)))


_SHIFT = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_heads(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """First 32 bits of md5 of n messages of one block, given as its 16 words (one number for all messages, or one each)."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    t = np.empty(n, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        if isinstance(words[g], np.ndarray):
            np.add(t, words[g], out=t), np.add(t, np.uint32(_SINE[i]), out=t)
        else:
            np.add(t, np.uint32(_SINE[i] + words[g] & 0xFFFFFFFF), out=t)
        np.left_shift(t, np.uint32(_SHIFT[i]), out=a), np.right_shift(t, np.uint32(32 - _SHIFT[i]), out=t)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return np.add(b, np.uint32(_START[0]), out=t).byteswap(inplace=True)


def heads(seed: int, stream: str, firsts: np.ndarray, ids: np.ndarray):
    """For each of firsts: it and 2^32 unit(seed, stream, first, id) of all ids, as unsigned numbers; both: whole numbers.

    Ids of equally many digits go through md5 together.
    """
    sizes = np.array([len(str(i)) if i >= 0 else 0 for i in ids.tolist()])
    groups = [(int(k), np.flatnonzero(sizes == k)) for k in np.unique(sizes)]
    laid: dict[tuple[int, int], np.ndarray] = {}  # words of the ids behind a start of so many bytes
    for first in firsts.tolist():
        start, out = f"{seed}|{stream}|{first}|".encode(), np.empty(len(ids), np.uint32)
        for k, at in groups:
            if not k or len(start) + k > 55:
                out[at] = [int.from_bytes(md5(start + str(i).encode()).digest()[:4]) for i in ids[at].tolist()]
                continue
            key = (len(start), k)
            if key not in laid:
                rows = np.zeros((len(at), 64), np.uint8)
                rows[:, len(start) : len(start) + k] = np.array([str(i) for i in ids[at].tolist()], f"S{k}").view(np.uint8).reshape(-1, k)
                laid[key] = np.ascontiguousarray(rows.view("<u4").T)
            fixed = bytearray(64)
            fixed[: len(start)], fixed[len(start) + k], fixed[56:58] = start, 0x80, (8 * (len(start) + k)).to_bytes(2, "little")
            words = np.frombuffer(bytes(fixed), "<u4").tolist()
            for j in range(len(start) // 4, (len(start) + k - 1) // 4 + 1):
                words[j] = laid[key][j] | np.uint32(words[j])
            out[at] = _md5_heads(words, len(at))
        yield first, out
