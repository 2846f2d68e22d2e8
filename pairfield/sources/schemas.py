"""Declared schemas of the annotation layouts; nothing is inferred."""

from __future__ import annotations

POINTS = "array<array<double>>"
PASCAL = "src string, trg string, class int, flip int"
WILLOW = "src string, trg string, " + ", ".join(f"{side}{axis}{i} double" for side in "st" for axis in "xy" for i in range(10))
CALTECH = "src string, trg string, class int, src_x string, src_y string, trg_x string, trg_y string"
SPAIR = f"src_kps {POINTS}, trg_kps {POINTS}, src_bndbox array<double>, trg_bndbox array<double>, src_imsize array<int>, trg_imsize array<int>, category string, viewpoint_variation int, scale_variation int, truncation int, occlusion int"
HOMOGRAPHY = "obj string, im1 string, im2 string, h int, w int, " + ", ".join(f"h{i} double" for i in range(9))
MANIFEST = "map<string, struct<offset: bigint, shape: array<int>, dtype: string>>"
CATALOG = "map<string, struct<type: int, name: string, categories: array<string>>>"
JOINTS = "map<string, map<string, map<string, map<string, array<double>>>>>"
PAIRS = ("pair_id", "benchmark", "split", "category", "category_id", "src_image", "trg_image", "flip")
