"""Scalar geometry as SQL functions (UDF-4) and chains of transforms (UDF-2)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Name, parameters, result and body; plain expressions, so queries stay inside the JVM.
FUNCTIONS = (
    ("normalize_coord", "v DOUBLE, size DOUBLE", "DOUBLE", "2 * v / (size - 1) - 1"),
    ("unnormalize_coord", "v DOUBLE, size DOUBLE", "DOUBLE", "(v + 1) * (size - 1) / 2"),
    ("rescale_coord", "v DOUBLE, old DOUBLE, new DOUBLE", "DOUBLE", "v * new / old"),
    ("clip_rescale", "v DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "greatest(0, least(1, (v - lo) / (hi - lo)))"),
    ("point_distance", "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"),
    ("keyed_uniform", "k STRING", "DOUBLE", "CAST(conv(substring(md5(k), 1, 8), 16, 10) AS DOUBLE) / 4294967296"),
    ("path_segment", "p STRING, i INT", "STRING", "try_element_at(split(p, '/'), CASE WHEN i >= 0 THEN i + 1 ELSE i END)"),
)


def register(spark: SparkSession) -> None:
    """UDF-4."""
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """UDF-2: one transform out of several, in order."""
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)
