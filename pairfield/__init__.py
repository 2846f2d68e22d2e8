"""Correspondence analytics on Spark DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed.

    Workers get the folder above the package on their path; on a cluster that
    shares no such folder, submit the package with --py-files.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
