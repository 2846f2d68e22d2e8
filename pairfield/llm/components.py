"""Connected components of an edge table, by alternating large and small stars.

Every round is a few joins and grouped minima over the edges; state lives in
tables of the shared folder, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


#: Edges for each task: a small graph is not dealt out over all partitions of a shuffle.
TASK_EDGES, LEAST_TASKS = 200_000, 8


def _stars(e: DataFrame, tasks: int) -> bool:
    """Whether each edge (a, b) hangs a leaf a, of no other edge, on a centre b."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    per = ends.groupBy("v").agg(F.sum("up").alias("n"), F.min("up").alias("least")).coalesce(tasks)
    return per.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and label, its component's least node, for edges (a, b) of longs; only nodes with an edge."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = max(LEAST_TASKS, e.count() // TASK_EDGES)
    while not _stars(e, tasks):  # each round shortens the longest path, by about a half
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").coalesce(tasks).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").coalesce(tasks).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.coalesce(tasks).select("a", F.col("m").alias("b")))
        e = saved(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct().coalesce(tasks))
