"""Exact nearest rows, pruned by pivots: JON-14, AGG-28.

1. Some rows of the database, picked by a hash of their ids, are pivots (at most PIVOTS, and
   at most PIVOT_BYTES of them, whatever the size). Every row goes to its nearest pivot;
   the rows of a pivot are sorted by their distance to it and cut into blocks. Of a
   block only its pivot and the least and greatest distance are looked at from then on.
2. Queries are blocked in the same way. Every block of queries first meets one block of the
   database, of the same pivot and the nearest distances. This bounds how far the k-th
   neighbour of each query is.
3. By the triangle inequality no row of a block whose distances to its pivot are in
   [lo, hi] is nearer to a query than dist(query, pivot) - hi or lo - dist(query, pivot).
   Pairs of pivots that this rules out for all their queries fall away first, then pairs of
   blocks, then single queries. What is left meets in a second round.

A task holds one block of the database and reads queries batch by batch. A block that
more than VISITS blocks of queries visit is dealt out to several tasks.

metric: cosine, euclidean, manhattan or hamming (share of unequal places). Neighbours are
ordered by distance, then id; a row is not its own neighbour. Rows without an id or vector,
or with a place of it that is null or NaN, take no part; nor do, for cosine, vectors of no length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

QUERY_BLOCK, DB_BLOCK = 1_000, 20_000
PIVOTS, PIVOT_BYTES = 512, 1 << 23
VISITS = 64
#: Pairs whose distance is worked out at once.
CHUNK = 50_000


def _matrix(vecs: pa.Array, metric: str) -> np.ndarray:
    """Vectors as rows; of length 1 for cosine."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    m = vecs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vecs), -1)
    if metric == "cosine" and len(m):
        n = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of a and rows of b, pair by pair; equal pairs have equal ones."""
    if metric == "cosine":
        return 1 - np.einsum("ij,ij->i", a, b)
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    return np.abs(a - b).sum(1) if metric == "manhattan" else (a != b).mean(1)


def _all(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of all pairs a distance that obeys the triangle inequality: for cosine the chord. By a product of matrices where there is one."""
    if metric in ("cosine", "euclidean"):
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        return np.sqrt(np.maximum(aa[:, None] + bb[None, :] - 2 * (a @ b.T), 0))
    out = np.empty((len(a), len(b)))
    for i, v in enumerate(a):
        out[i] = np.abs(b - v).sum(1) if metric == "manhattan" else (b != v).mean(1)
    return out


def _as_metric(distance: Column, metric: str) -> Column:
    """The distance as _all gives it."""
    return F.sqrt(2 * F.greatest(distance, F.lit(0.0))) if metric == "cosine" else distance


def _loose(d: Column) -> Column:
    """A bound with more to spare than rounding can take."""
    return d * (1 + 1e-6) + 1e-6


def blocked(rows: DataFrame, pivots: np.ndarray, metric: str, size: int, gaps: bool) -> DataFrame:
    """block, pivot, dist, id and vec of rows (id, vec), sorted by distance inside a pivot, at most `size` rows a block; gaps: also the distances to all pivots."""
    more = ", gaps array<float>" if gaps else ""

    def place(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                d = _all(_matrix(part.column(1), metric), pivots, metric)
                nearest = d.argmin(1)
                made = [part.column(0), part.column(1), pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])]
                if gaps:
                    made.append(pa.FixedSizeListArray.from_arrays(pa.array(d.astype(np.float32).ravel()), len(pivots)).cast(pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays(made, ["id", "vec", "pivot", "dist", "gaps"][: len(made)])

    def cut(batches):
        from pyspark import TaskContext

        block, pivot, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            blocks = []
            for p in batch.column(batch.schema.get_field_index("pivot")).to_pylist():
                if p != pivot or held == size:
                    block, pivot, held = block + 1, p, 0
                held += 1
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], ["block", *batch.schema.names])

    spark, kind = rows.sparkSession, rows.schema["vec"].dataType.simpleString()
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = rows.mapInArrow(place, f"id long, vec {kind}, pivot int, dist double{more}")
    sorted_ = placed.repartitionByRange(width, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    return saved(sorted_.mapInArrow(cut, f"block long, id long, vec {kind}, pivot int, dist double{more}"), "nearest-blocks")


def _visit(queries: DataFrame, db: DataFrame, pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """id, neighbor, distance: the k nearest in every block that a query visits; queries: id, vec, place (block to visit), q (own block); pairs: place, q."""
    copies = pairs.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies"))
    here = db.join(copies, db["block"] == copies["place"]).select("place", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), "id", "vec")
    ask = queries.join(copies, "place").select("place", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("asks"), "id", "vec")

    def nearest(a, a_ids, b, b_ids):
        """b is sorted by id."""
        d = _all(a, b, metric)
        first, last = np.searchsorted(b_ids, a_ids, "left"), np.searchsorted(b_ids, a_ids, "right")
        for i in np.flatnonzero(last > first).tolist():
            d[i, first[i] : last[i]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
        # rounding may misplace rows near the k-th: all of them are looked at pair by pair
        row, col = np.nonzero((d <= kth[:, None] * (1 + 1e-6) + 1e-6) & (d < np.inf))
        exact = np.concatenate([_exact(a[row[i : i + CHUNK]], b[col[i : i + CHUNK]], metric) for i in range(0, len(row), CHUNK)] or [np.zeros(0)])
        order = np.lexsort((col, exact, row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.RecordBatch.from_arrays([pa.array(a_ids[row[keep]]), pa.array(b_ids[col[keep]]), pa.array(exact[keep])], ["id", "neighbor", "distance"])

    def run(batches):
        key, rows, b, b_ids = None, [], None, None
        for batch in batches:
            places, copy, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = [0, *(np.flatnonzero((np.diff(places) != 0) | (np.diff(copy) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(places)]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if (places[x], copy[x]) != key:
                    key, rows, b = (places[x], copy[x]), [], None
                if not asks[x]:
                    rows.append(batch.slice(x, y - x))
                    continue
                if b is None:  # a block's own rows come before those that ask
                    held = pa.Table.from_batches(rows).sort_by("id")
                    b, b_ids, rows = _matrix(held.column("vec"), metric), held.column("id").to_numpy(), []
                step = max(1, min(QUERY_BLOCK, 4_000_000 // len(b)))
                for i in range(x, y, step):
                    part = batch.slice(i, min(step, y - i))
                    yield nearest(_matrix(part.column(4), metric), part.column(3).to_numpy(), b, b_ids)

    width = int(db.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    met = here.unionByName(ask).repartition(width, "place", "copy").sortWithinPartitions("place", "copy", "asks")
    return met.mapInArrow(run, "id long, neighbor long, distance double")


def _spans(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n"))


def knn_graph(queries: DataFrame, db: DataFrame, k: int, metric: str = "cosine", block: int = DB_BLOCK, told: dict | None = None) -> DataFrame:
    """AGG-28, JON-14: id, neighbor, distance, rank of the k nearest rows of db (id, vec) of each query (id, vec). told: takes the counts of pairs of blocks and of rows, and of those that met."""
    sound = "id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x))" + (" AND exists(vec, x -> x <> 0)" if metric == "cosine" else "")
    q, d = (x.select(F.col("id").cast("long").alias("id"), "vec").where(sound) for x in (queries, db))
    few = d.select("id", "vec", F.size("vec").alias("n")).orderBy(F.xxhash64("id"), "id").limit(PIVOTS)
    wide = few.agg(F.max("n")).first()[0]
    if wide is None:
        return db.sparkSession.createDataFrame([], "id long, neighbor long, distance double, rank long")
    n_db = d.count()
    most = min(PIVOTS, max(1, PIVOT_BYTES // (8 * max(wide, 1))), max(1, math.isqrt(n_db)))
    pivots = _matrix(few.limit(most).select("vec").toArrow().column("vec"), metric)
    rows, asked = blocked(d, pivots, metric, block, False), blocked(q, pivots, metric, QUERY_BLOCK, True)
    blocks = saved(_spans(rows, "block", "pivot").withColumnRenamed("block", "place"), "nearest-spans")
    q_blocks = _spans(asked, "block", "pivot").select(F.col("block").alias("q"), "pivot", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    # one block for each block of queries: of its pivot, with k others if there is one, and near in distance
    apart = F.greatest(F.lit(0.0), F.col("lo") - F.col("qhi"), F.col("qlo") - F.col("hi"))
    first = saved(q_blocks.join(blocks, "pivot").groupBy("q").agg(F.min(F.struct((F.col("n") <= k).alias("few"), apart.alias("apart"), "place"))["place"].alias("place")), "nearest-first")
    asked = asked.withColumnRenamed("block", "q")
    near = saved(_visit(asked.select("q", "id", "vec").join(first, "q"), rows, first, k, metric), "nearest-near")
    # how far the k-th neighbour of a query can be
    reach = near.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, _loose(_as_metric(F.max("distance"), metric))).otherwise(F.lit(float("inf"))).alias("reach"))
    asked = saved(asked.join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), "nearest-asked")
    # pairs of pivots: at most PIVOTS squared
    far = {r.pivot: r for r in asked.groupBy("pivot").agg(F.max("dist").alias("hi"), F.max("reach").alias("reach")).collect()}
    spans = {r.pivot: r for r in blocks.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    between = _all(pivots, pivots, metric) if far else np.zeros((0, 0))
    kept = [(a, b) for a, x in far.items() for b, y in spans.items() if max(between[a, b] - x.hi - y.hi, y.lo - between[a, b] - x.hi) <= x.reach + 1e-6]
    pairs = db.sparkSession.createDataFrame(kept, "pivot int, near_pivot int")
    # pairs of blocks: what the least gap of a block's queries to the pivot leaves
    wanted = asked.select("q", "pivot", "reach", "gaps").join(F.broadcast(pairs), "pivot").select("q", "near_pivot", "reach", F.get("gaps", F.col("near_pivot")).cast("double").alias("gap"))
    seen = wanted.groupBy("q", "near_pivot").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.max("reach").alias("reach"))
    low = F.greatest(F.col("least") - F.col("hi"), F.col("lo") - F.col("most"))
    second = seen.join(blocks.withColumnRenamed("pivot", "near_pivot"), "near_pivot").where(low <= _loose(F.col("reach"))).select("q", "place", "near_pivot", "lo", "hi")
    second = saved(second.join(first, ["q", "place"], "left_anti"), "nearest-second")
    gap = F.get("gaps", F.col("near_pivot")).cast("double")
    left = asked.join(second, "q").where(F.greatest(gap - F.col("hi"), F.col("lo") - gap) <= _loose(F.col("reach"))).select("q", "place", "id", "vec")
    if told is not None:
        told["pairs"], told["met"] = q_blocks.count() * blocks.count(), first.count() + second.count()
        met = left.unionByName(asked.join(first, "q").select(*left.columns)).join(blocks, "place").agg(F.sum("n")).first()[0]
        told["rows"], told["rows_met"] = asked.count() * n_db, met or 0
    every = near.unionByName(_visit(left, rows, second.select("q", "place"), k, metric))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return every.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def find_nn(queries: DataFrame, db: DataFrame) -> DataFrame:
    """JON-14: the nearest row by Euclidean distance."""
    return knn_graph(queries, db, 1, "euclidean").drop("rank")
