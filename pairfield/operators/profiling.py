"""Profiles of surfaces, categories and features: AGG-21..27, WIN-3, TOP-3, SET-1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved


def curvature(surface: DataFrame) -> DataFrame:
    """WIN-3: along columns and rows 2 sin(acos(n1 . n2) / 2) / |p2 - p1| of the two neighbours, their mean and product.

    A neighbour counts only if it is the next pixel; values that are not finite are left out.
    Each window's first key is a hash of its line of pixels: Spark sorts by that number and compares rows only where it ties.
    """

    def along(df: DataFrame, axis: str, other: str, name: str) -> DataFrame:
        w = Window.partitionBy(F.xxhash64("object_id", "image_id", other), "object_id", "image_id", other).orderBy(axis)
        before, after = (f(F.struct(axis, "cx", "cy", "cz", "nx", "ny", "nz")).over(w) for f in (F.lag, F.lead))
        both = df.withColumns({"__a": before, "__b": after})
        there = (F.col(f"__a.{axis}") == F.col(axis) - 1) & (F.col(f"__b.{axis}") == F.col(axis) + 1)
        dotted = sum((F.col(f"__a.{c}") * F.col(f"__b.{c}") for c in ("ny", "nz")), F.col("__a.nx") * F.col("__b.nx"))
        d = {c: F.col(f"__b.{c}") - F.col(f"__a.{c}") for c in ("cx", "cy", "cz")}
        length = F.sqrt(d["cx"] * d["cx"] + d["cy"] * d["cy"] + d["cz"] * d["cz"])
        k = F.when(there, F.try_divide(2 * F.sin(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dotted))) / 2), length))
        return both.withColumn(name, k).drop("__a", "__b")

    rows = along(along(surface, "y", "x", "k1"), "x", "y", "k2").where("k1 IS NOT NULL AND k2 IS NOT NULL AND NOT isnan(k1) AND NOT isnan(k2)")
    return rows.withColumns({"mean_curv": (F.col("k1") + F.col("k2")) / 2, "gauss_curv": F.col("k1") * F.col("k2")})


def curvature_stats(curv: DataFrame, value: str = "mean_curv") -> tuple[DataFrame, DataFrame]:
    """AGG-21: per image mean, deviation and count; per object their means over images."""
    images = curv.where(f"NOT isnan({value})").groupBy("object_id", "image_id").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return images, images.groupBy("object_id").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.sum("n").alias("n"))


def complexity_score(df: DataFrame, mean: str = "mean", std: str = "std", ratio: str = "ratio") -> DataFrame:
    """AGG-22: 2xy / (x + y) (1 + r)."""
    x, y = F.col(mean), F.col(std)
    return df.withColumn("score", F.try_divide(2 * x * y, x + y) * (1 + F.col(ratio)))


def category_stats(df: DataFrame, col: str = "category") -> DataFrame:
    """AGG-23: count, share and rank of each category; NULL is none."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.select(col, "n", (F.col("n") / F.sum("n").over(every)).alias("share"), F.row_number().over(Window.orderBy(F.col("n").desc(), col)).cast("long").alias("rank"))


def top_categories(df: DataFrame, k: int, col: str = "category") -> DataFrame:
    """TOP-3."""
    return category_stats(df, col).where(F.col("rank") <= k).orderBy("rank")


def feature_stats(features: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """AGG-24: over all components per role: rows, values, mean, deviation, extremes; sums per row first, so no component is shuffled."""
    v = F.transform(vec, lambda x: x.cast("double"))
    rows = features.select(by, F.size(vec).alias("k"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("q"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("n_values"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    n = F.col("n_values")
    return got.select(by, "n_rows", "n_values", (F.col("s") / n).alias("mean"), F.sqrt((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("std"), "min", "max")


def suggest_neighbors(df: DataFrame, col: str = "category", synthetic: str = "synthetic") -> DataFrame:
    """AGG-25: 15 with no real category, else half the mean count, within 5 and 50."""
    counts = df.where(F.col(col).isNotNull() & (F.col(col) != synthetic)).groupBy(col).count()
    return counts.agg(F.coalesce(F.least(F.lit(50), F.greatest(F.lit(5), F.floor(0.5 * F.avg("count")))), F.lit(15)).cast("long").alias("n_neighbors"))


def flatten_patches(df: DataFrame, vec: str = "vec") -> DataFrame:
    """AGG-26: one row for each component, with where it came from."""
    return df.select(*[c for c in df.columns if c != vec], F.posexplode(vec).alias("dim", "v"))


#: Sums of products that one task adds up at each level, and the bytes of them that a task holds at once.
FAN_IN, HELD_BYTES = 32, 1 << 28


def moments(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """__g, n, s and q: number, sum and sum of products (matrices as bytes) of the vectors (vec) of each group (__g).

    Every task sends one row a group; these are added up fan_in at a time, level by
    level, and one after the other in a task, so that no task holds more than two matrices
    a group, or reads more than fan_in.
    """

    def partial(batches):
        from pyspark import TaskContext

        held: dict[str, list] = {}
        part = TaskContext.get().partitionId() << 24

        def rows():
            for g, (n, s, q) in held.items():
                yield pa.RecordBatch.from_pydict({"__g": [g], "part": pa.array([part]), "n": pa.array([n]), "s": [s.tobytes()], "q": [q.tobytes()]})

        for batch in batches:
            names = batch.column(1).dictionary_encode()
            values, codes = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for i, g in enumerate(values):
                own = m[codes == i]
                h = held.setdefault(g, [0, 0.0, 0.0])
                h[0], h[1], h[2] = h[0] + len(own), h[1] + own.sum(0), h[2] + own.T @ own
                if len(held) * h[2].nbytes > HELD_BYTES:  # many groups: what is there goes on
                    yield from rows()
                    held, part = {}, part + 1
        yield from rows()

    def merge(batches):
        key, held = None, None

        def row():
            return pa.RecordBatch.from_pydict({"__g": [key[0]], "part": pa.array([key[1]]), "n": pa.array([held[0]]), "s": [held[1].tobytes()], "q": [held[2].tobytes()]})

        for batch in batches:
            for g, part, n, s, q in zip(*(batch.column(i) for i in range(5))):
                s, q = (np.frombuffer(x.as_buffer()) for x in (s, q))
                if (g.as_py(), part.as_py()) != key:
                    if key is not None:
                        yield row()
                    key, held = (g.as_py(), part.as_py()), [0, np.zeros(len(s)), np.zeros(len(q))]
                held[0] += n.as_py()
                held[1] += s
                held[2] += q
        if key is not None:
            yield row()

    schema, spark = "__g string, part long, n long, s binary, q binary", rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sums = saved(rows.where(F.col("vec").isNotNull()).select("vec", "__g").mapInArrow(partial, schema), "moments")
    parts = sums.groupBy("__g").count().agg(F.max("count")).first()[0] or 0
    while parts > 1:
        # any fan_in parts of a group: by their place, not their number, as some tasks hold no row of it
        place = F.row_number().over(Window.partitionBy("__g").orderBy("part")) - 1
        at = sums.select("__g", "part").withColumn("next", F.floor(place / fan_in).cast("int"))
        dealt = sums.join(at, ["__g", "part"]).select("__g", F.col("next").alias("part"), "n", "s", "q")
        sums = saved(dealt.repartition(width, "__g", "part").sortWithinPartitions("__g", "part").mapInArrow(merge, schema), "moments")
        parts = -(-parts // fan_in)
    return sums.select("__g", "n", "s", "q")


def pca_project(features: DataFrame, key: list[str], k: int = 3, per: str | None = None, whiten: bool = True, vec: str = "vec", fan_in: int = FAN_IN) -> DataFrame:
    """AGG-27: k principal components, whitened, as sigmoid(2x); over all rows, or per group of the column per.

    The sums of products come from moments(); the small eigenproblem is solved once a
    group. A component's greatest loading is positive. Rows without a vector have no components.
    """
    group = F.col(per).cast("string") if per else F.lit("all")
    rows = features.select(*key, F.col(vec).alias("vec"), group.alias("__g"))

    def solve(batches):
        for batch in batches:
            for g, n, s, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                s = np.frombuffer(s.as_buffer())
                q = np.frombuffer(q.as_buffer()).reshape(len(s), -1)
                values, vectors = np.linalg.eigh((q - np.outer(s, s) / n) / max(n - 1, 1))
                w = vectors[:, ::-1][:, :k].T
                w = w * np.sign(w[np.arange(len(w)), np.abs(w).argmax(1)])[:, None]
                if whiten:
                    w = w / np.sqrt(np.maximum(values[::-1][: len(w)], 1e-12))[:, None]
                yield pa.RecordBatch.from_pydict({"__g": [g], "mean": pa.array([(s / n).tolist()], pa.list_(pa.float64())), "axes": pa.array([w.tolist()], pa.list_(pa.list_(pa.float64())))})

    models = moments(rows, fan_in).mapInArrow(solve, "__g string, mean array<double>, axes array<array<double>>")
    centred = F.zip_with("vec", F.col("mean"), lambda a, b: a.cast("double") - b)
    scores = F.transform("axes", lambda axis: 1 / (1 + F.exp(-2 * F.aggregate(F.zip_with(axis, centred, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))))
    return rows.where(F.col("vec").isNotNull()).join(models, "__g").select(*key, scores.alias("components"))


def union_datasets(named: dict[str, DataFrame], tag: str = "dataset_name") -> DataFrame:
    """SET-1: the tables one after the other, each with its name."""
    out = None
    for name, df in named.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
