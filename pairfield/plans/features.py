"""Queries of features: Q14..Q18, Q34, Q35."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as X
from ..operators import nearest as N
from ..operators import profiling as R
from .fixtures import fixture
from .registry import query

UNIT = """u AS (SELECT pair_id, side, pos, row_i, col_i, label, CAST(vec AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])) + 1e-5) AS n,
                 sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS n0 FROM fx_features)"""
CORR = f"""{UNIT}, c AS (SELECT a.pair_id, a.pos AS src_pos, b.pos AS trg_pos, list_dot_product(a.v, b.v) / (a.n * b.n) AS score FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1)"""


def _sides(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_features")
    return f.where("side = 0"), f.where("side = 1")


def _corr(spark, sf_dir):
    return X.correlate(*_sides(spark, sf_dir))


@query(f"""WITH {CORR}, m AS (SELECT *, max(score) OVER (PARTITION BY pair_id, src_pos) AS a, max(score) OVER (PARTITION BY pair_id, trg_pos) AS b FROM c)
           SELECT pair_id, src_pos, trg_pos, round(score, 6) AS score, round(score * (score / CASE WHEN a = 0 THEN 1e-7 ELSE a END) * (score / CASE WHEN b = 0 THEN 1e-7 ELSE b END), 5) AS filtered FROM m""")
def q14_correlate_mutual_nn(spark, sf_dir):
    return X.mutual_nn(_corr(spark, sf_dir)).withColumns({"score": F.round("score", 6), "filtered": F.round("filtered", 5)})


@query(f"""WITH {CORR}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, src_pos ORDER BY score DESC, trg_pos) AS ra, row_number() OVER (PARTITION BY pair_id, trg_pos ORDER BY score DESC, src_pos) AS rb FROM c)
           SELECT pair_id, src_pos, trg_pos, rb = 1 AS mutual, round(score, 6) AS score FROM r WHERE ra = 1""")
def q14b_argmax_and_mutual(spark, sf_dir):
    corr = X.correlate_blocked(*_sides(spark, sf_dir))
    mutual = X.mutual_nn_pairs(corr).select("pair_id", "src_pos", F.lit(True).alias("m"))
    return X.argmax_match(corr).join(mutual, ["pair_id", "src_pos"], "left").select("pair_id", "src_pos", "trg_pos", F.coalesce("m", F.lit(False)).alias("mutual"), F.round("score", 6).alias("score"))


@query(f"""WITH {CORR}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, src_pos ORDER BY score DESC, trg_pos) AS ra, row_number() OVER (PARTITION BY pair_id, trg_pos ORDER BY score DESC, src_pos) AS rb FROM c)
           SELECT pair_id, src_pos, trg_pos, rb = 1 AS mutual, round(score, 6) AS score FROM r WHERE ra = 1""")
def q14c_best_matches(spark, sf_dir):
    """The same without a row for each pair of patches."""
    return X.best_matches(*_sides(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {UNIT}, o AS (SELECT a.d AS oy, b.d AS ox FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)
           SELECT t.pair_id, t.row_i, t.col_i, CAST(o.oy AS INTEGER) AS oy, CAST(o.ox AS INTEGER) AS ox, round(coalesce(list_dot_product(s.v, t.v) / (s.n0 * t.n0), 0), 6) AS score
           FROM u t CROSS JOIN o LEFT JOIN u s ON s.side = 0 AND s.pair_id = t.pair_id AND s.row_i = t.row_i + o.oy AND s.col_i = t.col_i + o.ox WHERE t.side = 1""")
def q15_local_correlation(spark, sf_dir):
    return X.correlate_local(*_sides(spark, sf_dir), 3).withColumn("score", F.round("score", 6))


@query(f"""WITH {UNIT}, o AS (SELECT CAST(a.d AS BIGINT) AS oy, CAST(b.d AS BIGINT) AS ox FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)
           SELECT t.pair_id * 2 + t.side AS image_id, t.row_i, t.col_i, CAST(o.oy AS INTEGER) AS oy, CAST(o.ox AS INTEGER) AS ox, round(coalesce(list_dot_product(s.v, t.v), 0), 6) AS score
           FROM u t CROSS JOIN o LEFT JOIN u s ON s.side = t.side AND s.pair_id = t.pair_id AND s.row_i = t.row_i + o.oy AND s.col_i = t.col_i + o.ox""")
def q15b_self_similarity(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_features").withColumn("image_id", F.col("pair_id") * 2 + F.col("side"))
    return X.self_similarity(f, 3).withColumn("score", F.round("score", 6))


@query(f"""WITH {CORR.replace("a.n * b.n", "a.n0 * b.n0")}, m AS (SELECT pair_id, floor(src_pos / 4 / 2) AS sr, floor(src_pos % 4 / 2) AS sc, floor(trg_pos / 4 / 2) AS tr, floor(trg_pos % 4 / 2) AS tc, src_pos, trg_pos, score FROM c)
           SELECT pair_id, src_pos, trg_pos, round(score, 6) AS score FROM m WHERE sr = tr AND sc = tc""")
def q15c_block_correlation(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    blocks = a.select("pair_id", F.floor(F.col("row_i") / 2).alias("src_brow"), F.floor(F.col("col_i") / 2).alias("src_bcol")).distinct()
    coarse = blocks.withColumns({"trg_brow": F.col("src_brow"), "trg_bcol": F.col("src_bcol")})
    return X.correlate_blocks(a, b, coarse, 2).withColumn("score", F.round("score", 6))


@query(f"""WITH {CORR}, b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, src_pos ORDER BY score DESC, trg_pos) AS k FROM c),
           g AS (SELECT c.pair_id, c.src_pos, c.trg_pos, c.score * exp(-(pow(c.trg_pos % 4 - b.trg_pos % 4, 2) + pow(floor(c.trg_pos / 4.0) - floor(b.trg_pos / 4.0), 2)) / 50) AS score FROM c JOIN b ON c.pair_id = b.pair_id AND c.src_pos = b.src_pos AND b.k = 1),
           e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY pair_id, src_pos)) / 0.02) AS e FROM g)
           SELECT pair_id, src_pos, round(sum(e * (trg_pos % 4)) / sum(e), 5) AS x, round(sum(e * floor(trg_pos / 4.0)) / sum(e), 5) AS y FROM e GROUP BY pair_id, src_pos""")
def q16_soft_argmax(spark, sf_dir):
    got = X.soft_argmax(X.gaussian_gate(_corr(spark, sf_dir), 4), 4)
    return got.select("pair_id", "src_pos", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""WITH {CORR} SELECT pair_id, src_pos AS pos, 'src' AS side, round(sum(score), 6) AS total FROM c GROUP BY pair_id, src_pos
           UNION ALL SELECT pair_id, trg_pos, 'trg', round(sum(score), 6) FROM c GROUP BY pair_id, trg_pos""")
def q16b_covisibility(spark, sf_dir):
    return X.covisibility(_corr(spark, sf_dir)).select("pair_id", "pos", "side", F.round("total", 6).alias("total"))


@query(f"""WITH {CORR}, v AS (SELECT pair_id, avg(CASE WHEN src_pos = trg_pos THEN score END) - avg(CASE WHEN src_pos <> trg_pos THEN score END) AS v FROM c GROUP BY pair_id)
           SELECT round(avg(1 - tanh(3 * v)), 6) AS loss FROM v""")
def q16c_covisibility_loss(spark, sf_dir):
    corr = _corr(spark, sf_dir)
    matched = corr.where("src_pos = trg_pos").select("pair_id", "src_pos", "trg_pos")
    return X.covisibility_loss(corr, matched).withColumn("loss", F.round("loss", 6))


@query("""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
          d AS (SELECT a.id, b.id AS neighbor, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d)
          SELECT id, neighbor, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""")
def q17_knn_graph(spark, sf_dir):
    db = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return N.knn_graph(db.where("id % 50 = 0"), db, 10).withColumn("distance", F.round("distance", 6))


@query("""SELECT label AS category, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM fx_features GROUP BY label""")
def q18_category_stats(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_features").withColumn("category", F.col("label"))
    return R.category_stats(f).select("category", "n", F.round("share", 6).alias("share"), "rank")


@query("""WITH x AS (SELECT side, CAST(unnest(vec) AS DOUBLE) AS v FROM fx_features)
          SELECT side, CAST(count(*) AS BIGINT) AS n_values, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM x GROUP BY side""")
def q18b_feature_stats(spark, sf_dir):
    got = R.feature_stats(fixture(spark, sf_dir, "fx_features"), "side")
    return got.select("side", "n_values", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query("""WITH c AS (SELECT label, count(*) AS n FROM fx_features GROUP BY label) SELECT CAST(least(50, greatest(5, floor(0.5 * avg(n)))) AS BIGINT) AS n_neighbors FROM c""")
def q18c_suggest_neighbors(spark, sf_dir):
    return R.suggest_neighbors(fixture(spark, sf_dir, "fx_features").withColumn("category", F.col("label").cast("string")))


@query("""SELECT pair_id AS batch, side, pos AS patch, CAST(i - 1 AS INTEGER) AS dim, round(CAST(vec[i] AS DOUBLE), 6) AS v FROM fx_features, (SELECT unnest(range(1, 65)) AS i) r""")
def q18d_flatten_patches(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_features").select(F.col("pair_id").alias("batch"), "side", F.col("pos").alias("patch"), "vec")
    return R.flatten_patches(f).select("batch", "side", "patch", "dim", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(f"""WITH {CORR}, m AS (SELECT pair_id, CAST(floor(src_pos / 8.0) AS BIGINT) AS i, CAST(floor(src_pos % 4 / 2.0) AS BIGINT) AS j, CAST(floor(trg_pos / 8.0) AS BIGINT) AS k, CAST(floor(trg_pos % 4 / 2.0) AS BIGINT) AS l,
              CAST(((floor(src_pos / 4.0) % 2 * 2 + src_pos % 4 % 2) * 2 + floor(trg_pos / 4.0) % 2) * 2 + trg_pos % 4 % 2 AS BIGINT) AS o, score FROM c),
           r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, i, j, k, l ORDER BY score DESC, o) AS rk FROM m)
           SELECT pair_id, i, j, k, l, round(score, 6) AS score, o AS "offset" FROM r WHERE rk = 1""")
def q34_max_pool4d(spark, sf_dir):
    corr = _corr(spark, sf_dir)
    return X.max_pool4d(X.mean_corr([corr, corr]), 4, 4, 2).withColumn("score", F.round("score", 6))


@query()
def q35_pca_project(spark, sf_dir):
    return R.pca_project(fixture(spark, sf_dir, "fx_features"), ["pair_id", "side", "pos"], 3)


@query("""WITH i AS (SELECT unnest(range(0, 3)) AS component) SELECT CAST(component AS INTEGER) AS component, (SELECT count(*) FROM fx_features) AS n, 0.0E0 AS mean, 1.0E0 AS variance, 0.0E0 AS covariance FROM i""")
def q35b_pca_invariants(spark, sf_dir):
    """AGG-27: before the sigmoid whitened components have mean 0 and variance 1, and none goes with the next."""
    scores = R.pca_project(fixture(spark, sf_dir, "fx_features"), ["pair_id", "side", "pos"], 3, fan_in=2)
    raw = F.transform("components", lambda c: F.log(c / (1 - c)) / 2)
    each = scores.select(raw.alias("c")).select(F.posexplode("c").alias("component", "v"), F.get("c", (F.col("component") + 1) % 3).alias("next"))
    got = each.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.covar_samp("v", "next").alias("covariance"))
    return got.select("component", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("mean", "variance", "covariance")])


@query("""WITH d AS (SELECT i, var_samp(CAST(vec[i] AS DOUBLE)) AS v FROM fx_features, (SELECT unnest(range(1, 65)) AS i) r GROUP BY i) SELECT round(sum(v), 4) AS total_variance, 64 AS n_components, TRUE AS falling FROM d""")
def q35c_pca_variance(spark, sf_dir):
    """AGG-27: all components together have the variance of the features, the first ones the most."""
    scores = R.pca_project(fixture(spark, sf_dir, "fx_features"), ["pair_id", "side", "pos"], 64, whiten=False)
    raw = F.transform("components", lambda c: F.log(c / (1 - c)) / 2)
    per = scores.select(F.posexplode(raw).alias("component", "v")).groupBy("component").agg(F.var_samp("v").alias("v"))
    before = F.lag("v").over(Window.orderBy("component"))  # a row for each component
    return per.withColumn("falls", F.coalesce(F.col("v") <= before * (1 + 1e-9), F.lit(True))).agg(F.round(F.sum("v"), 4).alias("total_variance"), F.count(F.lit(1)).cast("int").alias("n_components"), F.bool_and("falls").alias("falling"))


@query("""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
          d AS (SELECT a.id, b.id AS neighbor, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS k FROM d)
          SELECT id, neighbor, round(distance, 6) AS distance FROM r WHERE k = 1""")
def q17b_find_nn(spark, sf_dir):
    """JON-14."""
    db = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return N.find_nn(db.where("id % 50 = 0"), db).withColumn("distance", F.round("distance", 6))


@query("""WITH c AS (SELECT category, count(*) AS n FROM fx_catalog GROUP BY category), r AS (SELECT category, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, category) AS rank FROM c) SELECT category, n, rank FROM r WHERE rank <= 10""")
def q18e_top_categories(spark, sf_dir):
    """TOP-3, SET-1: the limit is the feature."""
    cat = fixture(spark, sf_dir, "fx_catalog")
    both = R.union_datasets({"even": cat.where("asset_id % 2 = 0"), "odd": cat.where("asset_id % 2 = 1")})
    return R.top_categories(both, 10).select("category", "n", "rank")
