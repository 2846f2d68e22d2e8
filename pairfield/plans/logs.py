"""Queries of metric logs: Q20, Q32, Q43."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as T
from ..streaming.logs import best_so_far, metric_windows, replayed, stream_best
from .fixtures import fixture
from .registry import query

EPOCHS = "e AS (SELECT benchmark, epoch, round(avg(value), 6) AS value FROM fx_metrics GROUP BY benchmark, epoch)"


def _epochs(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_metrics").groupBy("benchmark", "epoch").agg(F.round(F.avg("value"), 6).alias("value"))


@query(f"""WITH {EPOCHS}, b AS (SELECT *, greatest(0, coalesce(max(value) OVER (PARTITION BY benchmark ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best_before FROM e)
           SELECT benchmark, epoch, value, best_before, value > best_before AS is_best FROM b""")
def q20_running_best(spark, sf_dir):
    return T.running_best(_epochs(spark, sf_dir))


@query(f"""WITH {EPOCHS} SELECT benchmark, max(value) AS best, CASE WHEN min(CASE WHEN value = m THEN epoch END) > 0 THEN 'epoch_' || min(CASE WHEN value = m THEN epoch END) ELSE 'N/A' END AS checkpoint
           FROM (SELECT *, max(value) OVER (PARTITION BY benchmark) AS m FROM e) t GROUP BY benchmark""")
def q20b_training_summary(spark, sf_dir):
    return T.training_summary(_epochs(spark, sf_dir))


@query("""SELECT run, benchmark, epoch, step, round(avg(value) OVER (PARTITION BY run, epoch ORDER BY step ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM fx_metrics""")
def q20c_running_mean(spark, sf_dir):
    return T.running_mean(fixture(spark, sf_dir, "fx_metrics")).select("run", "benchmark", "epoch", "step", F.round("running_mean", 9).alias("running_mean"))


ORACLE_BEST = f"""WITH {EPOCHS}, b AS (SELECT *, coalesce(max(value) OVER (PARTITION BY benchmark ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM e) SELECT benchmark, epoch, value FROM b WHERE value > m"""


@query(ORACLE_BEST)
def q20d_best_so_far(spark, sf_dir):
    return best_so_far(_epochs(spark, sf_dir))


@query("""SELECT run, benchmark, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi
          FROM fx_metrics GROUP BY run, benchmark, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')""")
def q32_metric_windows(spark, sf_dir):
    got = metric_windows(fixture(spark, sf_dir, "fx_metrics"), "6 hours")
    return got.select("run", "benchmark", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "lo", "hi")


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY run, benchmark ORDER BY ts, step) + INTERVAL 1 HOUR THEN 1 WHEN lag(ts) OVER (PARTITION BY run, benchmark ORDER BY ts, step) IS NULL THEN 1 ELSE 0 END AS s FROM fx_metrics),
          k AS (SELECT *, sum(s) OVER (PARTITION BY run, benchmark ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS k FROM g)
          SELECT run, benchmark, min(ts) AS start, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM k GROUP BY run, benchmark, k""")
def q32b_metric_sessions(spark, sf_dir):
    got = metric_windows(fixture(spark, sf_dir, "fx_metrics"), "1 hour", session=True)
    return got.select("run", "benchmark", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


#: Days after which a stream stops and goes on.
STOPS = (10, 20)


def _days(logs):
    first, second = STOPS
    return [logs.where(f"epoch <= {first}"), logs.where(f"epoch > {first} AND epoch <= {second}"), logs.where(f"epoch > {second}")]


@query(ORACLE_BEST)
def q20e_best_so_far_stream(spark, sf_dir):
    """STR-2 as a stream that is stopped twice."""
    return replayed(_days(_epochs(spark, sf_dir)), stream_best, "best")


# A tenth of the first days' rows comes with the last files: late for most windows. Rows whose window ended before the
# watermark (an hour behind all that came before) are dropped; windows that end after the last watermark stay open.
LATE = f"""m AS (SELECT *, epoch <= {STOPS[0]} AND step % 10 = 0 AS held FROM fx_metrics),
           w AS (SELECT date_trunc('milliseconds', max(ts) FILTER (epoch <= {STOPS[1]} AND NOT held)) - INTERVAL 1 HOUR AS late, date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS closed FROM m)"""
SLIDES = f"""WITH {LATE}, b AS (SELECT m.*, time_bucket(INTERVAL SLIDE HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(back) AS start FROM m, (SELECT unnest(BACK) AS back) k)
             SELECT run, benchmark, start, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi
             FROM b, w WHERE NOT (held AND start + INTERVAL 6 HOURS <= late) AND start + INTERVAL 6 HOURS <= closed GROUP BY run, benchmark, start"""


def _windows(spark, sf_dir, name, **how):
    logs = fixture(spark, sf_dir, "fx_metrics").withColumn("ts", F.col("ts").cast("timestamp"))
    held = (F.col("epoch") <= STOPS[0]) & (F.col("step") % 10 == 0)
    days = _days(logs.where(~held))
    got = replayed([*days[:2], days[2].unionByName(logs.where(held))], lambda s: metric_windows(s, watermark="1 hour", **how), name)
    return got.select("run", "benchmark", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "lo", "hi")


@query(SLIDES.replace("SLIDE", "6").replace("BACK", "[0]"))
def q32c_stream_windows(spark, sf_dir):
    """STR-1: tumbling windows of a stream with late rows."""
    return _windows(spark, sf_dir, "tumbling", window="6 hours")


@query(SLIDES.replace("SLIDE", "2").replace("BACK", "[0, 2, 4]"))
def q32d_stream_sliding(spark, sf_dir):
    """STR-1: sliding windows of a stream with late rows."""
    return _windows(spark, sf_dir, "sliding", window="6 hours", slide="2 hours")


@query(f"""WITH {LATE}, a AS (SELECT m.* FROM m, w WHERE NOT (held AND ts + INTERVAL 1 HOUR <= late)),
           g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY run, benchmark ORDER BY ts, step) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM a),
           k AS (SELECT *, sum(s) OVER (PARTITION BY run, benchmark ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS k FROM g),
           r AS (SELECT run, benchmark, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS over, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM k GROUP BY run, benchmark, k)
           SELECT run, benchmark, start, n, mean, lo, hi FROM r, w WHERE over <= closed""")
def q32e_stream_sessions(spark, sf_dir):
    """STR-1: session windows of a stream with late rows."""
    return _windows(spark, sf_dir, "sessions", window="1 hour", session=True)


@query("""WITH r AS (SELECT run, benchmark, step, value, row_number() OVER (PARTITION BY run, benchmark ORDER BY step DESC) AS l, row_number() OVER (PARTITION BY run, benchmark ORDER BY value DESC, step) AS b FROM fx_metrics)
          SELECT 'last' AS policy, run, benchmark, step, value FROM r WHERE l = 1 UNION ALL SELECT 'best', run, benchmark, step, value FROM r WHERE b = 1""")
def q43_checkpoint_policies(spark, sf_dir):
    m = fixture(spark, sf_dir, "fx_metrics").select("run", "benchmark", "step", "value")
    rows = [T.select_checkpoints(m, p, ["run", "benchmark"]).select(F.lit(p).alias("policy"), "run", "benchmark", "step", "value") for p in ("last", "best")]
    return rows[0].unionByName(rows[1])


@query("""SELECT regexp_extract(p_name, '^([^. ]*)', 1) AS prefix, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1""")
def q43b_counts_by_prefix(spark, sf_dir):
    return T.count_by_prefix(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", "p_size")
