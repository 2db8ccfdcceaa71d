"""Error monitoring in batch, and the same over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import monitor
from seriesmill.plans.base import Query, with_
from seriesmill.plans.tables import PERSISTENCE, USER_DAILY, Tables
from seriesmill.session import scratch_path
from seriesmill.streaming.daily import daily_table, daily_totals
from seriesmill.streaming.learner import online_forecasts, online_learner
from seriesmill.streaming.monitor import prediction_monitor, stream_errors
from seriesmill.streaming.reorder import Ordered, late_rows, ordered_rows, release_in_order
from seriesmill.streaming.run import drain, file_stream

# The events cover 30 days, so the windows are shorter than the defaults.
RECENT, MIN_SAMPLES, LIMIT = 14, 7, 0.2
WINDOW, LOOKBACK = 14, 7


def rolling_sql(recent: int) -> str:
    half = recent // 2
    frame = f"OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN {recent - 1} PRECEDING AND CURRENT ROW)"
    return f"""
windows AS (SELECT *, list(error) {frame} AS w FROM errors),
rolling AS (SELECT series_key, ds, error, len(w) AS num_samples, list_avg(w) AS mean_error,
  CASE WHEN len(w) > 1 THEN list_aggregate(w, 'stddev_samp') END AS sd_error,
  CASE WHEN len(w) >= {half} THEN abs((list_avg(w[-{half}:]) - list_avg(w[1:{half}])) / list_avg(w[1:{half}])) END AS drift FROM windows)"""


ONLINE = f"""
seen AS (SELECT *, list(y) OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS w FROM series),
fits AS (SELECT series_key, ds, list_avg(w) AS mean, greatest(0.1, list_aggregate(w, 'stddev_pop')) AS sd, w[-{LOOKBACK}:] AS v
  FROM seen WHERE len(w) = {WINDOW}),
next_day AS (SELECT series_key, ds + 1 AS ds, greatest(0, mean + sd * 2 * tanh(0.5 * (
    list_sum(list_transform(v, lambda x, j: (x - mean) / sd / (1 + exp(-10 * ((j - 1) / {LOOKBACK} - 0.5)))))
    + 0.2 * (v[{LOOKBACK}] - v[{LOOKBACK - 2}]) / sd))) AS predicted FROM fits),
errors AS (SELECT n.series_key, n.ds, predicted, y AS actual, abs((predicted - y) / y) AS error
  FROM next_day n JOIN series s ON n.series_key = s.series_key AND n.ds = s.ds WHERE y <> 0)"""


def learner_sql() -> str:
    half = WINDOW // 2
    frame = f"OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"
    return f"""
windows AS (SELECT *, list(error) {frame} AS w FROM errors),
learner0 AS (SELECT *, len(w) AS num_samples, list_avg(w) AS mean_error,
  CASE WHEN len(w) > 1 THEN list_aggregate(w, 'stddev_samp') END AS sd_error,
  CASE WHEN len(w) >= {WINDOW} THEN abs((list_avg(w[-{half}:]) - list_avg(w[1:{half}])) / list_avg(w[1:{half}])) END AS drift FROM windows),
learner AS (SELECT *, coalesce(drift > 0.1, false) AS drifted FROM learner0)"""


# Greedy cool-down: the next alert is the first degraded day more than one day later.
ALERTS = f"""
bad AS (SELECT * FROM rolling WHERE num_samples >= {MIN_SAMPLES} AND mean_error > {LIMIT}),
alerts AS (SELECT series_key, min(ds) AS ds FROM bad GROUP BY 1 UNION ALL
  SELECT a.series_key, (SELECT min(b.ds) FROM bad b WHERE b.series_key = a.series_key AND date_diff('day', a.ds, b.ds) > 1)
  FROM alerts a WHERE a.ds IS NOT NULL)"""


def _plain(df, *columns):
    """Undefined measures shown as -1."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1.0)) for c in columns})


def _plain_sql(*columns: str) -> str:
    return f"* REPLACE ({', '.join(f'coalesce({c}, -1) AS {c}' for c in columns)})"


def _errors(t: Tables):
    return monitor.online_errors(t.user_daily(), WINDOW, LOOKBACK)


def _event_stream(t: Tables):
    return file_stream(t.spark, t.sf_dir, t.table("events"), "events.parquet")


def _stream_daily(t: Tables):
    return daily_table(daily_totals(_event_stream(t), "user_id"), scratch_path(t.spark, "daily"), scratch_path(t.spark, "daily-progress"))


BATCHES = 8


def _arrivals(t: Tables):
    """Each user's days as they might arrive: most by date, some up to five days later, dealt over micro-batches by arrival."""
    first = F.lit("1970-01-01").cast("date")
    day = F.datediff("ds", first)
    lag = (F.col("series_key").cast("long") * 7 + day * 3) % 11
    rows = t.user_daily().withColumn("arrival", day + F.when(lag > 6, lag - 6).otherwise(0))
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.floor((F.col("arrival") - low) * BATCHES / (high - low + 1)).cast("int")
    return rows.withColumn("part", part).select("series_key", "ds", "y", "part")


ARRIVALS = f"""
arrivals AS (SELECT *, CAST(floor((arrival - min(arrival) OVER ()) * {BATCHES} / (max(arrival) OVER () - min(arrival) OVER () + 1)) AS INT) AS part
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', ds) + CASE WHEN lag > 6 THEN lag - 6 ELSE 0 END AS arrival
    FROM (SELECT *, (CAST(series_key AS BIGINT) * 7 + date_diff('day', DATE '1970-01-01', ds) * 3) % 11 AS lag FROM series))),
marks AS (SELECT part, max(max(ds)) OVER (ORDER BY part) - 1 AS reached FROM arrivals GROUP BY part),
told AS (SELECT a.*, m.reached AS passed, coalesce(a.ds <= m.reached, false) AS late
  FROM arrivals a LEFT JOIN marks m ON m.part = a.part - 1)"""


def _in_batches(t: Tables, rows):
    """The rows as a stream with a micro-batch for each ``part``: one file after the other."""
    path = scratch_path(t.spark, "arrivals")
    held = scratch_path(t.spark, "arrivals-all")
    rows.write.parquet(held)
    kept = t.spark.read.schema(rows.schema).parquet(held)
    for part in range(BATCHES):
        kept.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return file_stream(t.spark, path, rows.drop("part"), per_trigger=1)


def _ordered(t: Tables):
    return release_in_order(_in_batches(t, _arrivals(t)), Ordered.below(scratch_path(t.spark, "ordered")))


def _stream_late(t: Tables):
    """Late rows of an arriving stream, and the days that were released, in order and in full."""
    schema = "series_key string, ds date, y double"
    paths = _ordered(t)
    late = late_rows(t.spark, paths, schema).withColumn("late", F.lit(True))
    return late.unionByName(ordered_rows(t.spark, paths, schema).withColumn("late", F.lit(False)))


def _stream_errors(t: Tables):
    """Forecasts come in one stream and actuals in another, each over several micro-batches."""
    rows = t.persistence()
    part = (F.datediff("ds", F.lit("1970-01-01").cast("date")) / 8).cast("int")
    dealt = rows.withColumn("part", part - F.lit(rows.agg(F.min(part)).first()[0]))
    forecasts = _in_batches(t, dealt.select("series_key", "ds", F.col("predicted").alias("yhat"), "part"))
    actuals = _in_batches(t, dealt.select("series_key", "ds", F.col("actual").alias("y"), "part"))
    return drain(stream_errors(forecasts, actuals, "30 days"), "errors")


HORIZON = 3


def _stream_forecasts(t: Tables):
    """Days in order over several micro-batches; after each, the next three days with bounds."""
    schema = "series_key string, ds date, y double"
    paths = _ordered(t)
    rows = ordered_rows(t.spark, paths, schema)
    return drain(online_forecasts(_as_stream(t, rows, "ordered-in"), WINDOW, LOOKBACK, HORIZON), "forecasts")


ONLINE_PATHS = f"""
kept AS (SELECT series_key, ds, y FROM told WHERE NOT late),
seen AS (SELECT *, list(y) OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS w FROM kept),
fits AS (SELECT series_key, ds AS made, list_avg(w) AS mean, greatest(0.1, list_aggregate(w, 'stddev_pop')) AS sd, w[-{LOOKBACK}:] AS v FROM seen WHERE len(w) = {WINDOW}),
path AS (SELECT series_key, made, mean, sd, list_transform(v, lambda x: (x - mean) / sd) AS z, 0 AS step, CAST(NULL AS DOUBLE) AS f FROM fits
  UNION ALL SELECT series_key, made, mean, sd, list_append(z[2:], n), step + 1, n FROM (SELECT *, 2 * tanh(0.5 * (
    list_sum(list_transform(z, lambda x, j: x / (1 + exp(-10 * ((j - 1) / {LOOKBACK} - 0.5))))) + 0.2 * (z[{LOOKBACK}] - z[{LOOKBACK - 2}]))) AS n
    FROM path WHERE step < {HORIZON}))"""


def _as_stream(t: Tables, df, label: str):
    """Write a batch table to the shared folder and read it back as a stream.

    All days of a key go to one file, so they arrive in one micro-batch however
    many files a trigger takes; spread over files they could come out of order.
    """
    path = scratch_path(t.spark, label)
    df.repartition("series_key").write.parquet(path)
    return file_stream(t.spark, path, df, per_trigger=64)


def _stream_learner(t: Tables):
    rows = drain(online_learner(_as_stream(t, t.user_daily(), "daily-in"), WINDOW), "learner")
    return rows.where(F.col("error").isNotNull())


def _stream_monitor(t: Tables):
    source = _as_stream(t, t.persistence(), "predictions-in")
    return drain(prediction_monitor(source, RECENT, MIN_SAMPLES, LIMIT), "monitor").where(~F.col("late"))


_ROLLING = "series_key ds:d error:r num_samples:i mean_error:r sd_error:r drift:r"
_LEARNER = "series_key ds:d actual:r predicted:r error:r num_samples:i mean_error:r sd_error:r drift:r drifted:b"

QUERIES = [
    Query(
        "online_errors", "series_key ds:d predicted:r actual:r error:r", _errors,
        with_(USER_DAILY, ONLINE, select="SELECT * FROM errors"),
    ),
    Query(
        "learner_performance", _LEARNER,
        lambda t: _plain(monitor.learner_performance(_errors(t), WINDOW), "sd_error", "drift"),
        with_(USER_DAILY, ONLINE, learner_sql(), select=f"SELECT {_plain_sql('sd_error', 'drift')} FROM learner"),
    ),
    Query(
        "drift", "series_key ds:d num_samples:i drift:r drifted:b",
        lambda t: _plain(monitor.drift_flags(_errors(t), WINDOW), "drift"),
        with_(
            USER_DAILY, ONLINE, learner_sql(),
            select=f"""SELECT {_plain_sql('drift')} FROM learner
                       QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) = 1""",
        ),
    ),
    Query(
        "prediction_history", "series_key ds:d predicted:r actual:r error:r",
        lambda t: monitor.prediction_history(t.persistence(), 20),
        with_(
            USER_DAILY, PERSISTENCE,
            select="SELECT * FROM errors QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) <= 20",
        ),
    ),
    Query(
        "performance_metrics", "series_key num_samples:i mean_error:r sd_error:r drift:r last_update:d",
        lambda t: _plain(monitor.performance(t.persistence(), RECENT), "sd_error", "drift"),
        with_(
            USER_DAILY, PERSISTENCE, rolling_sql(RECENT),
            select=f"""SELECT {_plain_sql('sd_error', 'drift')}, ds AS last_update FROM rolling
                       QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) = 1""",
        ),
    ),
    Query(
        "metric_history", _ROLLING, lambda t: _plain(monitor.metric_history(t.persistence(), RECENT, 10), "sd_error", "drift"),
        with_(
            USER_DAILY, PERSISTENCE, rolling_sql(RECENT),
            select=f"""SELECT {_plain_sql('sd_error', 'drift')} FROM rolling
                       QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) <= 10""",
        ),
    ),
    Query(
        "degradation_alerts", "series_key ds:d mean_error:r",
        lambda t: monitor.degradation_alerts(t.persistence(), RECENT, MIN_SAMPLES, LIMIT),
        with_(
            USER_DAILY, PERSISTENCE, rolling_sql(RECENT), ALERTS,
            select="SELECT r.* FROM alerts a JOIN rolling r ON a.series_key = r.series_key AND a.ds = r.ds", recursive=True,
        ),
    ),
    Query(
        "stream_daily", "series_key ds:d y:r", _stream_daily,
        "SELECT CAST(user_id AS VARCHAR) AS series_key, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1, 2",
    ),
    Query(
        "stream_late_rows", "series_key ds:d y:r late:b", _stream_late,
        with_(USER_DAILY, ARRIVALS, select="SELECT series_key, ds, y, late FROM told"),
    ),
    Query(
        "stream_forecast_errors", "series_key ds:d predicted:r actual:r error:r",
        lambda t: _plain(_stream_errors(t), "error"),
        with_(USER_DAILY, PERSISTENCE, select="SELECT *, coalesce(abs((predicted - actual) / nullif(actual, 0)), -1) AS error FROM predictions"),
    ),
    Query(
        "stream_online_forecast", "series_key made:d step:i ds:d yhat:r lo:r hi:r", _stream_forecasts,
        with_(
            USER_DAILY, ARRIVALS, ONLINE_PATHS,
            select="""SELECT series_key, made, step, made + CAST(step AS INT) AS ds, greatest(0, f * sd + mean) AS yhat,
                        greatest(0, f * sd + mean - sd * 0.5 * (1 + sqrt(step) / sqrt(7))) AS lo, f * sd + mean + sd * 0.5 * (1 + sqrt(step) / sqrt(7)) AS hi
                      FROM path WHERE step > 0""",
            recursive=True,
        ),
    ),
    Query(
        "stream_online_learner", _LEARNER, lambda t: _plain(_stream_learner(t), "sd_error", "drift"),
        with_(USER_DAILY, ONLINE, learner_sql(), select=f"SELECT {_plain_sql('sd_error', 'drift')} FROM learner"),
    ),
    Query(
        "stream_monitor", _ROLLING + " alert:b", lambda t: _plain(_stream_monitor(t), "sd_error", "drift"),
        with_(
            USER_DAILY, PERSISTENCE, rolling_sql(RECENT), ALERTS,
            select=f"""SELECT {_plain_sql('sd_error', 'drift')}, x.d IS NOT NULL AS alert FROM rolling r
                       LEFT JOIN (SELECT series_key AS k, ds AS d FROM alerts) x ON r.series_key = x.k AND r.ds = x.d""",
            recursive=True,
        ),
    ),
]
