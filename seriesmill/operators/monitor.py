"""Batch monitoring of prediction error; the streaming twins live in ``streaming``.

Input ``series_key, ds, predicted, actual``, one row per key and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.metrics import drift, relative_error
from seriesmill.operators.models.lookback import SD_FLOOR, LookbackModel
from seriesmill.operators.series import KEY, in_order, recent_n
from seriesmill.operators.stats import lagged

RECENT = 30
MIN_SAMPLES = 30
ERROR_LIMIT = 0.2
COOLDOWN_DAYS = 1
DRIFT_LIMIT = 0.1


def tracked(predictions: DataFrame) -> DataFrame:
    """Adds the relative error; rows where it is undefined are left out."""
    return predictions.withColumn(
        "error", relative_error(F.col("predicted"), F.col("actual"))
    ).where(F.col("error").isNotNull())


def prediction_history(predictions: DataFrame, keep: int) -> DataFrame:
    return recent_n(tracked(predictions), keep)


def performance(predictions: DataFrame, recent: int = RECENT) -> DataFrame:
    """Metrics over the newest ``recent`` errors of each key.

    Drift compares the last and first half of the window; the halves overlap
    when fewer than ``recent`` errors exist.
    """
    half = recent // 2
    newest = recent_n(tracked(predictions), recent)
    placed = newest.withColumns({
        "_old": F.row_number().over(Window.partitionBy(KEY).orderBy("ds")),
        "_new": F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("ds"))),
    })
    last = F.avg(F.when(F.col("_new") <= half, F.col("error")))
    first = F.avg(F.when(F.col("_old") <= half, F.col("error")))
    return placed.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("error").alias("mean_error"),
        F.stddev_samp("error").alias("sd_error"),
        F.when(F.count(F.lit(1)) >= half, drift(last, first)).alias("drift"),
        F.max("ds").alias("last_update"),
    )


def rolling_performance(predictions: DataFrame, recent: int = RECENT) -> DataFrame:
    """``performance`` as it stood after each row."""
    half = recent // 2
    w = in_order()
    frame = w.rowsBetween(-(recent - 1), 0)
    errors = tracked(predictions).select(
        KEY, "ds", "error",
        F.count(F.lit(1)).over(frame).alias("num_samples"),
        F.avg("error").over(frame).alias("mean_error"),
        F.stddev_samp("error").over(frame).alias("sd_error"),
        F.avg("error").over(w.rowsBetween(-(half - 1), 0)).alias("_last"),
        F.collect_list("error").over(frame).alias("_window"),
    )
    first = F.aggregate(F.slice("_window", 1, half), F.lit(0.0), lambda s, x: s + x) / half
    return errors.withColumn(
        "drift", F.when(F.col("num_samples") >= half, drift(F.col("_last"), first))
    ).drop("_last", "_window")


def metric_history(predictions: DataFrame, recent: int, keep: int) -> DataFrame:
    """The newest ``keep`` metric rows of each key."""
    return recent_n(rolling_performance(predictions, recent), keep)


def degraded(
    predictions: DataFrame, recent: int = RECENT, min_samples: int = MIN_SAMPLES, limit: float = ERROR_LIMIT
) -> DataFrame:
    """Rows at which the rolling mean error is above the limit."""
    return rolling_performance(predictions, recent).where(
        (F.col("num_samples") >= min_samples) & (F.col("mean_error") > limit)
    )


def degradation_alerts(
    predictions: DataFrame,
    recent: int = RECENT,
    min_samples: int = MIN_SAMPLES,
    limit: float = ERROR_LIMIT,
    cooldown_days: int = COOLDOWN_DAYS,
) -> DataFrame:
    """Degraded rows with more than ``cooldown_days`` since the previous alert of the key.

    Which rows alert depends on the alerts before them, so each key is folded in
    date order; its degraded rows are at most one per calendar day.
    """
    schema = T.StructType([
        T.StructField(KEY, T.StringType()), T.StructField("ds", T.DateType()),
        T.StructField("mean_error", T.DoubleType()), T.StructField("drift", T.DoubleType()),
    ])

    def alerts(pdf):
        pdf = pdf.sort_values("ds", ignore_index=True)
        keep, last = [], None
        for at, day in enumerate(pdf["ds"]):
            if last is None or (day - last).days > cooldown_days:
                keep.append(at)
                last = day
        return pdf.iloc[keep]

    rows = degraded(predictions, recent, min_samples, limit).select(KEY, "ds", "mean_error", "drift")
    return rows.groupBy(KEY).applyInPandas(alerts, schema)


def online_errors(series: DataFrame, window: int = 30, lookback: int = 7) -> DataFrame:
    """Errors of one-step forecasts, refitted after each row on the last ``window`` rows.

    Columns ``series_key, ds, predicted, actual, error``.  A forecast is scored
    only by a row of the very next day, which the same window pass reads ahead.
    """
    model = LookbackModel(lookback)
    w = in_order()
    frame = w.rowsBetween(-(window - 1), 0)
    newest = [*lagged(lookback, "ds")[1:], F.col("y").alias(f"_l{lookback}")]
    rows = series.select(
        KEY, "ds",
        F.lead("ds").over(w).alias("_next"),
        F.lead("y").over(w).alias("actual"),
        F.count(F.lit(1)).over(frame).alias("_n"),
        F.struct(
            F.avg("y").over(frame).alias("mean"),
            F.greatest(F.lit(SD_FLOOR), F.stddev_pop("y").over(frame)).alias("sd"),
        ).alias("_fit"),
        *newest,
    ).where((F.col("_n") == window) & (F.datediff("_next", "ds") == 1))
    forecast = model.one_step([f"_l{at}" for at in range(1, lookback + 1)], "_fit")
    return tracked(rows.select(
        KEY, F.col("_next").alias("ds"), F.greatest(F.lit(0.0), forecast).alias("predicted"), "actual"
    ))


def learner_performance(errors: DataFrame, window: int = 30, limit: float = DRIFT_LIMIT) -> DataFrame:
    """State of the learner after each error: count, mean, deviation, drift and flag."""
    half = window // 2
    w = in_order()
    frame = w.rowsBetween(-(window - 1), 0)
    older = w.rowsBetween(-(window - 1), -(window - half))
    rows = errors.select(
        KEY, "ds", "actual", "predicted", "error",
        F.count(F.lit(1)).over(frame).alias("num_samples"),
        F.avg("error").over(frame).alias("mean_error"),
        F.stddev_samp("error").over(frame).alias("sd_error"),
        F.avg("error").over(w.rowsBetween(-(half - 1), 0)).alias("_last"),
        F.avg("error").over(older).alias("_first"),
    )
    value = F.when(F.col("num_samples") >= window, drift(F.col("_last"), F.col("_first")))
    return rows.withColumn("drift", value).withColumn(
        "drifted", F.coalesce(F.col("drift") > limit, F.lit(False))
    ).drop("_last", "_first")


def drift_flags(errors: DataFrame, window: int = 30, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Latest drift of each key over its last ``window`` errors."""
    return recent_n(learner_performance(errors, window, limit), 1)
