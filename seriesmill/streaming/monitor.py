"""Prediction monitor: rolling error, drift and alerts with a cool-down."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from seriesmill.functions.metrics import relative_error
from seriesmill.operators.monitor import COOLDOWN_DAYS, ERROR_LIMIT, MIN_SAMPLES, RECENT
from seriesmill.operators.series import KEY
from seriesmill.streaming.learner import relative_drift

OUTPUT = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("ds", T.DateType()),
    T.StructField("error", T.DoubleType()), T.StructField("num_samples", T.LongType()),
    T.StructField("mean_error", T.DoubleType()), T.StructField("sd_error", T.DoubleType()),
    T.StructField("drift", T.DoubleType()), T.StructField("alert", T.BooleanType()),
    T.StructField("late", T.BooleanType()),
])

STATE = T.StructType([
    T.StructField("errors", T.ArrayType(T.DoubleType())), T.StructField("last_day", T.LongType()),
    T.StructField("alert_day", T.LongType()),
])


def with_actuals(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """Stream of actuals joined to a static forecast table by key and day."""
    known = forecast.select(KEY, "ds", F.col("yhat").alias("predicted"))
    return actuals.select(KEY, "ds", F.col("y").alias("actual")).join(known, [KEY, "ds"])


def stream_errors(forecasts: DataFrame, actuals: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of forecasts ``series_key, ds, yhat`` joined to a stream of actuals ``series_key, ds, y`` by key and day.

    Both carry a watermark on the day, so that each side forgets days that lie further back than ``delay`` behind the newest;
    whichever comes first waits for the other.  Errors are null where the actual is 0.
    """
    left = forecasts.select(F.col(KEY).alias("_k"), F.col("ds").cast("timestamp").alias("_made"), "yhat").withWatermark("_made", delay)
    right = actuals.select(KEY, F.col("ds").cast("timestamp").alias("_seen"), F.col("y").alias("actual")).withWatermark("_seen", delay)
    return left.join(right, (F.col("_k") == F.col(KEY)) & (F.col("_made") == F.col("_seen"))).select(
        KEY, F.col("_seen").cast("date").alias("ds"), F.col("yhat").alias("predicted"), "actual",
        relative_error(F.col("yhat"), F.col("actual")).alias("error"))


def prediction_monitor(
    predictions: DataFrame,
    recent: int = RECENT,
    min_samples: int = MIN_SAMPLES,
    limit: float = ERROR_LIMIT,
    cooldown_days: int = COOLDOWN_DAYS,
) -> DataFrame:
    """Metrics after each row of a stream ``series_key, ds, predicted, actual``.

    The metrics look at the last ``recent`` errors, so those are all the state
    holds.  Alerts cool down in event time, which makes a replay give the same
    alerts.  Rows without a defined error are skipped, rows out of date order
    are only reported as ``late``.
    """
    half = recent // 2
    epoch = dt.date(1970, 1, 1)

    def update(key, batches, state):
        errors, last, alerted = ([], None, None)
        if state.exists:
            errors, last, alerted = state.get
            errors = list(errors)
        rows = []
        arrived = pd.concat(list(batches)).sort_values("ds", kind="stable")
        for day_value, predicted, actual in zip(arrived["ds"], arrived["predicted"], arrived["actual"]):
            if pd.isna(predicted) or pd.isna(actual) or actual == 0:
                continue
            day = (day_value - epoch).days
            if last is not None and day <= last:
                rows.append((key[0], day_value, None, len(errors), None, None, None, False, True))
                continue
            last = day
            error = abs((predicted - actual) / actual)
            errors = (errors + [error])[-recent:]
            mean = float(np.mean(errors))
            alert = (
                len(errors) >= min_samples and mean > limit
                and (alerted is None or day - alerted > cooldown_days)
            )
            if alert:
                alerted = day
            rows.append((
                key[0], day_value, error, len(errors), mean,
                float(np.std(errors, ddof=1)) if len(errors) > 1 else None,
                relative_drift(errors, half) if len(errors) >= half else None, alert, False,
            ))
        state.update((errors, last, alerted))
        yield pd.DataFrame(rows, columns=OUTPUT.names)

    return predictions.groupBy(KEY).applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
