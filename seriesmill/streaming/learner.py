"""Online learner: scores yesterday's forecast, slides its window, forecasts tomorrow."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from seriesmill.functions.lookups import within_limits
from seriesmill.operators.models.base import check_horizon
from seriesmill.operators.models.lookback import SD_FLOOR, step_weights
from seriesmill.operators.models.ssa import affine_rule, leading_vectors
from seriesmill.operators.series import KEY

OUTPUT = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("ds", T.DateType()),
    T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType()),
    T.StructField("error", T.DoubleType()), T.StructField("num_samples", T.LongType()),
    T.StructField("mean_error", T.DoubleType()), T.StructField("sd_error", T.DoubleType()),
    T.StructField("drift", T.DoubleType()), T.StructField("drifted", T.BooleanType()),
    T.StructField("next_forecast", T.DoubleType()), T.StructField("late", T.BooleanType()),
])

STATE = T.StructType([
    T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("errors", T.ArrayType(T.DoubleType())),
    T.StructField("last_day", T.LongType()), T.StructField("forecast", T.DoubleType()),
])


def lookback_step(lookback: int) -> Callable[[np.ndarray], float | None]:
    """Forecast from a full window of values, or None when the window is too short to fit."""
    weights = np.array(step_weights(lookback))

    def step(values: np.ndarray) -> float | None:
        if len(values) < 2 * lookback:
            return None
        mean, sd = values.mean(), max(SD_FLOOR, values.std())
        z = (values[-lookback:] - mean) / sd
        squashed = 2.0 * np.tanh(0.5 * (float(z @ weights) + 0.2 * (z[-1] - z[-3])))
        return max(0.0, float(squashed * sd + mean))

    return step


def ssa_step(window: int, components: int) -> Callable[[np.ndarray], float | None]:
    def step(values: np.ndarray) -> float | None:
        if len(values) < 2 * window:
            return None
        rows = np.lib.stride_tricks.sliding_window_view(values, window)
        rule = affine_rule(rows.mean(0)[None], leading_vectors(np.cov(rows.T)[None], components))
        return float(rule[0][0] + values[-window:] @ rule[1][0])

    return step


def relative_drift(errors: list[float], half: int) -> float | None:
    older, recent = np.mean(errors[:half]), np.mean(errors[-half:])
    return None if older == 0 else abs((recent - older) / older)


def online_learner(
    series: DataFrame, window: int = 30, drift_limit: float = 0.1, step: Callable | None = None
) -> DataFrame:
    """One output row per input row of a daily stream ``series_key, ds, y``.

    State per key is the last ``window`` values and errors.  Rows of a micro-batch
    are taken in date order; a row not after the last one seen is only reported as
    ``late``, and a row without a value is skipped.  An error counts only when the row is the day right after the last.
    """
    window = within_limits(window, "learner_window")
    forecast_from = step or lookback_step(7)
    half = window // 2
    epoch = dt.date(1970, 1, 1)

    def update(key, batches, state):
        values, errors, last, forecast = ([], [], None, None)
        if state.exists:
            values, errors, last, forecast = state.get
            values, errors = list(values), list(errors)
        rows = []
        arrived = pd.concat(list(batches)).sort_values("ds", kind="stable")
        for day_value, actual in zip(arrived["ds"], arrived["y"]):
            day = (day_value - epoch).days
            if last is not None and day <= last:
                rows.append((key[0], day_value, actual, None, None, len(errors), None, None, None, False, None, True))
                continue
            if pd.isna(actual):  # a day without a value is like a day that did not come
                continue
            values = (values + [float(actual)])[-window:]
            predicted = forecast if forecast is not None and last == day - 1 else None
            error = None
            if predicted is not None and actual:
                error = abs((predicted - actual) / actual)
                errors = (errors + [error])[-window:]
            last = day
            if len(values) == window:
                forecast = forecast_from(np.asarray(values))
            drift = relative_drift(errors, half) if len(errors) >= window else None
            rows.append((
                key[0], day_value, float(actual), predicted, error, len(errors),
                float(np.mean(errors)) if errors else None,
                float(np.std(errors, ddof=1)) if len(errors) > 1 else None,
                drift, drift is not None and drift > drift_limit,
                forecast if len(values) == window else None, False,
            ))
        state.update((values, errors, last, forecast))
        yield pd.DataFrame(rows, columns=OUTPUT.names)

    return series.groupBy(KEY).applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


PATHS = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("made", T.DateType()), T.StructField("step", T.IntegerType()),
    T.StructField("ds", T.DateType()), T.StructField("yhat", T.DoubleType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
])

PATH_STATE = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("last_day", T.LongType())])


def lookback_path(values: np.ndarray, lookback: int, horizon: int) -> list[tuple[float, float, float]]:
    """``(yhat, lo, hi)`` of the next days: each standardised step is fed back into the window."""
    weights = np.array(step_weights(lookback))
    mean, sd = values.mean(), max(SD_FLOOR, values.std())
    z = list((values[-lookback:] - mean) / sd)
    path = []
    for k in range(horizon):
        window = np.asarray(z[-lookback:])
        z.append(2.0 * np.tanh(0.5 * (float(window @ weights) + 0.2 * (window[-1] - window[-3]))))
        value, width = z[-1] * sd + mean, sd * 0.5 * (1 + np.sqrt(k + 1) / np.sqrt(7))
        path.append((max(0.0, value), max(0.0, value - width), value + width))
    return path


def online_forecasts(series: DataFrame, window: int = 30, lookback: int = 7, horizon: int = 7, idle: str | None = None) -> DataFrame:
    """After each day of a stream ``series_key, ds, y``, the forecast of the next ``horizon`` days with bounds.

    The state of a key is its last ``window`` values.  Rows of days not after the last one and rows without a value give no
    forecast, nor does a window that is not full.  With ``idle`` (such as ``30 days``, a delay behind the newest day of all keys) a key that
    stays silent for longer is forgotten.
    """
    window = within_limits(window, "learner_window")
    if window < 2 * lookback:
        raise ValueError(f"a window of {window} is too short for a lookback of {lookback}")
    check_horizon(horizon)
    epoch = dt.date(1970, 1, 1)

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        values, last = state.get if state.exists else ([], None)
        values, rows = list(values), []
        arrived = pd.concat(list(batches)).sort_values("ds", kind="stable")
        for day_value, actual in zip(arrived["ds"], arrived["y"]):
            day = (day_value - epoch).days
            if pd.isna(actual) or (last is not None and day <= last):
                continue
            values, last = (values + [float(actual)])[-window:], day
            if len(values) == window:
                path = lookback_path(np.asarray(values), lookback, horizon)
                rows += [(key[0], day_value, k + 1, day_value + dt.timedelta(days=k + 1), *p) for k, p in enumerate(path)]
        state.update((values, last))
        if idle is not None and last is not None:
            # The watermark already lies ``idle`` behind the newest day; a key at or behind it has been silent for so long.
            state.setTimeoutTimestamp(max((last + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=PATHS.names)

    timeout = GroupStateTimeout.NoTimeout
    if idle is not None:
        series = series.withColumn("_at", F.col("ds").cast("timestamp")).withWatermark("_at", idle)
        timeout = GroupStateTimeout.EventTimeTimeout
    return series.groupBy(KEY).applyInPandasWithState(update, PATHS, PATH_STATE, "append", timeout)
