"""Scaled lookback: squashed weighted sum of the last standardised values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.arrays import dot, last_values, roll_forward
from seriesmill.functions.lookups import within_limits
from seriesmill.functions.metrics import mape
from seriesmill.operators.models.base import check_horizon, fit_one, fit_when, forecast_rows
from seriesmill.operators.series import KEY, missing, unusable, with_position
from seriesmill.operators.stats import lag_names, lagged

SD_FLOOR = 0.1


def step_weights(lookback: int, extra: Sequence[float] | None = None) -> list[float]:
    """Sigmoid ramp over the window plus optional per-slot weights."""
    extra = [0.0] * lookback if extra is None else list(extra)
    return [1.0 / (1.0 + math.exp(-10.0 * (j / lookback - 0.5))) + extra[j] for j in range(lookback)]


def squash(weighted: Column, trend: Column) -> Column:
    return F.tanh((weighted + trend * 0.2) * 0.5) * 2


class LookbackModel:
    name = "lookback"
    rewindows = True

    def __init__(self, lookback: int = 14, weights: Sequence[float] | None = None):
        self.lookback = within_limits(lookback, "lookback")
        self.weights = step_weights(self.lookback, weights)
        self.min_rows = 2 * self.lookback
        self.window = self.look_back = self.lookback

    def parameters(self) -> dict[str, str]:
        return {"lookback": str(self.lookback)}

    def skipped(self, series: DataFrame) -> DataFrame:
        return unusable(series, self.min_rows, self.name)

    def prepare(self, placed: DataFrame, tag: str) -> DataFrame:
        return placed

    def aggregates(self, tag: str) -> list[Column]:
        return [c.alias(tag + n) for n, c in {
            "n": F.max(F.when(F.col("i").isNotNull(), F.col("n"))), "last_ds": F.max(F.when(F.col("i").isNotNull(), F.col("ds"))),
            "mean": F.avg(F.when(F.col("i").isNotNull(), F.col("y"))), "sd": F.stddev_pop(F.when(F.col("i").isNotNull(), F.col("y"))),
            "window": last_values(F.col("i"), F.col("y"), self.lookback, F.col("n")),
            "missing": F.count_if(F.col("i").isNotNull() & missing()),
        }.items()]

    def finish(self, grouped: DataFrame, tag: str) -> DataFrame:
        of = lambda n: F.col(tag + n)
        return grouped.withColumn(f"{tag}fit", fit_when(
            (of("n") >= self.min_rows) & (of("missing") == 0), n=of("n"), last_ds=of("last_ds"), mean=of("mean"),
            sd=F.greatest(F.lit(SD_FLOOR), of("sd")), window=of("window"),
            slot_weights=F.expr(f"array({', '.join(f'{w!r}D' for w in self.weights)})")))

    def fit(self, series: DataFrame) -> DataFrame:
        return fit_one(with_position(series).where(F.col("n") >= self.min_rows), self)

    def steps(self, horizon: int, of: str = "") -> Column:
        """The forecast as an array of ``(yhat, lo, hi)``, from parameters below ``of``."""
        col = lambda n: F.col(of + n)
        mean, sd = col("mean"), col("sd")
        scaled = F.transform(col("window"), lambda v: (v - mean) / sd)

        def step(w: Column) -> Column:
            return squash(dot(w, col("slot_weights")), F.element_at(w, -1) - F.element_at(w, -3))

        def unscale(z: Column, k: Column) -> Column:
            value = z * sd + mean
            width = sd * 0.5 * (1 + F.sqrt(k + 1) / math.sqrt(7))
            return F.struct(
                F.greatest(F.lit(0.0), value).alias("yhat"),
                F.greatest(F.lit(0.0), value - width).alias("lo"),
                (value + width).alias("hi"),
            )

        return F.transform(roll_forward(scaled, check_horizon(horizon), step), unscale)

    def predict(self, params: DataFrame, horizon: int = 14) -> DataFrame:
        return forecast_rows(params, self.name, self.steps(horizon))

    # -- scoring ---------------------------------------------------------------
    def fit_struct(self, of: str = "") -> Column:
        """Fitted values a score needs, out of this model's parameters below ``of``."""
        return F.struct(F.col(of + "mean").alias("mean"), F.col(of + "sd").alias("sd"))

    def one_step(self, lags: list[str], fit: str, position: str = "i") -> Column:
        """One-step forecast from columns of previous values (oldest first; the newest fit)."""
        lags = lags[-self.lookback:]
        weighted = " + ".join(f"{w!r}D * {x}" for w, x in zip(self.weights, lags))
        scaled = f"({weighted} - {fit}.mean * {math.fsum(self.weights)!r}D) / {fit}.sd"
        trend = f"0.2D * ({lags[-1]} - {lags[-3]}) / {fit}.sd"
        return F.expr(f"tanh(({scaled} + {trend}) * 0.5D) * 2 * {fit}.sd + {fit}.mean")

    def evaluate(self, params: DataFrame, series: DataFrame) -> DataFrame:
        return one_step_mape(self, params, series)


def one_step_predictions(model, params: DataFrame, series: DataFrame) -> DataFrame:
    """Actual and one-step forecast for every row with a full window before it."""
    size = model.look_back
    windows = with_position(series).select(KEY, "ds", "i", "y", *lagged(size)).where(F.col("i") >= size)
    fits = params.select(KEY, model.fit_struct().alias("_fit"))
    predicted = model.one_step(lag_names(size), "_fit", "i")
    return windows.join(fits, KEY).select(KEY, "ds", "i", "y", predicted.alias("yhat"))


def one_step_mape(model, params: DataFrame, series: DataFrame) -> DataFrame:
    """Rows ``key, model, mape``: sliding one-step error over the series."""
    return (
        one_step_predictions(model, params, series)
        .groupBy(KEY)
        .agg(F.first(F.lit(model.name)).alias("model"), mape(F.col("yhat"), F.col("y")).alias("mape"))
    )
