"""Weighted-average forecast with slope and weekday terms, fed back step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.arrays import dot, total
from seriesmill.functions.lookups import CONFIDENCE_Z, DEFAULT_Z, step_value
from seriesmill.operators.models.base import bounds, check_horizon, fit_one, fit_when, forecast_rows
from seriesmill.operators.models.lookback import one_step_mape
from seriesmill.operators.series import KEY, missing, unusable, with_position
from seriesmill.operators.stats import PERIOD, position_sums

MAX_WINDOW = 30
MIN_SEASON_ROWS = 14


class WeightedModel:
    """Each step updates running sums, so it costs the same for any history and window."""

    name = "wma"
    rewindows = False
    min_rows = 1
    window = MAX_WINDOW

    def __init__(self, confidence: float = 0.95, newest_heavy: bool = False):
        self.confidence, self.newest_heavy = confidence, newest_heavy

    def prepare(self, placed: DataFrame, tag: str) -> DataFrame:
        return placed

    def aggregates(self, tag: str) -> list[Column]:
        i, n, y = F.col("i"), F.col("n"), F.col("y")
        used = i.isNotNull()
        span = F.greatest(F.lit(2), F.least(F.lit(MAX_WINDOW), F.floor(n / 4))).cast("int")
        tail = F.collect_list(F.when(i >= n - span, F.struct("i", "y")))
        return [c.alias(tag + name) for name, c in {
            "n": F.max(F.when(used, n)).cast("int"), "last_ds": F.max(F.when(used, F.col("ds"))), "span": F.max(F.when(used, span)),
            "sum_y": F.sum(F.when(used, y)), "sum_iy": F.sum(i.cast("double") * y),
            "sd": F.coalesce(F.stddev_samp(F.when(used, y)), F.lit(0.0)),
            "window": F.transform(F.array_sort(tail), lambda p: p["y"]), "season_sums": position_sums("y", PERIOD),
            "missing": F.count_if(used & missing()),
        }.items()]

    def finish(self, grouped: DataFrame, tag: str) -> DataFrame:
        names = ["n", "last_ds", "span", "sum_y", "sum_iy", "sd", "window", "season_sums"]
        return grouped.withColumn(f"{tag}fit", fit_when(
            (F.col(f"{tag}n") >= self.min_rows) & (F.col(f"{tag}missing") == 0), **{n: F.col(tag + n) for n in names}))

    def fit(self, series: DataFrame) -> DataFrame:
        return fit_one(with_position(series), self)

    def steps(self, horizon: int = 10, of: str = "") -> Column:
        """The forecast as an array of ``(yhat, lo, hi)``, from parameters below ``of``."""
        col = lambda n: F.col(of + n)
        # A window shorter than the span exists only for a single-row series: pad with 0.
        gap = F.greatest(F.lit(0), col("span") - F.size(col("window")))
        window = F.concat(F.array_repeat(F.lit(0.0), gap), col("window"))
        weights = self._weights(col("span"))
        start = F.struct(
            dot(window, weights).alias("ws"),
            total(window).alias("s"),
            col("sum_y").alias("sy"),
            col("sum_iy").alias("siy"),
            col("season_sums").alias("ss"),
            F.expr("cast(array() as array<double>)").alias("out"),
        )
        rounds = F.sequence(F.lit(0), F.lit(check_horizon(horizon) - 1))
        path = F.aggregate(rounds, start, lambda state, k: self._advance(state, k, col, window), lambda s: s["out"])
        z = step_value(self.confidence, CONFIDENCE_Z, DEFAULT_Z)
        return F.transform(path, lambda v, k: bounds(v, z * col("sd") * F.sqrt(1 + k * 0.1)))

    def predict(self, params: DataFrame, horizon: int = 10) -> DataFrame:
        return forecast_rows(params, self.name, self.steps(horizon))

    # -- scoring ---------------------------------------------------------------
    look_back = MAX_WINDOW

    def fit_struct(self, of: str = "") -> Column:
        n, sums, moments = f"{of}n", f"{of}sum_y", f"{of}sum_iy"
        days = f"floor(({n} - p + 6) / 7)"
        slope = f"try_divide({n} * {moments} - {n} * ({n} - 1) / 2 * {sums}, {n} * (({n} - 1) * CAST({n} AS DOUBLE) * (2 * {n} - 1) / 6) - pow({n} * ({n} - 1) / 2, 2))"
        return F.expr(
            f"struct(coalesce({slope}, 0D) AS slope, {of}span AS span, transform({of}season_sums, (s, p) -> "
            f"if({n} >= {MIN_SEASON_ROWS}, coalesce(try_divide(s, {days}), 0D) - {sums} / {n}, 0D)) AS deviations)")

    def rest_fit(self) -> str:
        """The parameters ``one_step`` needs, from the sums of all folds but one."""
        n = "CAST(_left AS DOUBLE)"
        slope = f"try_divide({n} * _siy - {n} * ({n} - 1) / 2 * _sy, {n} * (({n} - 1) * {n} * (2 * {n} - 1) / 6) - pow({n} * ({n} - 1) / 2, 2))"
        return (
            f"struct(coalesce({slope}, 0D) AS slope, CAST(greatest(2, least({MAX_WINDOW}, floor(_left / 4))) AS INT) AS span, "
            f"transform(_means, m -> if(_left >= {MIN_SEASON_ROWS}, m - _sy / _left, 0D)) AS deviations)")

    def one_step(self, lags: list[str], fit: str, position: str = "i") -> Column:
        """Weighted mean of the last ``span`` values, the slope, and the deviation of the row's weekday."""
        weights = f"sequence(1, {fit}.span)" if self.newest_heavy else f"sequence({fit}.span, 1, -1)"
        lags = lags[-MAX_WINDOW:]
        window = f"slice(array({', '.join(lags)}), {len(lags)} - {fit}.span + 1, {fit}.span)"
        level = f"aggregate(zip_with({window}, {weights}, (x, w) -> x * w), 0D, (a, x) -> a + x) / ({fit}.span * ({fit}.span + 1) / 2)"
        return F.expr(f"greatest(0D, {level} + {fit}.slope + {fit}.deviations[{position} % {PERIOD}])")

    def evaluate(self, params: DataFrame, series: DataFrame) -> DataFrame:
        return one_step_mape(self, params, series)

    def parameters(self) -> dict[str, str]:
        return {"confidence": str(self.confidence), "newest_heavy": str(self.newest_heavy)}

    def skipped(self, series: DataFrame) -> DataFrame:
        return unusable(series, self.min_rows, self.name)

    def _weights(self, span: Column) -> Column:
        return F.sequence(F.lit(1), span) if self.newest_heavy else F.sequence(span, F.lit(1), F.lit(-1))

    def _advance(self, state: Column, k: Column, col, window: Column) -> Column:
        n, span = (col("n") + k).cast("double"), col("span")
        newest, oldest = (span, 1) if self.newest_heavy else (F.lit(1), span)
        only_value = (col("n") < span) & (k == 0)
        level = state["ws"] / F.when(only_value, newest).otherwise(span * (span + 1) / 2)

        sum_i, sum_ii = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        slope = F.coalesce(
            F.try_divide(n * state["siy"] - sum_i * state["sy"], n * sum_ii - sum_i * sum_i), F.lit(0.0)
        )
        position = ((n + k) % PERIOD).cast("int")
        days = F.floor((n - position + PERIOD - 1) / PERIOD)
        weekday = F.when(
            n >= MIN_SEASON_ROWS, F.element_at(state["ss"], position + 1) / days - state["sy"] / n
        ).otherwise(0.0)
        nxt = F.greatest(F.lit(0.0), level + slope * (k + 1) + weekday)

        slot = (n % PERIOD).cast("int")
        dropped = F.when(k < span, F.get(window, k)).otherwise(F.get(state["out"], k - span))
        # The rest of the window ages by one place: one weight step up or down.
        rest = state["s"] - dropped
        aged = state["ws"] - dropped * oldest + (-rest if self.newest_heavy else rest)

        def extend(v: Column) -> Column:
            return F.struct(
                (aged + v * newest).alias("ws"),
                (rest + v).alias("s"),
                (state["sy"] + v).alias("sy"),
                (state["siy"] + n * v).alias("siy"),
                F.transform(state["ss"], lambda s, p: s + F.when(p == slot, v).otherwise(0.0)).alias("ss"),
                F.array_append(state["out"], v).alias("out"),
            )

        # The one-element array binds the new value once for all its uses.
        return F.element_at(F.transform(F.array(nxt), extend), 1)
