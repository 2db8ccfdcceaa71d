"""Additive decomposition and the forecast that extends it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.models.base import bounds, check_horizon, fit_one, fit_when, forecast_rows
from seriesmill.operators.models.lookback import one_step_mape
from seriesmill.operators.series import KEY, missing, unusable, with_position
from seriesmill.operators.stats import PERIOD, centred, moving_average, over, position_means, position_sums

Z = 1.96


def decompose(series: DataFrame, window: int = 7, period: int = PERIOD) -> DataFrame:
    """Rows ``key, ds, y, trend, seasonal, residual``; trend + seasonal + residual = y."""
    placed = with_position(series)
    # Row by row, so plain columns instead of array functions keep it in generated code.
    whole = over("i")[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    sums = [f"sum(CASE WHEN i % {period} = {p} THEN y ELSE 0D END) {whole} AS _s{p}" for p in range(period)]
    means = [
        f"coalesce(try_divide(_s{p}, floor((n - {p} + {period - 1}) / {period})), 0D) AS _m{p}" for p in range(period)
    ]
    names = [f"_m{p}" for p in range(period)]
    seasonal = f"array({', '.join(names)})[i % {period}] - ({' + '.join(names)}) / {period}"
    return (
        placed.select("*", moving_average(window).alias("trend"), *[F.expr(s) for s in sums])
        .selectExpr(KEY, "ds", "i", "y", "trend", *means)
        .selectExpr(KEY, "ds", "i", "y", "trend", f"{seasonal} AS seasonal")
        .withColumn("residual", F.expr("y - (trend + seasonal)"))
    )


class DecomposeModel:
    """Trend continued by its last step, plus the weekly profile.

    The residual deviation comes out of the same aggregate as the profile: with
    ``d = y - trend`` the residual is ``d - profile[position]``, so its sums
    follow from sums of ``d`` per position.  No join back to the rows.
    """

    name = "decompose"
    rewindows = False
    min_rows = 2

    def __init__(self, window: int = 7, period: int = PERIOD, align_phase: bool = False):
        if window <= 0:
            raise ValueError("window must be positive")
        self.window, self.period, self.align_phase = int(window), int(period), align_phase
        self.look_back = self.window // 2 + 2

    def prepare(self, placed: DataFrame, tag: str) -> DataFrame:
        return placed.withColumn(f"{tag}trend", moving_average(self.window))

    def aggregates(self, tag: str) -> list[Column]:
        period, trend = self.period, f"{tag}trend"
        return [c.alias(tag + n) for n, c in {
            "n": F.expr("max(CASE WHEN i IS NOT NULL THEN n END)"), "last_ds": F.expr("max(CASE WHEN i IS NOT NULL THEN ds END)"),
            "t1": F.expr(f"max(CASE WHEN i = n - 1 THEN {trend} END)"), "t2": F.expr(f"max(CASE WHEN i = n - 2 THEN {trend} END)"),
            "dd": F.expr(f"sum(CASE WHEN i IS NOT NULL THEN (y - {trend}) * (y - {trend}) END)"),
            "s": position_sums("y", period), "d": position_sums(f"(y - {trend})", period),
            "missing": F.count_if(F.col("i").isNotNull() & missing()),
        }.items()]

    def finish(self, grouped: DataFrame, tag: str) -> DataFrame:
        period, n = self.period, f"{tag}n"
        profiled = grouped.withColumn(f"{tag}m", position_means(f"{tag}s", period, n)).withColumn(f"{tag}profile", centred(f"{tag}m", period))
        count = f"floor(({n} - p + {period - 1}) / {period})"
        d, profile = f"{tag}d", f"{tag}profile"

        def over_positions(term: str) -> str:
            return f"aggregate(sequence(0, {period - 1}), 0D, (a, p) -> a + {term})"

        r_sum = over_positions(f"{d}[p] - {profile}[p] * {count}")
        r_square = over_positions(f"{profile}[p] * {profile}[p] * {count} - 2 * {profile}[p] * {d}[p]")
        rest = profiled.withColumns({f"{tag}r": F.expr(r_sum), f"{tag}rr": F.expr(f"{tag}dd + {r_square}")})
        return rest.withColumn(f"{tag}fit", fit_when(
            F.expr(f"{n} >= {self.min_rows} AND {tag}missing = 0"), n=F.col(n), last_ds=F.col(f"{tag}last_ds"), level=F.col(f"{tag}t1"),
            step_size=F.expr(f"{tag}t1 - {tag}t2"), profile=F.col(profile),
            residual_sd=F.expr(f"sqrt(greatest(0D, try_divide({tag}rr - {tag}r * try_divide({tag}r, {n}), {n} - 1)))")))

    def fit(self, series: DataFrame) -> DataFrame:
        return fit_one(with_position(series).where(F.col("n") >= self.min_rows), self)

    def parameters(self) -> dict[str, str]:
        return {"window": str(self.window), "period": str(self.period), "align_phase": str(self.align_phase)}

    def skipped(self, series: DataFrame) -> DataFrame:
        return unusable(series, self.min_rows, self.name)

    def steps(self, horizon: int, of: str = "") -> Column:
        """The forecast as an array of ``(yhat, lo, hi)``, from parameters below ``of``."""
        col = lambda n: F.col(of + n)
        phase = col("n") if self.align_phase else F.lit(0)

        def at(step):
            position = ((step - 1 + phase) % self.period + 1).cast("int")
            raw = col("level") + step * col("step_size") + F.element_at(col("profile"), position)
            return bounds(F.greatest(F.lit(0.0), raw), Z * col("residual_sd") * F.sqrt(step))

        return F.transform(F.sequence(F.lit(1), F.lit(check_horizon(horizon))), at)

    def predict(self, params: DataFrame, horizon: int) -> DataFrame:
        return forecast_rows(params, self.name, self.steps(horizon))

    # -- scoring ---------------------------------------------------------------
    def fit_struct(self, of: str = "") -> Column:
        return F.struct(F.col(of + "profile").alias("profile"))

    def rest_fit(self) -> str:
        """The parameters ``one_step`` needs, from the position means of all folds but one."""
        if self.period != PERIOD:
            raise ValueError(f"folds are summed by positions of a period of {PERIOD}")
        return f"struct(transform(_means, m -> m - aggregate(_means, 0D, (a, b) -> a + b) / {PERIOD}) AS profile)"

    def one_step(self, lags: list[str], fit: str, position: str = "i") -> Column:
        """Trend of the values before a row, one step on, and the profile at the row's position.

        The trend at the end of a series is a mean cut at the end, so ``half + 1`` and ``half + 2`` values give its last two.
        """
        half = self.window // 2
        mean = lambda count: f"({' + '.join(lags[-count:])}) / {count}"
        level, previous = mean(half + 1), mean(half + 2)
        return F.expr(f"greatest(0D, 2 * {level} - {previous} + {fit}.profile[{position} % {self.period}])")

    def evaluate(self, params: DataFrame, series: DataFrame) -> DataFrame:
        return one_step_mape(self, params, series)
