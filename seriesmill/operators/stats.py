"""Trend, season and spread of a series; embedding windows and their moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.series import KEY, in_order, missing, with_position

PERIOD = 7
MAX_OFFSET_WINDOW = 31


def over(order: str | None = None, keys: tuple[str, ...] = (KEY,)) -> str:
    """Window clause per key, for use inside SQL expressions."""
    return f"OVER (PARTITION BY {', '.join(keys)}" + (f" ORDER BY {order})" if order else ")")


def moving_average(window: int = 7, order: str = "i") -> Column:
    """Centred mean over ``window // 2`` rows to each side, cut at the ends.

    Short windows read their neighbours as lags and leads, which Spark serves
    from one offset buffer; a sliding frame would aggregate the window anew for
    every row.
    """
    half = window // 2
    if window > MAX_OFFSET_WINDOW:
        return F.avg("y").over(in_order(order).rowsBetween(-half, half))
    near = [f"lag(y, {d}) {over(order)}" for d in range(half, 0, -1)]
    near += ["y"] + [f"lead(y, {d}) {over(order)}" for d in range(1, half + 1)]
    total = " + ".join(f"coalesce({v}, 0D)" for v in near)
    present = " + ".join(f"if({v} IS NULL, 0, 1)" for v in near)
    return F.expr(f"try_divide({total}, {present})")


def position_sums(value: str, period: int = PERIOD, position: str = "i % {period}", window: str = "") -> Column:
    """Aggregate: array of the sums of ``value`` per position modulo the period."""
    place = position.format(period=period)
    return F.expr("array(" + ", ".join(
        f"sum(CASE WHEN {place} = {p} THEN {value} ELSE 0D END) {window}" for p in range(period)
    ) + ")")


def position_means(sums: str, period: int = PERIOD, n: str = "n") -> Column:
    """Array of means from an array of sums and the length ``n``; empty positions count as 0."""
    return F.expr(
        f"transform({sums}, (s, p) -> coalesce(try_divide(s, floor(({n} - p + {period - 1}) / {period})), 0D))"
    )


def centred(means: str, period: int = PERIOD) -> Column:
    """Array of position means minus their own mean."""
    return F.expr(f"transform({means}, m -> m - aggregate({means}, 0D, (a, b) -> a + b) / {period})")


_PRESENT = "if(y IS NULL OR isnan(y), 0D, 1D)"


def _present_means() -> Column:
    """Array of position means over the values present; empty positions count as 0."""
    return F.expr("zip_with(_sums, _counts, (s, c) -> coalesce(try_divide(s, c), 0D))")


def seasonal_profile(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """Rows ``key, position, seasonal``: mean of raw values per position, centred."""
    sums = with_position(series).groupBy(KEY).agg(position_sums("y", period).alias("_sums"), position_sums(_PRESENT, period).alias("_counts"))
    means = sums.select(KEY, _present_means().alias("_means"))
    return means.select(KEY, F.posexplode(centred("_means", period)).alias("position", "seasonal"))


def weekday_deviation(series: DataFrame, min_rows: int = 14, period: int = PERIOD) -> DataFrame:
    """Rows ``key, position, deviation``: position mean minus overall mean, 0 for short series."""
    sums = with_position(series).groupBy(KEY).agg(
        F.max("n").alias("n"), F.avg("y").alias("_mean"), position_sums("y", period).alias("_sums"),
        position_sums(_PRESENT, period).alias("_counts"),
    )
    means = sums.select(KEY, "n", "_mean", _present_means().alias("_means"))
    cells = F.expr(f"transform(_means, m -> if(n >= {min_rows}, m - _mean, 0D))")
    return means.select(KEY, F.posexplode(cells).alias("position", "deviation"))


def linear_trend(series: DataFrame) -> DataFrame:
    """Least-squares slope of the value on its position; 0 for a single row."""
    return with_position(series).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.regr_slope(F.col("y"), F.col("i").cast("double")), F.lit(0.0)).alias("slope"),
    )


def deviation_variants(series: DataFrame) -> DataFrame:
    """Sample deviation, its 0-for-one-row form, and the floored population forms."""
    return series.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("y").alias("sd_sample"),
        F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd_or_zero"),
        F.greatest(F.lit(1.0), F.stddev_pop("y")).alias("sd_floor_one"),
        F.greatest(F.lit(0.1), F.stddev_pop("y")).alias("sd_floor_tenth"),
    )


def embedding(series: DataFrame, window: int) -> DataFrame:
    """Trajectory rows: each run of ``window`` values, keyed by the position of its last one."""
    placed = with_position(series)
    frame = in_order("i").rowsBetween(-(window - 1), 0)
    return placed.withColumn("v", F.collect_list("y").over(frame)).where(F.size("v") == window)


def lagged(window: int, order: str = "i", keys: tuple[str, ...] = (KEY,)) -> list[Column]:
    """The ``window`` values before the current row as ``_l0`` (oldest) … ``_l{window-1}``."""
    return [F.expr(f"lag(y, {d}) {over(order, keys)} AS _l{window - d}") for d in range(window, 0, -1)]


def lag_names(window: int) -> list[str]:
    return [f"_l{at}" for at in range(window)]


def fold_sums(folds: DataFrame, window: int) -> DataFrame:
    """``series_key, n, base, folds``: what ``lag_sums`` holds, for each fold of a key apart.

    A product belongs to the fold of its later row.  ``edge`` has the values within ``window - 1`` rows of a fold's ends.  Rows are read
    once and none is copied; a key with a missing value gives no row.
    """
    w = over("o")
    base = f"first(y) {w[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _base"
    before = [f"lag(y, {d}) {w} AS _b{d}" for d in range(1, window)]
    products = [f"coalesce((y - _base) * (_b{d} - _base), 0D) AS _p{d}" for d in range(1, window)]
    edge = window - 1
    near = f"o < fold_start + {edge} OR o >= fold_start + fold_size - {edge}"
    cells = (
        folds.selectExpr(KEY, "n", "o", "fold", "fold_start", "fold_size", "y", base, *before)
        .selectExpr(KEY, "n", "o", "fold", "fold_start", "fold_size", "y", "_base", "y - _base AS _c", "(y - _base) * (y - _base) AS _p0", *products)
        .groupBy(KEY, "fold")
        .agg(
            F.max("n").alias("n"), F.max("_base").alias("base"), F.count_if(missing()).alias("_missing"),
            F.struct(
                F.max("fold_start").alias("start"), F.max("fold_size").alias("size"), F.sum("_c").alias("total"),
                F.expr("array(" + ", ".join(f"sum(_p{d})" for d in range(window)) + ")").alias("products"),
                F.expr(f"collect_list(CASE WHEN {near} THEN struct(o, _c) END)").alias("edge"),
            ).alias("cell"),
        )
    )
    return cells.groupBy(KEY).agg(
        F.max("n").alias("n"), F.max("base").alias("base"), F.sum("_missing").alias("_missing"), F.collect_list("cell").alias("folds")
    ).where("_missing = 0").drop("_missing")


def lag_sums(series: DataFrame, window: int, keys: tuple[str, ...] = (KEY,), keep: int | None = None) -> DataFrame:
    """What the lag covariance of a series needs, one row per ``keys``; ``window`` has its last ``keep`` values (``window``).

    Products are summed per lag distance (``window`` sums) instead of per pair
    of lags (``window * (window + 1) / 2``); the two edges of the series, at most
    ``window - 1`` values each, correct the sums afterwards.  Values are taken
    relative to the first of the key, so that large levels do not drown small
    variances.  The same row serves every shorter window.  A series with a missing value gives no row.
    """
    w = over("i", keys)
    base = f"first(y) {w[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _base"
    before = [f"lag(y, {d}) {w} AS _b{d}" for d in range(1, window)]
    products = [f"coalesce((y - _base) * (_b{d} - _base), 0D) AS _p{d}" for d in range(1, window)]
    edge = window - 1

    def values(test: str, value: str) -> str:
        pairs = f"collect_list(CASE WHEN {test} THEN struct(i, {value} AS v) END)"
        return f"transform(array_sort({pairs}), p -> p.v)"

    return (
        series.selectExpr(*keys, "i", "n", "y", "ds", base, *before)
        .selectExpr(*keys, "i", "n", "y", "ds", "_base", "y - _base AS _c", "(y - _base) * (y - _base) AS _p0", *products)
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.max("_base").alias("base"),
            F.stddev_pop("y").alias("sd_pop"),
            F.max("ds").alias("last_ds"),
            F.sum("_c").alias("offset_sum"),
            F.count_if(missing()).alias("_missing"),
            F.expr("array(" + ", ".join(f"sum(_p{d})" for d in range(window)) + ")").alias("products"),
            F.expr(values(f"i < {edge}", "_c")).alias("head"),
            F.expr(values(f"i >= n - {edge}", "_c")).alias("tail"),
            F.expr(values(f"i >= n - {keep or window}", "y")).alias("window"),
        )
        .where("_missing = 0")
        .drop("_missing")
        # Zeros stand in where a series is shorter than the edge, to keep one array length.
        .withColumns({
            "head": F.expr(f"concat(head, array_repeat(0D, {edge} - size(head)))"),
            "tail": F.expr(f"concat(array_repeat(0D, {edge} - size(tail)), tail)"),
        })
    )
