"""Build, fill, index, cut and extend daily series.

``to_series`` aggregates to one row per key and day before anything is
shuffled by key alone, so a key holding a third of the raw rows still arrives
as at most one row per calendar day.  All windows below lean on that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.metrics import relative_error
from seriesmill.functions.parsing import nan_to_null

KEY = "series_key"


def by_key() -> Window:
    return Window.partitionBy(KEY)


def in_order(order: str = "ds") -> Window:
    return Window.partitionBy(KEY).orderBy(order)


def all_rows(order: str = "ds") -> Window:
    """The whole key, but on the ordered window, so that one window pass serves both."""
    return in_order(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def to_series(df: DataFrame, key: str | Column, ds: str | Column, y: str | Column, agg=F.sum, rows: int | None = None) -> DataFrame:
    """One row per key and day; partial sums are combined on the map side.  NaN counts as missing.

    Where nearly every row has a key and day of its own, partial sums only fill the memory of the task that reads a split: with
    ``rows``, an upper bound of the rows of ``df``, they are dealt by key and day first (see ``spread_rows``, ``deal_rows``).
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    raw = df.select(as_col(key).alias(KEY), as_col(ds).alias("ds"), as_col(y).alias("y"))
    if rows is not None:
        raw = spread_rows(raw, rows, KEY, "ds")
    values = raw.select(
        F.col(KEY).cast("string").alias(KEY),
        F.col("ds").cast("date").alias("ds"),
        nan_to_null(F.col("y").cast("double")).alias("y"),
    )
    if rows is not None:
        values = deal_rows(values, rows, KEY, "ds")
    return values.groupBy(KEY, "ds").agg(agg("y").alias("y"))


# Rows of a partition that is dealt by key: with gaps filled, some 60 MB of sorted rows.
PARTITION_ROWS = 150_000
# Up to so many (the default of spark.shuffle.sort.bypassMergeThreshold) a task writes rows straight to the files of their
# partitions; for more it keeps them, some 80 bytes each, to sort them by partition.
UNSORTED_PARTITIONS = 200


def partitions_for(rows: int, size: int = PARTITION_ROWS) -> int:
    return max(2, -(-rows // size))


def deal_rows(df: DataFrame, rows: int, *columns: str, size: int = PARTITION_ROWS) -> DataFrame:
    """Rows dealt by ``columns`` over one partition (two at least) for each ``size`` of ``rows``, an upper bound of the rows of ``df``.

    Aggregates and windows by these columns take this distribution as it is.  Daily rows compress so well that adaptive
    execution, which goes by bytes, would give millions of them to one task; a number of partitions stays as it is given.
    """
    return df.repartition(partitions_for(rows, size), *columns)


def spread_rows(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Rows of a scan ahead of ``deal_rows``: if that takes many partitions, dealt over fewer first, which a task writes as it reads.

    A split is cut by its bytes and may hold millions of rows.  Project a new column before ``deal_rows``: Spark makes one
    of two repartitions that follow each other directly.
    """
    return df.repartition(UNSORTED_PARTITIONS, *columns) if partitions_for(rows) > UNSORTED_PARTITIONS else df


def deal_by_key(series: DataFrame, rows: int, size: int = PARTITION_ROWS) -> DataFrame:
    """The keys of ``series`` dealt by ``deal_rows`` for windows and models."""
    return deal_rows(series, rows, KEY, size=size)


# A century: no series that is filled day by day gets longer arrays from one gap.
MAX_GAP_DAYS = 36_525


def far_gaps(series: DataFrame, limit: int = MAX_GAP_DAYS) -> DataFrame:
    """The gaps that ``fill_gaps`` would not fill: ``series_key, previous_ds, ds, days``."""
    gaps = series.select(KEY, F.lag("ds").over(in_order()).alias("previous_ds"), "ds").withColumn("days", F.datediff("ds", "previous_ds"))
    return gaps.where(F.col("days") > limit)


def fill_gaps(series: DataFrame, fill: float = 0.0, limit: int = MAX_GAP_DAYS) -> DataFrame:
    """Every day from first to last of the key; days that are missing or have no value get ``fill``.

    A gap of more than ``limit`` days, most likely a wrong date, is an error that names the key and the day; ``far_gaps``
    lists them all, so that they can be mended first.

    Adds the position ``i`` (0-based) and the length ``n``.  Each observed day
    emits itself and the empty days up to the next one, so no calendar is
    joined and the only shuffle is the one by key.
    """
    w, whole = in_order(), all_rows()
    spread = series.select(
        KEY, "ds", "y",
        F.lead("ds").over(w).alias("_next"),
        F.min("ds").over(whole).alias("_first"),
        F.max("ds").over(whole).alias("_last"),
    )
    text = F.format_string("more than %d days without a row after %s of %s", F.lit(limit), F.col("ds").cast("string"), F.col(KEY))
    far = F.datediff("_next", "ds") > limit
    day_before_next = F.when(far, F.raise_error(text).cast("date")).otherwise(F.coalesce(F.date_sub("_next", 1), F.col("ds")))
    return spread.select(
        KEY, "y", "_first", "_last", F.col("ds").alias("_seen"),
        F.explode(F.sequence(F.col("ds"), day_before_next)).alias("ds"),
    ).select(
        KEY,
        "ds",
        F.coalesce(F.when(F.col("ds") == F.col("_seen"), F.col("y")), F.lit(fill)).alias("y"),
        F.datediff("ds", "_first").alias("i"),
        (F.datediff("_last", "_first") + 1).alias("n"),
    )


def with_position(series: DataFrame) -> DataFrame:
    """Position ``i`` and length ``n`` by date order, unless already there."""
    if {"i", "n"} <= set(series.columns):
        return series
    return series.withColumns({
        "i": (F.row_number().over(in_order()) - 1).cast("int"),
        "n": F.count(F.lit(1)).over(all_rows()).cast("int"),
    })


def between_dates(df: DataFrame, start: str, end: str, ds: str = "ds") -> DataFrame:
    """Rows of the days ``start`` to ``end``, whatever time of the last day they carry.

    The comparisons are on the bare column, so they reach the scan.
    """
    day = F.col(ds)
    return df.where((day >= F.lit(start).cast("date")) & (day < F.date_add(F.lit(end).cast("date"), 1)))


def recent_n(series: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of each key.

    Spark turns this rank filter into a per-task group limit before the shuffle,
    so at most ``n`` rows per key and task travel.
    """
    newest = Window.partitionBy(KEY).orderBy(F.desc("ds"))
    return series.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def head(series: DataFrame, n: int) -> DataFrame:
    oldest = Window.partitionBy(KEY).orderBy("ds")
    return series.withColumn("_rank", F.row_number().over(oldest)).where(F.col("_rank") <= n).drop("_rank")


def skip(series: DataFrame, n: int) -> DataFrame:
    return with_position(series).where(F.col("i") >= n)


def train_test_split(series: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``part``: the first ``floor(share * n)`` rows of a key are ``train``."""
    cut = F.floor(F.col("n") * F.lit(share))
    return with_position(series).withColumn("part", F.when(F.col("i") < cut, "train").otherwise("recent"))


def pad_with_history(recent: DataFrame, history: DataFrame, length: int) -> DataFrame:
    """Rows of ``recent``, topped up to ``length`` with the newest history before it."""
    marked = recent.select(KEY, "ds", "y", F.lit(0).alias("_from_history")).unionByName(
        history.select(KEY, "ds", "y", F.lit(1).alias("_from_history"))
    )
    order = Window.partitionBy(KEY).orderBy("_from_history", F.desc("ds"))
    ranked = marked.withColumn("_rank", F.row_number().over(order))
    return ranked.where((F.col("_from_history") == 0) | (F.col("_rank") <= length)).select(KEY, "ds", "y")


def append_forecast(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast in one table, told apart by ``is_forecast``."""
    past = series.select(KEY, "ds", "y", F.lit(False).alias("is_forecast"))
    return past.unionByName(forecast.select(KEY, "ds", F.col("yhat").alias("y"), F.lit(True).alias("is_forecast")))


def split_by_length(series: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of long enough series, one ``key, n, reason`` row per short one)."""
    placed = with_position(series)
    long_enough = placed.where(F.col("n") >= min_rows)
    short = placed.where((F.col("n") < min_rows) & (F.col("i") == 0)).select(
        KEY, F.col("n").cast("long").alias("n"), F.lit("too_short").alias("reason")
    )
    return long_enough, short


def unusable(series: DataFrame, min_rows: int, model: str) -> DataFrame:
    """One error row for each key that ``model`` cannot be fitted to: missing values, or fewer than ``min_rows`` rows."""
    counted = series.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.count_if(missing()).alias("_missing"))
    kind = F.when(F.col("_missing") > 0, "missing_values").when(F.col("_n") < min_rows, "too_short")
    text = F.when(F.col("_missing") > 0, F.concat(F.col("_missing"), F.lit(" of "), F.col("_n"), F.lit(" rows have no value"))).otherwise(
        F.concat(F.col("_n"), F.lit(f" rows, {min_rows} needed")))
    return counted.where(kind.isNotNull()).select(
        KEY, F.lit(model).alias("model"), F.lit("fit").alias("operation"), kind.alias("error_type"), text.alias("message"))


def missing(value: str = "y") -> Column:
    """No value: null or NaN."""
    return F.col(value).isNull() | F.isnan(value)


def sortedness(series: DataFrame, arrival: str) -> DataFrame:
    """Per key: adjacent pairs out of date order when read in ``arrival`` order."""
    w = Window.partitionBy(KEY).orderBy(arrival)
    return (
        series.withColumn("_next", F.lead("ds").over(w))
        .groupBy(KEY)
        .agg(F.count_if(F.col("_next") < F.col("ds")).alias("inversions"))
        .withColumn("is_sorted", F.col("inversions") == 0)
    )


def forecast_errors(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecast against the actual of the same key and day."""
    joined = forecast.join(actuals.select(KEY, "ds", F.col("y").alias("actual")), [KEY, "ds"])
    return joined.withColumn("error", relative_error(F.col("yhat"), F.col("actual")))
