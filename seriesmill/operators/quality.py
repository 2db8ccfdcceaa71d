"""Data quality of raw rows ``series_key, ds, y``.

Raw rows may repeat days and one key may hold most of them, so nothing here
windows over raw rows: per-key statistics are map-side combined aggregates
joined back (a join Spark broadcasts when the statistics are small and splits
when a key is skewed), and the date check runs on one row per key and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.parsing import nan_to_null
from seriesmill.operators.series import KEY, in_order

MIN_ROWS = 30
MAX_MISSING_SHARE = 0.1
Z_LIMIT = 3.0
MIN_VALID_SHARE = 0.9


def _clean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", nan_to_null(F.col("y")))


def is_valid():
    """Usable sales: present and not negative (NaN counts as missing)."""
    return F.coalesce(nan_to_null(F.col("y")) >= 0, F.lit(False))


def value_statistics(rows: DataFrame) -> DataFrame:
    """Counts, mean and deviation per key: one map-side combined aggregate."""
    return _clean(rows).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("y") < 0).alias("negative_values"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("sd"),
    )


def day_statistics(rows: DataFrame) -> DataFrame:
    """Missing values and date gaps per key.

    Gaps are neighbouring rows by date that are not one day apart; a repeated day
    is one for each repeat, so the days and how often each occurs are enough.
    """
    days = _clean(rows).groupBy(KEY, "ds").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("y").isNull() | (F.col("y") < 0)).alias("_missing"),
    )
    jump = F.coalesce(F.datediff(F.col("ds"), F.lag("ds").over(in_order())) != 1, F.lit(False))
    return days.withColumn("_jump", jump.cast("long")).groupBy(KEY).agg(
        F.sum("_missing").alias("missing_values"), F.expr("sum(_jump) + sum(_rows - 1)").alias("date_gaps")
    )


def date_gaps(rows: DataFrame) -> DataFrame:
    """Per key: neighbouring rows by date that are not one day apart."""
    return day_statistics(rows).select(KEY, "date_gaps")


def with_zscore(rows: DataFrame) -> DataFrame:
    """Each row with the mean and deviation of its key and its absolute z-score."""
    z = F.abs(F.try_divide(F.col("y") - F.col("mean"), F.col("sd")))
    stats = value_statistics(rows).select(KEY, "mean", "sd")
    return _clean(rows).join(stats, KEY).withColumn("zscore", z)


def anomalies(rows: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Rows further than ``limit`` deviations from the mean of their key."""
    return with_zscore(rows).where(F.col("zscore") > limit).select(
        KEY, "ds", F.col("y").alias("value"), "zscore", "mean", "sd",
        F.when(F.col("y") < F.col("mean"), "low").otherwise("high").alias("side"),
    )


def gap_rows(series: DataFrame) -> DataFrame:
    """The jumps themselves: last day before and first day after each gap."""
    w = in_order()
    return (
        series.select(KEY, F.lag("ds").over(w).alias("previous_ds"), "ds")
        .where(F.datediff("ds", "previous_ds") != 1)
        .withColumn("missing_days", F.datediff("ds", "previous_ds") - 1)
    )


def value_ranges(rows: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Per key: negative rows, and rows above ``mean + limit * sd``."""
    marked = with_zscore(rows).withColumn("upper_limit", F.col("mean") + limit * F.col("sd"))
    return marked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("y") < 0).alias("negative_values"),
        F.count_if(F.col("y") > F.col("upper_limit")).alias("oversize_values"),
        F.count_if(F.col("zscore") > limit).alias("anomalies"),
        F.max("upper_limit").alias("upper_limit"),
    )


def quality_report(
    rows: DataFrame,
    z_limit: float = Z_LIMIT,
    min_rows: int = MIN_ROWS,
    max_missing: float = MAX_MISSING_SHARE,
) -> DataFrame:
    """One verdict row per key with its counts and ``issues``: a code, the figure found and the limit it breaks.

    The anomalous rows are a table of their own (``anomalies``), joined by key,
    since a key may have any number of them.
    """
    joined = value_ranges(rows, z_limit).join(day_statistics(rows), KEY)
    share = F.try_divide(F.col("missing_values"), F.col("total_records"))
    too_short = F.col("total_records") < min_rows
    too_many = share > max_missing

    def finding(code, test, figure, limit):
        return F.when(test, F.struct(F.lit(code).alias("code"), figure.cast("double").alias("figure"), limit.cast("double").alias("limit")))

    none = F.lit(0)
    issues = F.array_compact(F.array(
        finding("too_short", too_short, F.col("total_records"), F.lit(min_rows)),
        finding("missing_share", too_many, share, F.lit(max_missing)),
        finding("date_gaps", F.col("date_gaps") > 0, F.col("date_gaps"), none),
        finding("anomalies", F.col("anomalies") > 0, F.col("anomalies"), none),
        finding("negative", F.col("negative_values") > 0, F.col("negative_values"), none),
        finding("oversize", F.col("oversize_values") > 0, F.col("oversize_values"), none),
    ))
    return joined.withColumn("issues", issues).select(
        KEY, (F.size("issues") == 0).alias("is_valid"), "total_records", "missing_values", "date_gaps",
        "anomalies", "negative_values", "oversize_values", "upper_limit", "issues",
    )


def clean_with_guard(rows: DataFrame, min_share: float = MIN_VALID_SHARE) -> DataFrame:
    """Valid rows of the keys that keep at least ``min_share`` of their rows."""
    kept = rows.groupBy(KEY).agg(
        F.count_if(is_valid()).alias("_valid"), F.count(F.lit(1)).alias("_all")
    ).where(F.col("_valid") >= F.col("_all") * min_share)
    return rows.where(is_valid()).join(kept.select(KEY), KEY, "left_semi")
