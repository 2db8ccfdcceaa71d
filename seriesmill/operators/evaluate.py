"""Error tables, folds and cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions import metrics
from seriesmill.functions.lookups import within_limits
from seriesmill.operators.series import KEY, with_position


def error_summary(predicted: DataFrame, *keys: str) -> DataFrame:
    """MAPE, RMSE and MAE of ``yhat`` against ``actual`` per group."""
    p, a = F.col("yhat"), F.col("actual")
    return predicted.groupBy(*(keys or (KEY,))).agg(
        F.count(F.lit(1)).alias("n"),
        metrics.mape(p, a).alias("mape"),
        metrics.rmse(p, a).alias("rmse"),
        metrics.mae(p, a).alias("mae"),
    )


def shuffle_rank(seed: int = 42) -> Column:
    """Order key that depends on the row's position and the seed only."""
    return (F.col("i").cast("long") * 1103515245 + seed * 12345) % 2147483648


def cv_folds(series: DataFrame, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Adds ``o`` (order used), ``fold`` (0-based), ``fold_start`` and ``fold_size``.

    Fold sizes differ by at most one, larger ones first, so the fold of a row is
    arithmetic on its position: contiguous folds need no window at all.
    """
    k = within_limits(k, "folds")
    placed = with_position(series)
    if shuffle:
        order = Window.partitionBy(KEY).orderBy(shuffle_rank(seed), "i")
        placed = placed.withColumn("o", (F.row_number().over(order) - 1).cast("int"))
    else:
        placed = placed.withColumn("o", F.col("i"))
    size, extra = F.floor(F.col("n") / k).cast("int"), F.col("n") % k
    big = extra * (size + 1)
    fold = F.when(F.col("o") < big, F.floor(F.col("o") / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("o") - big, size))
    )
    return (
        placed.withColumn("fold", fold.cast("int"))
        .withColumn("fold_size", (size + F.when(F.col("fold") < extra, 1).otherwise(0)).cast("int"))
        .withColumn("fold_start", (F.col("fold") * size + F.least(F.col("fold"), extra)).cast("int"))
    )


def fold_scores(series: DataFrame, model, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Rows ``key, fold, mape``: fit on the other folds, one-step error on this one."""
    from seriesmill.operators.tune import grid_scores

    return grid_scores(series, [model], k, shuffle, seed).drop("grid_id")


def summarise_folds(scores: DataFrame, *extra: str) -> DataFrame:
    """Mean, deviation and list of the fold errors; folds without one do not count."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("mape").isNotNull(), F.struct("fold", "mape"))))
    return scores.groupBy(KEY, *extra).agg(
        F.avg("mape").alias("mean_mape"),
        F.coalesce(F.stddev_samp("mape"), F.lit(0.0)).alias("sd_mape"),
        F.count("mape").alias("num_folds"),
        F.transform(pairs, lambda p: p["mape"]).alias("fold_results"),
    )


def cross_validate(series: DataFrame, model, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    return summarise_folds(fold_scores(series, model, k, shuffle, seed))
