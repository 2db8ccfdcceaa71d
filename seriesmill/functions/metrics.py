"""Error measures: per-row columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_error(predicted: Column, actual: Column) -> Column:
    """|(p - a) / a|; null when the actual is 0 or missing."""
    return F.abs(F.try_divide(predicted - actual, actual))


def mape(predicted: Column, actual: Column) -> Column:
    """Mean relative error over positive actuals; null when there are none."""
    return F.avg(F.when(actual > 0, F.abs(F.try_divide(predicted - actual, actual))))


def rmse(predicted: Column, actual: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mae(predicted: Column, actual: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def drift(recent_mean: Column, older_mean: Column) -> Column:
    return F.abs(F.try_divide(recent_mean - older_mean, older_mean))
