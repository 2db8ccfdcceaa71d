"""From forecast to safety stock, reorder point and order quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import lookups
from seriesmill.operators.series import KEY

DEFAULT_STOCK = 20


def forecast_summary(forecast: DataFrame, by: str = KEY) -> DataFrame:
    """Mean forecast and mean upper margin of each key (or of a group of keys)."""
    return forecast.groupBy(by).agg(
        F.avg("yhat").alias("mean_demand"), F.avg(F.col("hi") - F.col("yhat")).alias("mean_margin")
    )


def lead_time_demand(mean_demand: Column, lead_time) -> Column:
    return mean_demand * lead_time


def safety_stock_from_margin(mean_margin: Column, factor: Column, lead_time) -> Column:
    """``z * (margin / z) * sqrt(lead time)``."""
    lead_time = F.lit(lead_time) if not isinstance(lead_time, Column) else lead_time
    return factor * (mean_margin / factor) * F.sqrt(lead_time)


def safety_stock(series: DataFrame, service_level: float = 0.95, lead_time: int = 3) -> DataFrame:
    """``z * sd(daily demand) * sqrt(lead time)`` per key."""
    factor = lookups.step_value(service_level, lookups.SERVICE_FACTOR, lookups.DEFAULT_FACTOR)
    spread = F.coalesce(F.stddev_samp("y"), F.lit(0.0))
    return series.groupBy(KEY).agg(
        F.avg("y").alias("mean_demand"), (factor * spread * F.sqrt(F.lit(lead_time))).alias("safety_stock")
    )


def reorder_point(series: DataFrame, service_level: float = 0.95, lead_time: int = 3) -> DataFrame:
    """``mean demand * lead time + safety stock`` per key."""
    return safety_stock(series, service_level, lead_time).withColumn(
        "reorder_point", F.col("mean_demand") * lead_time + F.col("safety_stock")
    )


def order_quantity(stock: Column, reorder: Column, lead_demand: Column) -> Column:
    """0 above the reorder point, else enough to return to it plus one lead time."""
    return F.when(stock <= reorder, lookups.whole_up(reorder + lead_demand - stock)).otherwise(0).cast("long")


def eoq(annual_demand: Column, order_cost: Column, holding_cost: Column) -> Column:
    """Economic order quantity ``sqrt(2 D S / H)``; null when holding is free."""
    return F.sqrt(F.try_divide(2 * annual_demand * order_cost, holding_cost))


def with_stock(summary: DataFrame, stock: DataFrame, default_stock: int = DEFAULT_STOCK) -> DataFrame:
    """Left lookup of the stock of each item, ``default_stock`` when unknown."""
    found = stock.select(F.col("item"), F.col("stock").alias("current_stock"))
    return summary.join(found, "item", "left").withColumn(
        "current_stock", F.coalesce("current_stock", F.lit(default_stock))
    )


def _recommend(paired: DataFrame, lead_time: int, service_level: float) -> DataFrame:
    factor = F.lit(lookups.step_value(service_level, lookups.SERVICE_FACTOR, lookups.DEFAULT_FACTOR))
    return (
        paired.withColumn("lead_time_demand", lead_time_demand(F.col("mean_demand"), lead_time))
        .withColumn("safety_stock", safety_stock_from_margin(F.col("mean_margin"), factor, lead_time))
        .withColumn("reorder_point", F.col("lead_time_demand") + F.col("safety_stock"))
        .select(
            "item",
            "current_stock",
            "lead_time_demand",
            "safety_stock",
            "reorder_point",
            order_quantity(F.col("current_stock"), F.col("reorder_point"), F.col("lead_time_demand")).alias(
                "recommended_order"
            ),
            lookups.stock_status(F.col("current_stock"), F.col("safety_stock"), F.col("reorder_point")).alias(
                "stock_status"
            ),
            lookups.days_of_supply(F.col("current_stock"), F.col("lead_time_demand"), F.lit(lead_time)).alias(
                "days_of_supply"
            ),
        )
    )


def recommendations(
    forecast: DataFrame,
    stock: DataFrame,
    lead_time: int = 3,
    service_level: float = 0.95,
    default_stock: int = DEFAULT_STOCK,
) -> DataFrame:
    """One row per item: stock, demand over the lead time, reorder point, order."""
    summary = forecast_summary(forecast).withColumnRenamed(KEY, "item")
    return _recommend(with_stock(summary, stock, default_stock), lead_time, service_level)


def shared_recommendations(
    forecast: DataFrame,
    items: DataFrame,
    lead_time: int = 3,
    service_level: float = 0.95,
) -> DataFrame:
    """Items that share the forecast of their group: ``items(item, series_key, stock)``.

    The summary has one row per group, so the equi join is a lookup.
    """
    paired = items.select("item", KEY, F.col("stock").alias("current_stock")).join(forecast_summary(forecast), KEY)
    return _recommend(paired, lead_time, service_level)


def forecast_detail(forecast: DataFrame, reorder: DataFrame) -> DataFrame:
    """Display table: period, forecast, bounds and reorder point at two decimals."""
    return forecast.join(reorder.select(KEY, "reorder_point"), KEY).select(
        KEY,
        F.date_format("ds", "yyyy-MM-dd").alias("period"),
        *[F.round(c, 2).alias(a) for c, a in (
            ("yhat", "forecasted_demand"), ("lo", "lower_bound"), ("hi", "upper_bound"),
            ("reorder_point", "reorder_point"),
        )],
    )


def period_text(ds: Column, yhat: Column, lo: Column, hi: Column, actual: Column, error: Column) -> Column:
    """One line per forecast period; actual and error only where known."""
    line = F.format_string(
        "%s: Forecast=%.2f, Bounds=[%.2f, %.2f]", F.date_format(ds, "yyyy-MM-dd"), yhat, lo, hi
    )
    known = F.format_string(", Actual=%.2f, Error=%.2f%%", actual, error * 100)
    return F.concat(line, F.when(actual.isNotNull() & error.isNotNull(), known).otherwise(""))
