"""Step tables, parameter limits and name lookups as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence level -> two-sided z, checked from the top down.
CONFIDENCE_Z = ((0.99, 2.58), (0.98, 2.33), (0.95, 1.96), (0.90, 1.65), (0.85, 1.44), (0.80, 1.28))
DEFAULT_Z = 1.96

# Service level -> safety factor, checked from the top down.
SERVICE_FACTOR = ((0.99, 2.33), (0.95, 1.65), (0.90, 1.28))
DEFAULT_FACTOR = 1.65

# Parameter -> (lowest, highest) accepted.
PARAMETER_LIMITS = {
    "window": (2, 30),
    "lookback": (7, 30),
    "epochs": (10, 500),
    "folds": (2, 10),
    "learner_window": (7, 90),
}

# Friendly method name -> method.
METHOD_ALIASES = {
    "Standard (Best for most situations)": "Standard",
    "Advanced (For complex patterns)": "Advanced",
    "Simple (For basic trends)": "Standard",
    "Seasonal (For products with seasonal demand)": "Advanced",
}
DEFAULT_METHOD = "Standard"

DEFAULT_STOCK_LEVEL = 20.0
DEFAULT_LEAD_TIME_DAYS = 3


def step_table(value: Column, steps, default: float) -> Column:
    """Result of the first step whose threshold ``value`` reaches."""
    chain = None
    for threshold, result in steps:
        test = value >= F.lit(threshold)
        chain = F.when(test, F.lit(result)) if chain is None else chain.when(test, F.lit(result))
    return chain.otherwise(F.lit(default))


def confidence_z(level: Column) -> Column:
    return step_table(level, CONFIDENCE_Z, DEFAULT_Z)


def safety_factor(service_level: Column) -> Column:
    return step_table(service_level, SERVICE_FACTOR, DEFAULT_FACTOR)


def step_value(value: float, steps, default: float) -> float:
    """Same lookup for a plain number on the driver."""
    return next((result for threshold, result in steps if value >= threshold), default)


def whole_up(value: Column) -> Column:
    """Ceiling that takes a value within a millionth of a whole number for that number."""
    return F.ceil(F.round(value, 6))


def clamp(value: Column, parameter: str) -> Column:
    low, high = PARAMETER_LIMITS[parameter]
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clamp_components(components: Column, window: Column) -> Column:
    return F.greatest(F.lit(1), F.least(window, components))


def within_limits(value: int, parameter: str) -> int:
    """The value itself; outside its limits an error.  Use ``clamp`` to choose the nearest limit instead."""
    low, high = PARAMETER_LIMITS[parameter]
    if not low <= value <= high:
        raise ValueError(f"{parameter} must lie between {low} and {high}, not {value}")
    return int(value)


def method_for(alias: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in METHOD_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, alias), F.lit(DEFAULT_METHOD))


def stock_status(stock: Column, safety_stock: Column, reorder_point: Column) -> Column:
    return (
        F.when(stock <= safety_stock, "Critical").when(stock <= reorder_point, "Low").otherwise("Adequate")
    )


def days_of_supply(stock: Column, lead_time_demand: Column, lead_time: Column | None = None) -> Column:
    days = F.lit(DEFAULT_LEAD_TIME_DAYS) if lead_time is None else lead_time
    cover = whole_up(F.try_divide(stock, lead_time_demand / days))
    return F.when(lead_time_demand <= 0, F.lit(0)).otherwise(cover).cast("long")


def stock_band(stock: Column, level: Column | None = None) -> Column:
    """CRITICAL below half the level, WARNING below it, GOOD up to twice, else EXCESS."""
    level = F.lit(DEFAULT_STOCK_LEVEL) if level is None else level
    return (
        F.when(stock < level * 0.5, "CRITICAL")
        .when(stock < level, "WARNING")
        .when(stock <= level * 2.0, "GOOD")
        .otherwise("EXCESS")
    )


def band_argument_level(argument: Column) -> Column:
    """Level out of a ``"text:level"`` argument, or the default level."""
    level = F.get(F.split(argument, ":"), 1)
    return F.coalesce(F.trim(level).try_cast("double"), F.lit(DEFAULT_STOCK_LEVEL))


def band_for_argument(stock: Column, argument: Column) -> Column:
    """Text band for mode ``text``; null for any other mode."""
    mode = F.lower(F.trim(F.get(F.split(argument, ":"), 0)))
    return F.when(mode == "text", stock_band(stock, band_argument_level(argument)))


def market_impact(change: Column) -> Column:
    amount = F.coalesce(F.trim(change).try_cast("double"), F.lit(0.0))
    return F.when(amount >= 0, "Positive").otherwise("Negative")
