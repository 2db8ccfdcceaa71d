"""Text to typed values without raising: a bad value becomes null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order (month before day).
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")

# What blank text stands for.
BLANK_HOLIDAY = "0"
BLANK_CATEGORY = "Unknown"
BLANK_INTERVAL = "None"


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First layout that fits, else null."""
    tries = [F.try_to_timestamp(F.trim(text), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries).cast("date")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def blank_to_default(text: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(default))


def parse_number(text: Column, dtype: str) -> Column:
    """Nullable numeric parse; blank, ``NA`` and junk give null."""
    return F.nullif(blank_to_null(text), F.lit("NA")).try_cast(dtype)


def parse_int(text: Column) -> Column:
    return parse_number(text, "int")


def parse_double(text: Column) -> Column:
    return nan_to_null(parse_number(text, "double"))


def parse_flag(text: Column) -> Column:
    """``1`` for the text "1", otherwise ``0``."""
    return F.when(F.trim(text) == "1", 1).otherwise(0)


def nan_to_null(value: Column) -> Column:
    """Spark sorts NaN above every number, so NaN is turned to null at ingest."""
    return F.when(~F.isnan(value), value)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
