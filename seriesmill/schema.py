"""Explicit schemas and column-name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, DATE, VALUE = "series_key", "ds", "y"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _I, _L, _D, _DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType()

SERIES = _struct((KEY, _S), (DATE, _DATE), (VALUE, _D))

DEMAND = _struct(("ds", _DATE), ("sales", _D), ("state_holiday", _S))

SALES = _struct(
    ("store_id", _I), ("ds", _DATE), ("sales", _D), ("customers", _I), ("open", _I),
    ("promo", _I), ("state_holiday", _S), ("school_holiday", _I),
)

STORE = _struct(
    ("store_id", _I), ("store_type", _S), ("assortment", _S), ("competition_distance", _I),
    ("competition_open_since_month", _I), ("competition_open_since_year", _I), ("promo2", _I),
    ("promo2_since_week", _I), ("promo2_since_year", _I), ("promo_interval", _S),
)

FORECAST = _struct(
    (KEY, _S), ("model", _S), ("step", _I), (DATE, _DATE), ("yhat", _D), ("lo", _D), ("hi", _D),
)

ERRORS = _struct((KEY, _S), ("model", _S), ("operation", _S), ("error_type", _S), ("message", _S))


def resolve(df: DataFrame, *names: str, required: bool = True) -> str | None:
    """The real column for the first of ``names`` present, ignoring case."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    for name in names:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    if required:
        raise ValueError(f"missing column: {' or '.join(names)} (found {', '.join(df.columns)})")
    return None


def column(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """Column by case-insensitive name; ``default`` when it is absent."""
    found = resolve(df, *names, required=default is None)
    return F.col(f"`{found}`") if found else default
