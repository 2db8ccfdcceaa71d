"""Sales and store enrichment and the engineered feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import calendar as cal
from seriesmill.functions.parsing import BLANK_CATEGORY, BLANK_INTERVAL

# Feature vector slots, in order.
FEATURE_SLOTS = (
    "store_id", "year", "month", "day", "day_of_week", "is_weekend", "open", "promo",
    "is_public_holiday", "school_holiday", "competition_distance", "competition_open_months",
    "promo2", "promo2_active_months", "promo2_active",
)

STORE_DEFAULTS = {
    "store_type": BLANK_CATEGORY,
    "assortment": BLANK_CATEGORY,
    "promo2": 0,
    "promo_interval": BLANK_INTERVAL,
}


def first_per_key(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The first row of each key by ``order``, as a map-side combinable aggregate."""
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), order)
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def enrich_sales(sales: DataFrame, store: DataFrame) -> DataFrame:
    """Left join of the store columns; sales without a store keep the defaults.

    ``store`` must be unique by ``store_id`` (see ``first_per_key``).  No
    broadcast is forced: Spark broadcasts a store table it has measured to be
    small and splits skewed stores otherwise.
    """
    joined = sales.join(store, "store_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in STORE_DEFAULTS.items()})


def add_calendar(df: DataFrame, profile: str = "live") -> DataFrame:
    ds = F.col("ds")
    weekday = cal.iso_weekday(ds) if profile == "live" else cal.sunday_weekday(ds)
    weekend = weekday >= 6 if profile == "live" else (weekday == 0) | (weekday == 6)
    return df.withColumns({
        "year": F.year(ds), "month": F.month(ds), "day": F.dayofmonth(ds),
        "day_of_week": weekday, "is_weekend": weekend,
    })


def add_holidays(df: DataFrame, profile: str = "live") -> DataFrame:
    code = F.col("state_holiday")
    return df.withColumns({
        "is_public_holiday": cal.holiday_flag(code, "public", profile),
        "is_easter_holiday": cal.holiday_flag(code, "easter", profile),
        "is_christmas": cal.holiday_flag(code, "christmas", profile),
    })


def add_competition(df: DataFrame) -> DataFrame:
    age = cal.competition_months(
        F.col("ds"), F.col("competition_open_since_year"), F.col("competition_open_since_month")
    )
    return df.withColumn("competition_open_months", age)


def add_promo(df: DataFrame, profile: str = "live") -> DataFrame:
    """Promotion age and whether this month is a promotion month.

    ``live``: age in whole 30-day blocks.  ``kaggle``: age in calendar months,
    and only for stores that take part (``promo2 = 1``).
    """
    ds = F.col("ds")
    start = cal.week_start(F.col("promo2_since_year"), F.col("promo2_since_week"))
    listed = cal.month_listed(ds, F.col("promo_interval"))
    if profile == "live":
        age = cal.promo_blocks(ds, start)
        running = start.isNotNull()
    else:
        age = F.when(F.col("promo2") == 1, cal.months_between_ym(ds, F.year(start), F.month(start)))
        running = start.isNotNull() & (F.col("promo2") == 1)
    return df.withColumns({
        "promo2_active_months": F.coalesce(age, F.lit(0)),
        "promo2_active": F.coalesce(running & listed, F.lit(False)),
    })


def add_features(df: DataFrame, profile: str = "live") -> DataFrame:
    """All engineered columns on an enriched sales table."""
    return add_promo(add_competition(add_holidays(add_calendar(df, profile), profile)), profile)


def feature_vector() -> Column:
    """Numeric array in slot order; flags as 0/1, unknown distance as -1."""
    slot = {name: F.col(name).cast("double") for name in FEATURE_SLOTS}
    for flag in ("is_weekend", "is_public_holiday", "promo2_active"):
        slot[flag] = F.col(flag).cast("int").cast("double")
    slot["competition_distance"] = F.coalesce(slot["competition_distance"], F.lit(-1.0))
    return F.array(*[slot[name] for name in FEATURE_SLOTS])


def label() -> Column:
    return F.coalesce(F.col("sales"), F.lit(0.0))


def to_demand(df: DataFrame) -> DataFrame:
    """Date, sales and the store as a text key."""
    return df.select(F.col("store_id").cast("string").alias("series_key"), "ds", F.col("sales").alias("y"))
