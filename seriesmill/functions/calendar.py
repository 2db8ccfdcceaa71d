"""Calendar, holiday, competition and promotion expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holiday letters by profile (public, Easter, Christmas).
# ``live`` calls every code but "0" public; ``kaggle`` gives each its letter.
HOLIDAY_CODES = {
    "live": {"public": None, "easter": "a", "christmas": "b"},
    "kaggle": {"public": "a", "easter": "b", "christmas": "c"},
}

PROMO_BLOCK_DAYS = 30


def iso_weekday(ds: Column) -> Column:
    """Monday 1 … Sunday 7."""
    return F.weekday(ds) + 1


def sunday_weekday(ds: Column) -> Column:
    """Sunday 0 … Saturday 6."""
    return F.dayofweek(ds) - 1


def holiday_flag(code: Column, which: str, profile: str = "live") -> Column:
    letter = HOLIDAY_CODES[profile][which]
    return code != F.lit("0") if letter is None else code == F.lit(letter)


def months_between_ym(ds: Column, year: Column, month: Column) -> Column:
    """Calendar months from (year, month) to ``ds``; negative before it."""
    return (F.year(ds) - year) * 12 + F.month(ds) - month


def competition_months(ds: Column, since_year: Column, since_month: Column) -> Column:
    return F.coalesce(months_between_ym(ds, since_year, since_month), F.lit(0))


def week_start(year: Column, week: Column) -> Column:
    """Monday on or before 1 January, plus ``week - 1`` weeks."""
    first_monday = F.trunc(F.make_date(year, F.lit(1), F.lit(1)), "WEEK")
    return F.date_add(first_monday, ((week - 1) * 7).cast("int"))


def promo_blocks(ds: Column, start: Column) -> Column:
    """Whole 30-day blocks since ``start``, cut toward zero."""
    return (F.datediff(ds, start) / PROMO_BLOCK_DAYS).cast("int")


def month_listed(ds: Column, month_list: Column) -> Column:
    """Is the month of ``ds`` in a comma list of abbreviated month names?"""
    listed = F.transform(F.split(F.lower(month_list), ","), lambda name: F.trim(name))
    return F.array_contains(listed, F.lower(F.date_format(ds, "MMM")))
