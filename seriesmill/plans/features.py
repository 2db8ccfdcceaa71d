"""Store enrichment and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import features as f
from seriesmill.plans.base import Query, with_
from seriesmill.plans.tables import SALES, STORE, Tables

ENRICHED = """
enriched AS (SELECT s.*, coalesce(st.store_type, 'Unknown') AS store_type, coalesce(st.assortment, 'Unknown') AS assortment,
  st.competition_distance, st.competition_open_since_month, st.competition_open_since_year, coalesce(st.promo2, 0) AS promo2,
  st.promo2_since_week, st.promo2_since_year, coalesce(st.promo_interval, 'None') AS promo_interval
  FROM sales s LEFT JOIN store st ON s.store_id = st.store_id)"""

_START = """CAST(date_trunc('week', make_date(CAST(promo2_since_year AS INT), 1, 1)) AS DATE) + CAST((promo2_since_week - 1) * 7 AS INT)"""
_ABBREVIATED = "list_contains(string_split(promo_interval, ','), strftime(ds, '%b'))"

FEATURES = f"""
dated AS (SELECT *, CAST({_START} AS DATE) AS promo_start FROM enriched),
features AS (SELECT *, year(ds) AS year, month(ds) AS month, day(ds) AS day, isodow(ds) AS day_of_week, isodow(ds) >= 6 AS is_weekend,
  state_holiday <> '0' AS is_public_holiday, state_holiday = 'a' AS is_easter_holiday, state_holiday = 'b' AS is_christmas,
  coalesce((year(ds) - competition_open_since_year) * 12 + month(ds) - competition_open_since_month, 0) AS competition_open_months,
  coalesce(trunc(date_diff('day', promo_start, ds) / 30.0), 0) AS promo2_active_months,
  promo_start IS NOT NULL AND {_ABBREVIATED} AS promo2_active FROM dated)"""

KAGGLE = f"""
dated AS (SELECT *, CAST({_START} AS DATE) AS promo_start FROM enriched),
features AS (SELECT *, dayofweek(ds) AS day_of_week, dayofweek(ds) IN (0, 6) AS is_weekend,
  state_holiday = 'a' AS is_public_holiday, state_holiday = 'b' AS is_easter_holiday, state_holiday = 'c' AS is_christmas,
  CASE WHEN promo2 = 1 AND promo_start IS NOT NULL
    THEN (year(ds) - year(promo_start)) * 12 + month(ds) - month(promo_start) ELSE 0 END AS promo2_active_months,
  promo2 = 1 AND promo_start IS NOT NULL AND {_ABBREVIATED} AS promo2_active FROM dated)"""


def enriched(t: Tables):
    store = f.first_per_key(t.store(), "store_id", F.col("store_type"))
    return f.enrich_sales(t.sales(), store)


def featured(t: Tables, profile: str = "live"):
    return f.add_features(enriched(t), profile)


def _unknown(df, *columns):
    """Missing store values shown as -1 so that the column stays whole numbers."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in columns})


_NULLABLE = (
    "competition_distance", "competition_open_since_month", "competition_open_since_year",
    "promo2_since_week", "promo2_since_year",
)


def _vector(t: Tables):
    rows = featured(t).withColumn("v", f.feature_vector())
    return rows.select(
        F.col("store_id").alias("store"), "ds",
        *[F.element_at("v", at + 1).alias(f"f_{name}") for at, name in enumerate(f.FEATURE_SLOTS)],
    )


_SLOT_SQL = {
    "is_weekend": "CAST(is_weekend AS INT)", "is_public_holiday": "CAST(is_public_holiday AS INT)",
    "promo2_active": "CAST(promo2_active AS INT)", "competition_distance": "coalesce(competition_distance, -1)",
}

QUERIES = [
    Query(
        "store_sales_enriched",
        "store_id:i ds:d sales:r customers:i open:i promo:i state_holiday school_holiday:i store_type assortment "
        "competition_distance:i competition_open_since_month:i competition_open_since_year:i promo2:i "
        "promo2_since_week:i promo2_since_year:i promo_interval",
        lambda t: _unknown(enriched(t), *_NULLABLE),
        with_(
            SALES, STORE, ENRICHED,
            select=f"SELECT * REPLACE ({', '.join(f'coalesce({c}, -1) AS {c}' for c in _NULLABLE)}) FROM enriched",
        ),
    ),
    Query(
        "calendar_features", "store_id:i ds:d year:i month:i day:i day_of_week:i is_weekend:b",
        lambda t: f.add_calendar(t.sales()),
        with_(SALES, STORE, ENRICHED, FEATURES, select="SELECT * FROM features"),
    ),
    Query(
        "holiday_flags", "store_id:i ds:d is_public_holiday:b is_easter_holiday:b is_christmas:b",
        lambda t: f.add_holidays(t.sales()),
        with_(SALES, STORE, ENRICHED, FEATURES, select="SELECT * FROM features"),
    ),
    Query(
        "competition_age", "store_id:i ds:d competition_open_months:i", lambda t: f.add_competition(enriched(t)),
        with_(SALES, STORE, ENRICHED, FEATURES, select="SELECT * FROM features"),
    ),
    Query(
        "promo_features", "store_id:i ds:d promo2_active_months:i promo2_active:b", lambda t: f.add_promo(enriched(t)),
        with_(SALES, STORE, ENRICHED, FEATURES, select="SELECT * FROM features"),
    ),
    Query(
        "promo_features_kaggle",
        "store_id:i ds:d day_of_week:i is_weekend:b is_public_holiday:b is_easter_holiday:b is_christmas:b "
        "promo2_active_months:i promo2_active:b",
        lambda t: featured(t, "kaggle"),
        with_(SALES, STORE, ENRICHED, KAGGLE, select="SELECT * FROM features"),
    ),
    Query(
        "feature_vector", "store:i ds:d " + " ".join(f"f_{name}:r" for name in f.FEATURE_SLOTS), _vector,
        with_(
            SALES, STORE, ENRICHED, FEATURES,
            select="SELECT store_id AS store, ds, " + ", ".join(
                f"{_SLOT_SQL.get(name, name)} AS f_{name}" for name in f.FEATURE_SLOTS
            ) + " FROM features",
        ),
    ),
    Query(
        "label", "store_id:i ds:d label:r", lambda t: t.sales().withColumn("label", f.label()),
        with_(SALES, select="SELECT store_id, ds, coalesce(sales, 0) AS label FROM sales"),
    ),
    Query(
        "demand_projection", "series_key ds:d y:r", lambda t: f.to_demand(t.sales()),
        with_(SALES, select="SELECT CAST(store_id AS VARCHAR) AS series_key, ds, sales AS y FROM sales"),
    ),
]
