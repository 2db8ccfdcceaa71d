"""Stock planning from forecasts and demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions import lookups
from seriesmill.operators import inventory as inv
from seriesmill.operators.models import DecomposeModel
from seriesmill.plans.base import Query, with_
from seriesmill.plans.series import DECOMPOSE_FORECAST, DECOMPOSED
from seriesmill.plans.tables import BRAND, FILLED, STOCK, Tables

DEMAND = """
demand AS (SELECT series_key, avg(y) AS mean_demand, 1.65 * coalesce(stddev_samp(y), 0) * sqrt(3) AS safety_stock
  FROM filled GROUP BY 1),
reorder AS (SELECT *, mean_demand * 3 + safety_stock AS reorder_point FROM demand)"""

SUMMARY = """
outlook AS (SELECT series_key, avg(yhat) AS mean_demand, avg(hi - yhat) AS mean_margin FROM forecast GROUP BY 1)"""


def recommend_sql(source: str) -> str:
    """From ``source(item, current_stock, mean_demand, mean_margin)``."""
    return f"""
SELECT *, CASE WHEN current_stock <= reorder_point THEN ceil(round(reorder_point + lead_time_demand - current_stock, 6)) ELSE 0 END AS recommended_order,
  CASE WHEN current_stock <= safety_stock THEN 'Critical' WHEN current_stock <= reorder_point THEN 'Low' ELSE 'Adequate' END AS stock_status,
  CASE WHEN lead_time_demand <= 0 THEN 0 ELSE ceil(round(current_stock / (lead_time_demand / 3), 6)) END AS days_of_supply
FROM (SELECT *, mean_demand * 3 AS lead_time_demand, mean_margin * sqrt(3) AS safety_stock,
  mean_demand * 3 + mean_margin * sqrt(3) AS reorder_point FROM {source})"""


_COLUMNS = (
    "item current_stock:i lead_time_demand:r safety_stock:r reorder_point:r recommended_order:i stock_status days_of_supply:i"
)


def _forecast(t: Tables):
    model = DecomposeModel()
    return model.predict(model.fit(t.brand_filled()), 14)


def recommendations(t: Tables):
    return inv.recommendations(_forecast(t), t.stock())


def _defaulted(t: Tables):
    """Stock of large parts by brand, over all parts; a brand without any has an unknown stock and gets the default."""
    held = t.table("part").groupBy(F.col("p_brand").alias("item")).agg(F.sum(F.when(F.col("p_size") > 48, F.col("p_size"))).alias("stock"))
    return inv.recommendations(_forecast(t), held)


def _shared(t: Tables):
    items = t.table("part").select(
        F.col("p_partkey").alias("item"), F.col("p_brand").alias("series_key"), F.col("p_size").alias("stock")
    )
    return inv.shared_recommendations(_forecast(t), items)


def _part_levels(t: Tables):
    """Every part with the reorder level and safety stock of its brand."""
    reorder = inv.reorder_point(t.brand_filled())
    part = t.table("part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("series_key"), F.col("p_size").alias("stock"))
    return part.join(reorder, "series_key")


PART_LEVELS = """
levels AS (SELECT p_partkey AS item, p_size AS stock, r.* FROM part JOIN reorder r ON p_brand = series_key)"""


def _eoq(t: Tables):
    demand = t.table("lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("total"), F.countDistinct(F.year("l_shipdate")).alias("years")
    )
    part = t.table("part").select("p_partkey", (F.col("p_retailprice") * 0.2).alias("holding"))
    return demand.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("item"),
        inv.eoq(F.col("total") / F.col("years"), F.lit(50.0), F.col("holding")).alias("eoq"),
    )


def _bands(t: Tables):
    return t.table("part").select(
        F.col("p_partkey").alias("item"),
        lookups.stock_band(F.col("p_size")).alias("band"),
        lookups.band_for_argument(F.col("p_size"), F.concat(F.lit("Text: "), (F.col("p_partkey") % 40).cast("string"))).alias("argument_band"),
    )


def _lookups(t: Tables):
    level = F.round(F.col("l_discount") + 0.9, 2)
    return (
        t.table("lineitem").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("lines"))
        .withColumns({
            "z": lookups.confidence_z(F.col("level")), "factor": lookups.safety_factor(F.col("level")),
            "low_z": lookups.confidence_z(F.round(F.col("level") - 0.15, 2)),
        })
    )


_Z = "CASE WHEN {x} >= 0.99 THEN 2.58 WHEN {x} >= 0.98 THEN 2.33 WHEN {x} >= 0.95 THEN 1.96 WHEN {x} >= 0.90 THEN 1.65 " \
     "WHEN {x} >= 0.85 THEN 1.44 WHEN {x} >= 0.80 THEN 1.28 ELSE 1.96 END"

QUERIES = [
    Query(
        "safety_stock", "series_key mean_demand:r safety_stock:r", lambda t: inv.safety_stock(t.brand_filled()),
        with_(BRAND, FILLED, DEMAND, select="SELECT * FROM demand"),
    ),
    Query(
        "reorder_point", "series_key mean_demand:r safety_stock:r reorder_point:r", lambda t: inv.reorder_point(t.brand_filled()),
        with_(BRAND, FILLED, DEMAND, select="SELECT * FROM reorder"),
    ),
    Query(
        "forecast_summary", "series_key mean_demand:r mean_margin:r", lambda t: inv.forecast_summary(_forecast(t)),
        with_(BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, SUMMARY, select="SELECT * FROM outlook"),
    ),
    Query(
        "eoq", "item:i eoq:r", _eoq,
        """SELECT p_partkey AS item, sqrt(2 * (total / years) * 50.0 / (p_retailprice * 0.2)) AS eoq FROM part
           JOIN (SELECT l_partkey, sum(l_quantity) AS total, count(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY 1) d
           ON l_partkey = p_partkey""",
    ),
    Query(
        "recommendations", _COLUMNS, recommendations,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, SUMMARY, STOCK,
            select=recommend_sql(
                "(SELECT series_key AS item, coalesce(stock, 20) AS current_stock, o.* FROM outlook o LEFT JOIN stock ON item = series_key)"
            ),
        ),
    ),
    Query(
        "recommendations_default_stock", _COLUMNS, _defaulted,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, SUMMARY,
            """stock AS (SELECT p_brand AS item, sum(p_size) FILTER (p_size > 48) AS stock FROM part GROUP BY 1)""",
            select=recommend_sql(
                "(SELECT series_key AS item, coalesce(stock, 20) AS current_stock, o.* FROM outlook o LEFT JOIN stock ON item = series_key)"
            ),
        ),
    ),
    Query(
        "shared_recommendations", _COLUMNS.replace("item", "item:i"), _shared,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, SUMMARY,
            select=recommend_sql("(SELECT p_partkey AS item, p_size AS current_stock, o.* FROM part JOIN outlook o ON p_brand = series_key)"),
        ),
    ),
    Query(
        "stock_status", "item:i status",
        lambda t: _part_levels(t).withColumn(
            "status", lookups.stock_status(F.col("stock"), F.col("safety_stock") / 20, F.col("reorder_point") / 10)
        ),
        with_(
            BRAND, FILLED, DEMAND, PART_LEVELS,
            select="""SELECT item, CASE WHEN stock <= safety_stock / 20 THEN 'Critical' WHEN stock <= reorder_point / 10 THEN 'Low'
                      ELSE 'Adequate' END AS status FROM levels""",
        ),
    ),
    Query(
        "stock_band", "item:i band argument_band", _bands,
        """SELECT p_partkey AS item, CASE WHEN p_size < 10 THEN 'CRITICAL' WHEN p_size < 20 THEN 'WARNING' WHEN p_size <= 40 THEN 'GOOD'
           ELSE 'EXCESS' END AS band, CASE WHEN p_size < (p_partkey % 40) * 0.5 THEN 'CRITICAL' WHEN p_size < p_partkey % 40 THEN 'WARNING'
           WHEN p_size <= (p_partkey % 40) * 2 THEN 'GOOD' ELSE 'EXCESS' END AS argument_band FROM part""",
    ),
    Query(
        "days_of_supply", "item:i days:i days_week_lead:i",
        lambda t: _part_levels(t).withColumns({
            "days": lookups.days_of_supply(F.col("stock"), F.col("mean_demand") * 3),
            "days_week_lead": lookups.days_of_supply(F.col("stock"), F.col("mean_demand") * 3, F.lit(7)),
        }),
        with_(
            BRAND, FILLED, DEMAND, PART_LEVELS,
            select="""SELECT item, ceil(round(stock / (mean_demand * 3 / 3), 6)) AS days, ceil(round(stock / (mean_demand * 3 / 7), 6)) AS days_week_lead
                      FROM levels""",
        ),
    ),
    Query(
        "z_lookup", "level:r lines:i z:r factor:r low_z:r", _lookups,
        f"""WITH l AS (SELECT round(l_discount + 0.9, 2) AS level, count(*) AS lines FROM lineitem GROUP BY 1)
            SELECT level, lines, {_Z.format(x='level')} AS z, CASE WHEN level >= 0.99 THEN 2.33 WHEN level >= 0.95 THEN 1.65
            WHEN level >= 0.90 THEN 1.28 ELSE 1.65 END AS factor, {_Z.format(x='round(level - 0.15, 2)')} AS low_z FROM l""",
    ),
]
