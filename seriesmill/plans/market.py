"""Quote and sector documents rendered from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions import lookups
from seriesmill.plans.base import Query
from seriesmill.plans.tables import Tables
from seriesmill.sources import market


def _cents(c):
    """Two-decimal text that both engines spell alike."""
    whole = F.round(c * 100).cast("bigint")
    return F.format_string("%s%d.%02d", F.when(whole < 0, "-").otherwise(""), F.floor(F.abs(whole) / 100).cast("bigint"), F.abs(whole) % 100)


_CENTS = "CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(abs({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0')"


def quote_documents(t: Tables):
    """One document per event; every fifth has no change, every seventh no symbol, every ninth no quote."""
    e = F.col("event_id")
    fields = F.map_filter(
        F.create_map(
            F.lit("01. symbol"), F.when(e % 7 != 0, F.col("event_type")),
            F.lit("05. price"), _cents(F.col("value")),
            F.lit("09. change"), F.when(e % 5 != 0, _cents(F.col("value") - 50)),
        ),
        lambda _, v: v.isNotNull(),
    )
    quote = F.create_map(F.when(e % 9 == 0, "Note").otherwise("Global Quote"), fields)
    return t.table("events").select("event_id", F.to_json(quote).alias("body"))


QUOTES = f"""
WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c, CAST(round((value - 50) * 100) AS BIGINT) AS d FROM events WHERE event_id % 9 <> 0),
q AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE 'SPY' END AS symbol, {_CENTS.format(c='c')} AS price,
  CASE WHEN event_id % 5 <> 0 THEN {_CENTS.format(c='d')} ELSE '0' END AS change, '0%' AS change_percent, c / 100.0 AS price_value,
  CASE WHEN event_id % 5 = 0 OR d >= 0 THEN 'Positive' ELSE 'Negative' END AS impact FROM e)"""


def sector_documents(t: Tables):
    """One document per user: each event type a sector, plus a metadata entry."""
    totals = t.table("events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    entries = totals.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", _cents(F.col("v"))))).alias("m"))
    body = F.create_map(F.lit(market.SECTOR_ROOT), F.map_concat("m", F.create_map(F.lit("Meta Data"), F.lit("x"))))
    return entries.select("user_id", F.to_json(body).alias("body"))


def _impact(t: Tables):
    events = t.table("events")
    text = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(_cents(F.col("value") - 50))
    return events.groupBy("event_type", lookups.market_impact(text).alias("impact")).agg(F.count(F.lit(1)).alias("n"))


def _routing(t: Tables):
    names = [*lookups.METHOD_ALIASES, "anything else"]
    alias = F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 5).cast("int"))
    return t.table("events").select("event_id", alias.alias("alias"), lookups.method_for(alias).alias("method"))


QUERIES = [
    Query(
        "market_quotes", "event_id:i symbol price change change_percent price_value:r impact",
        lambda t: market.quotes(quote_documents(t)), f"{QUOTES} SELECT * FROM q",
    ),
    Query(
        "sector_performance", "user_id:i symbol price:r change", lambda t: market.sectors(sector_documents(t)),
        f"""WITH s AS (SELECT user_id, event_type, CAST(round(sum(value) * 100) AS BIGINT) AS c FROM events GROUP BY 1, 2)
            SELECT user_id, event_type AS symbol, 0 AS price, {_CENTS.format(c='c')} AS change FROM s""",
    ),
    Query(
        "market_impact", "event_type impact n:i", _impact,
        """SELECT event_type, CASE WHEN event_id % 6 = 0 OR round((value - 50) * 100) >= 0 THEN 'Positive' ELSE 'Negative' END AS impact,
           count(*) AS n FROM events GROUP BY 1, 2""",
    ),
    Query(
        "method_routing", "event_id:i alias method", _routing,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Standard (Best for most situations)' WHEN 1 THEN 'Advanced (For complex patterns)'
           WHEN 2 THEN 'Simple (For basic trends)' WHEN 3 THEN 'Seasonal (For products with seasonal demand)' ELSE 'anything else' END AS alias,
           CASE event_id % 5 WHEN 1 THEN 'Advanced' WHEN 3 THEN 'Advanced' ELSE 'Standard' END AS method FROM events""",
    ),
]
