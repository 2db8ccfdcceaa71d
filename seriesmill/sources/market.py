"""Quote and sector documents (JSON text in a column) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.lookups import market_impact

# Document keys and what a missing one stands for.
QUOTE_ROOT = "Global Quote"
QUOTE_FIELDS = {
    "symbol": ("01. symbol", "SPY"),
    "price": ("05. price", "N/A"),
    "change": ("09. change", "0"),
    "change_percent": ("10. change percent", "0%"),
}
SECTOR_ROOT = "Rank A: Real-Time Performance"
SECTOR_SKIP = "Meta Data"
DEFAULT_CHANGE = "0%"


def quotes(df: DataFrame, body: str = "body") -> DataFrame:
    """Documents with a quote, its fields with defaults, price also as decimal."""
    parsed = F.from_json(F.col(body), f"struct<`{QUOTE_ROOT}`: map<string, string>>")
    quote = parsed.getField(QUOTE_ROOT)
    fields = {
        name: F.coalesce(F.try_element_at(F.col("_quote"), F.lit(key)), F.lit(default))
        for name, (key, default) in QUOTE_FIELDS.items()
    }
    found = df.withColumn("_quote", quote).where(F.col("_quote").isNotNull())
    return found.withColumns(fields).withColumns({
        "price_value": F.col("price").try_cast("decimal(18,4)"),
        "impact": market_impact(F.col("change")),
    }).drop("_quote", body)


def sectors(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per sector and document: symbol, price 0, change text."""
    parsed = F.from_json(F.col(body), f"struct<`{SECTOR_ROOT}`: map<string, string>>")
    rows = df.select(
        *[c for c in df.columns if c != body], F.explode(parsed.getField(SECTOR_ROOT)).alias("symbol", "_change")
    )
    return rows.where(F.col("symbol") != SECTOR_SKIP).withColumns({
        "price": F.lit(0).cast("decimal(18,4)"),
        "change": F.coalesce("_change", F.lit(DEFAULT_CHANGE)),
    }).drop("_change")


def indicator(key: Column, price: Column, change_percent: Column, change: Column) -> Column:
    """Market indicator row: key, value, change and its sign in words."""
    return F.struct(
        key.alias("key"), price.alias("value"), change_percent.alias("change"), market_impact(change).alias("impact")
    )
