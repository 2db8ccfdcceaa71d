"""The given tables and what the queries derive from them, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.operators.series import deal_by_key, fill_gaps, in_order, to_series
from seriesmill.streaming.daily import daily_totals_batch


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- series ----------------------------------------------------------------
    def with_part(self) -> DataFrame:
        lines, part = self.table("lineitem"), self.table("part")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))

    def brand(self) -> DataFrame:
        return to_series(self.with_part(), "p_brand", "l_shipdate", "l_quantity")

    def types(self) -> DataFrame:
        return to_series(self.with_part(), "p_type", "l_shipdate", "l_quantity")

    @cached_property
    def lines(self) -> int:
        """The number of lines, from the files' footers."""
        return self.table("lineitem").count()

    def supplier(self) -> DataFrame:
        """There are nearly as many suppliers' days as lines."""
        return to_series(self.table("lineitem"), "l_suppkey", "l_shipdate", "l_quantity", rows=self.lines)

    def by_key(self, series: DataFrame) -> DataFrame:
        """A series of lines, of which there are many keys, dealt by key for windows and models."""
        return deal_by_key(series, self.lines)

    def supplier_by_key(self) -> DataFrame:
        return self.by_key(self.supplier())

    def brand_filled(self) -> DataFrame:
        return fill_gaps(self.brand())

    def supplier_filled(self) -> DataFrame:
        return fill_gaps(self.supplier_by_key())

    def signed(self) -> DataFrame:
        """Daily quantity per brand with heavily taxed returns counted negative."""
        back = (F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.07)
        return to_series(
            self.with_part(), "p_brand", "l_shipdate",
            F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")),
        )

    def supplier_years(self) -> DataFrame:
        """Daily quantity per supplier and year, few lines counted negative: some keys are short, some have bad values."""
        back = (F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08) & (F.col("l_linenumber") == 7)
        key = F.concat_ws("-", F.col("l_suppkey").cast("string"), F.year("l_shipdate").cast("string"))
        return self.by_key(to_series(
            self.table("lineitem"), key, "l_shipdate", F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")), rows=self.lines))

    def holey(self) -> DataFrame:
        """Daily quantity per brand where the lines of some days, and one brand's all, have no value."""
        unknown = (F.col("l_linenumber") == 7) | (F.col("p_brand") == "Brand#11")
        value = F.when(F.col("l_quantity") == 13, F.lit(float("nan"))).when(~unknown, F.col("l_quantity"))
        return to_series(self.with_part(), "p_brand", "l_shipdate", value)

    # -- store tables ----------------------------------------------------------
    def sales(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        ds = F.col("ds")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_shipdate").cast("date").alias("ds"))
            .agg(
                F.sum("l_quantity").alias("sales"),
                F.countDistinct("o_custkey").alias("customers"),
                F.max((F.col("l_discount") >= 0.05).cast("int")).alias("promo"),
            )
            .withColumns({
                "open": F.lit(1),
                "state_holiday": F.when((F.month(ds) == 1) & (F.dayofmonth(ds) == 1), "a")
                .when((F.month(ds) == 12) & (F.dayofmonth(ds) == 25), "b").otherwise("0"),
                "school_holiday": F.month(ds).isin(7, 8).cast("int"),
            })
        )

    def store(self) -> DataFrame:
        key = F.col("s_suppkey")
        letter = lambda c: F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (c % 3 + 1).cast("int"))
        known, joined = key % 7 != 0, key % 2 == 1
        return self.table("supplier").select(
            key.alias("store_id"),
            letter(key).alias("store_type"),
            letter(F.col("s_nationkey")).alias("assortment"),
            F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal").cast("int")).alias("competition_distance"),
            F.when(known, (1 + key % 12).cast("int")).alias("competition_open_since_month"),
            F.when(known, (1990 + key % 10).cast("int")).alias("competition_open_since_year"),
            (key % 2).cast("int").alias("promo2"),
            F.when(joined, (1 + key % 52).cast("int")).alias("promo2_since_week"),
            F.when(joined, (1993 + key % 8).cast("int")).alias("promo2_since_year"),
            F.when(~joined, "None").when(key % 4 == 1, "Jan,Apr,Jul,Oct").otherwise("Feb,May,Aug,Nov").alias("promo_interval"),
        )

    def stock(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_brand").alias("item")).agg(F.sum("p_size").alias("stock"))

    # -- events ----------------------------------------------------------------
    def user_daily(self) -> DataFrame:
        daily = daily_totals_batch(self.table("events"), "user_id")
        return daily.withColumn("y", F.round("y", 2))

    def persistence(self) -> DataFrame:
        """Each user's day predicted by the day before it."""
        w = in_order()
        rows = self.user_daily().select(
            "series_key", "ds", F.col("y").alias("actual"),
            F.lag("y").over(w).alias("predicted"), F.lag("ds").over(w).alias("_before"),
        )
        return rows.where(F.datediff("ds", "_before") == 1).drop("_before")


# -- the same in SQL -------------------------------------------------------------
def _series(key: str, value: str = "l_quantity", source: str = "lineitem JOIN part ON l_partkey = p_partkey") -> str:
    return (
        f"series AS (SELECT CAST({key} AS VARCHAR) AS series_key, CAST(l_shipdate AS DATE) AS ds, "
        f"SUM({value}) AS y FROM {source} GROUP BY 1, 2)"
    )


BRAND = _series("p_brand")
TYPES = _series("p_type")
SUPPLIER = _series("l_suppkey", source="lineitem")
SIGNED = _series("p_brand", "CASE WHEN l_returnflag = 'R' AND l_tax >= 0.07 THEN -l_quantity ELSE l_quantity END")
SUPPLIER_YEARS = _series(
    "l_suppkey || '-' || year(l_shipdate)",
    "CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 AND l_linenumber = 7 THEN -l_quantity ELSE l_quantity END",
    source="lineitem",
)
HOLEY = _series("p_brand", "CASE WHEN l_linenumber <> 7 AND p_brand <> 'Brand#11' AND l_quantity <> 13 THEN l_quantity END")

FILLED = """
bounds AS (SELECT series_key, min(ds) AS a, max(ds) AS b FROM series GROUP BY 1),
spine AS (SELECT series_key, a, b, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM bounds),
filled AS (SELECT spine.series_key, spine.ds, coalesce(series.y, 0) AS y,
  date_diff('day', spine.a, spine.ds) AS i, date_diff('day', spine.a, spine.b) + 1 AS n
  FROM spine LEFT JOIN series ON spine.series_key = series.series_key AND spine.ds = series.ds)"""

PLACED = """
placed AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS i,
  count(*) OVER (PARTITION BY series_key) AS n FROM series)"""

SALES = """
sales AS (SELECT l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS ds, SUM(l_quantity) AS sales,
  COUNT(DISTINCT o_custkey) AS customers, MAX(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS promo, 1 AS open,
  CASE WHEN strftime(CAST(l_shipdate AS DATE), '%m-%d') = '01-01' THEN 'a'
       WHEN strftime(CAST(l_shipdate AS DATE), '%m-%d') = '12-25' THEN 'b' ELSE '0' END AS state_holiday,
  CASE WHEN month(l_shipdate) IN (7, 8) THEN 1 ELSE 0 END AS school_holiday
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, CAST(l_shipdate AS DATE), 6, 7, 8)"""

STORE = """
store AS (SELECT s_suppkey AS store_id, substr('abc', CAST(s_suppkey % 3 + 1 AS INT), 1) AS store_type,
  substr('abc', CAST(s_nationkey % 3 + 1 AS INT), 1) AS assortment,
  CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal) AS INT) END AS competition_distance,
  CASE WHEN s_suppkey % 7 <> 0 THEN 1 + s_suppkey % 12 END AS competition_open_since_month,
  CASE WHEN s_suppkey % 7 <> 0 THEN 1990 + s_suppkey % 10 END AS competition_open_since_year,
  s_suppkey % 2 AS promo2,
  CASE WHEN s_suppkey % 2 = 1 THEN 1 + s_suppkey % 52 END AS promo2_since_week,
  CASE WHEN s_suppkey % 2 = 1 THEN 1993 + s_suppkey % 8 END AS promo2_since_year,
  CASE WHEN s_suppkey % 2 = 0 THEN 'None' WHEN s_suppkey % 4 = 1 THEN 'Jan,Apr,Jul,Oct' ELSE 'Feb,May,Aug,Nov' END AS promo_interval
  FROM supplier)"""

STOCK = "stock AS (SELECT p_brand AS item, SUM(p_size) AS stock FROM part GROUP BY 1)"

USER_DAILY = (
    "series AS (SELECT CAST(user_id AS VARCHAR) AS series_key, CAST(ts AS DATE) AS ds, round(SUM(value), 2) AS y "
    "FROM events GROUP BY 1, 2)"
)
PERSISTENCE = """
predictions AS (SELECT a.series_key, a.ds, b.y AS predicted, a.y AS actual
  FROM series a JOIN series b ON a.series_key = b.series_key AND a.ds = b.ds + 1),
errors AS (SELECT *, abs((predicted - actual) / actual) AS error FROM predictions WHERE actual <> 0)"""
