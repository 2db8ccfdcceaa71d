"""Parsing of text tables rendered from the given ones, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions import parsing as p
from seriesmill.functions.lookups import clamp, clamp_components
from seriesmill.operators.models import DecomposeModel
from seriesmill.plans.base import Query, with_
from seriesmill.plans.series import DECOMPOSE_FORECAST, DECOMPOSED
from seriesmill.plans.tables import BRAND, FILLED, SALES, STORE, SUPPLIER, Tables
from seriesmill.session import scratch_path
from seriesmill.sources import csv, registry


def raw_text(t: Tables):
    """Orders as text: four date layouts and junk, numbers with NA and blanks."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    return t.table("orders").select(
        key.alias("id"),
        F.when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format(day, "M/d/yyyy"))
        .when(key % 5 == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 5 == 3, F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.concat(F.lit("day "), key.cast("string"))).alias("Date"),
        F.when(key % 11 == 0, "NA").when(key % 13 == 0, " ").otherwise(cents).alias("Sales"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, " ").otherwise(F.substring("o_orderpriority", 1, 1)).alias("StateHoliday"),
    )


RAW = """
raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
    ELSE 'day ' || o_orderkey END AS d,
  CASE WHEN o_orderkey % 11 = 0 THEN 'NA' WHEN o_orderkey % 13 = 0 THEN ' '
    ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS s,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE substr(o_orderpriority, 1, 1) END AS h FROM orders),
typed AS (SELECT *, CAST(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y'),
    try_strptime(d, '%Y/%m/%d')) AS DATE) AS ds, TRY_CAST(trim(s) AS DOUBLE) AS sales FROM raw)"""

_STORE_COLUMNS = {
    "Store": "store_id", "StoreType": "store_type", "Assortment": "assortment",
    "CompetitionDistance": "competition_distance", "CompetitionOpenSinceMonth": "competition_open_since_month",
    "CompetitionOpenSinceYear": "competition_open_since_year", "Promo2": "promo2",
    "Promo2SinceWeek": "promo2_since_week", "Promo2SinceYear": "promo2_since_year", "PromoInterval": "promo_interval",
}
_SALES_COLUMNS = {
    "Store": "store_id", "Date": "ds", "Sales": "sales", "Customers": "customers", "Open": "open", "Promo": "promo",
    "StateHoliday": "state_holiday", "SchoolHoliday": "school_holiday",
}


def store_text(t: Tables):
    """The store table as text with blanks for what is unknown."""
    text = t.store().withColumn(
        "promo_interval", F.when(F.col("promo_interval") == "None", "").otherwise(F.col("promo_interval"))
    )
    return text.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in _STORE_COLUMNS.items()
    ])


def sales_text(t: Tables):
    return t.sales().select(*[F.col(c).cast("string").alias(name) for name, c in _SALES_COLUMNS.items()])


def _split(t: Tables):
    """Comma lines of three or four fields: the rows of those with four and a date, and all others with the reason."""
    raw = raw_text(t)
    line = F.concat_ws(",", F.col("id").cast("string"), "Date", "Sales", F.when(F.col("id") % 6 != 0, F.col("StateHoliday")))
    rows, short = csv.split_lines(raw.select(line.alias("value")), ["id", "d", "s", "h"], 4)
    typed = rows.withColumn("ds", p.parse_date(F.col("d")))
    none = {"id": F.lit(-1), "ds": F.lit("1970-01-01").cast("date"), "sales": F.lit(-1.0)}
    bad = short.unionByName(typed.where("ds IS NULL").select("line", F.lit("bad_date").alias("reason"))).withColumns(none)
    return typed.where("ds IS NOT NULL").select(
        F.lit("").alias("line"), F.lit("").alias("reason"), p.parse_int(F.col("id")).alias("id"), "ds",
        F.coalesce(p.parse_double(F.col("s")), F.lit(-1.0)).alias("sales"),
    ).unionByName(bad)


def _split_sales(t: Tables):
    names = [_SALES_COLUMNS.get(c, "ds") for c in csv.SPLIT_LAYOUTS["sales"]]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in names])
    return csv.parse_split_table(t.sales().select(line.alias("value")), "sales")[0]


def _broken_sales(t: Tables):
    """Sales text in which some stores, dates and flags are blank or junk."""
    day = F.dayofmonth("Date")
    return sales_text(t).withColumns({
        "Store": F.when(day == 3, " ").when(day == 4, "s").otherwise(F.col("Store")),
        "Date": F.when(day == 5, "").otherwise(F.col("Date")),
        "Open": F.when(day == 6, "").otherwise(F.col("Open")),
        "Customers": F.when(day == 7, "NA").otherwise(F.col("Customers")),
    })


_BROKEN_SALES = """
text AS (SELECT *, CASE day(ds) WHEN 3 THEN ' ' WHEN 4 THEN 's' ELSE CAST(store_id AS VARCHAR) END AS raw_store,
  CASE WHEN day(ds) = 5 THEN '' ELSE strftime(ds, '%Y-%m-%d') END AS raw_date FROM sales)"""


def _broken_store(t: Tables):
    text = store_text(t)
    return text.withColumn("Store", F.when(F.col("Store").cast("int") % 9 == 0, "?").otherwise(F.col("Store")))


def _mixed_layouts(t: Tables):
    """The same columns in two orders, in files of one folder."""
    path = scratch_path(t.spark, "mixed-csv")
    table = t.supplier().select(F.col("ds").alias("Date"), F.col("y").alias("Sales"), F.col("series_key").alias("Store"))
    even = F.col("Store").cast("int") % 2 == 0
    csv.export_csv(table.where(even), f"{path}/even")
    csv.export_csv(table.where(~even).select("Store", "Sales", "Date"), f"{path}/odd")
    good, bad = csv.parse_demand(csv.read_mixed_tables(t.spark, [f"{path}/even", f"{path}/odd"]))
    return good.select("ds", "sales", F.lit("").alias("reason")).unionByName(
        bad.select(F.lit(None).cast("date").alias("ds"), F.lit(None).cast("double").alias("sales"), "reason"))


def _overwritten(t: Tables):
    """One version saved twice with different windows; the second stays."""
    path = scratch_path(t.spark, "models")
    for window in (5, 7):
        model = DecomposeModel(window)
        registry.save_model(model.fit(t.brand_filled()), path, model.name, "1.0", parameters=model.parameters())
    rows = registry.load_model(t.spark, path, "decompose", "1.0")
    return rows.groupBy("series_key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("parameters")["window"]).alias("window_size"))


def _archived(t: Tables):
    path = scratch_path(t.spark, "archive")
    good, _ = csv.parse_demand(raw_text(t))
    for stamp in ("2024-01-01T000000", "2024-01-02T000000"):
        csv.archive_import(good, path, stamp)
    return t.spark.read.parquet(path).select("imported_at", "ds", "sales")


def _csv_round_trip(t: Tables):
    """Each row read back, with the number of rows and the total of its day."""
    path = scratch_path(t.spark, "demand-csv")
    table = t.supplier().select(F.col("series_key").alias("Store"), F.col("ds").alias("DATE"), F.col("y").alias("sales"))
    csv.export_csv(table, path)
    good, _ = csv.parse_demand(csv.read_text_table(t.spark, path))
    days = good.groupBy("ds").agg(F.count(F.lit(1)).alias("rows"), F.sum("sales").alias("day_sales"))
    return good.join(days, "ds").select("ds", "sales", "rows", "day_sales")


def _registry_round_trip(t: Tables):
    path = scratch_path(t.spark, "models")
    model = DecomposeModel()
    params = model.fit(t.brand_filled())
    registry.save_model(params, path, model.name, "1.0", parameters={"window": "7"})
    return model.predict(registry.load_model(t.spark, path, model.name, "1.0"), 14)


def _versions(t: Tables):
    path = scratch_path(t.spark, "models")
    model = DecomposeModel()
    params = model.fit(t.brand_filled())
    for version in ("1.0", "1.1"):
        registry.save_model(params, path, model.name, version)
    versions = registry.model_versions(t.spark, path, model.name)
    rows = registry.load_model(t.spark, path, model.name, "1.1").groupBy("version").count()
    return versions.join(rows, "version", "left").select("version", F.coalesce("count", F.lit(0)).alias("keys"))


QUERIES = [
    Query(
        "date_parse_formats", "id:i ds", lambda t: raw_text(t).select(
            "id", F.coalesce(p.parse_date(F.col("Date")).cast("string"), F.lit("none")).alias("ds")
        ),
        with_(RAW, select="SELECT id, coalesce(strftime(ds, '%Y-%m-%d'), 'none') AS ds FROM typed"),
    ),
    Query(
        "accept_rows", "ds:d sales:r state_holiday", lambda t: csv.parse_demand(raw_text(t))[0],
        with_(
            RAW,
            select="""SELECT ds, sales, coalesce(nullif(trim(h), ''), '0') AS state_holiday FROM typed
                      WHERE ds IS NOT NULL AND sales IS NOT NULL""",
        ),
    ),
    Query(
        "reject_rows", "raw_date raw_sales reason", lambda t: csv.parse_demand(raw_text(t))[1],
        with_(
            RAW,
            select="""SELECT d AS raw_date, s AS raw_sales, CASE WHEN ds IS NULL THEN 'bad_date' ELSE 'bad_number' END AS reason
                      FROM typed WHERE ds IS NULL OR sales IS NULL""",
        ),
    ),
    Query(
        "na_numeric_parse", "id:i known:b value:r", lambda t: raw_text(t).select(
            "id", p.parse_double(F.col("Sales")).isNotNull().alias("known"),
            F.coalesce(p.parse_double(F.col("Sales")), F.lit(-1.0)).alias("value"),
        ),
        with_(
            RAW,
            select="""SELECT id, TRY_CAST(nullif(nullif(trim(s), ''), 'NA') AS DOUBLE) IS NOT NULL AS known,
                      coalesce(TRY_CAST(nullif(nullif(trim(s), ''), 'NA') AS DOUBLE), -1) AS value FROM raw""",
        ),
    ),
    Query(
        "blank_defaults", "id:i holiday category interval_text", lambda t: raw_text(t).select(
            "id", p.blank_to_default(F.col("StateHoliday"), p.BLANK_HOLIDAY).alias("holiday"),
            p.blank_to_default(F.col("StateHoliday"), p.BLANK_CATEGORY).alias("category"),
            p.blank_to_default(F.col("StateHoliday"), p.BLANK_INTERVAL).alias("interval_text"),
        ),
        with_(
            RAW,
            select="""SELECT id, coalesce(nullif(trim(h), ''), '0') AS holiday, coalesce(nullif(trim(h), ''), 'Unknown') AS category,
                      coalesce(nullif(trim(h), ''), 'None') AS interval_text FROM raw""",
        ),
    ),
    Query(
        "split_scan", "id:i ds:d sales:r line reason", _split,
        with_(
            RAW,
            select="""SELECT id, ds, coalesce(sales, -1) AS sales, '' AS line, '' AS reason FROM typed WHERE id % 6 <> 0 AND ds IS NOT NULL
                      UNION ALL SELECT -1, DATE '1970-01-01', -1, id || ',' || d || ',' || s || CASE WHEN id % 6 <> 0 THEN ',' || h ELSE '' END,
                        CASE WHEN id % 6 = 0 THEN 'few_fields' ELSE 'bad_date' END FROM typed WHERE id % 6 = 0 OR ds IS NULL""",
        ),
    ),
    Query(
        "store_scan", "store_id:i store_type assortment competition_distance:i promo2:i promo2_since_week:i promo_interval",
        lambda t: csv.parse_store(store_text(t))[0].withColumns({
            c: F.coalesce(F.col(c), F.lit(-1)) for c in ("competition_distance", "promo2_since_week")
        }),
        with_(
            STORE,
            select="""SELECT * REPLACE (coalesce(competition_distance, -1) AS competition_distance,
                      coalesce(promo2_since_week, -1) AS promo2_since_week) FROM store""",
        ),
    ),
    Query(
        "sales_scan", "store_id:i ds:d sales:r customers:i open:i promo:i state_holiday school_holiday:i",
        lambda t: csv.parse_sales(sales_text(t))[0], with_(SALES, select="SELECT * FROM sales"),
    ),
    Query(
        "scoring_scan", "store_id:i ds:d sales:r customers:i open:i promo:i state_holiday school_holiday:i",
        lambda t: csv.parse_sales(sales_text(t).drop("Sales", "Customers"), scoring=True)[0],
        with_(SALES, select="SELECT * REPLACE (0 AS sales, 0 AS customers) FROM sales"),
    ),
    Query(
        "split_sales_scan", "store_id:i ds:d sales:r customers:i open:i promo:i state_holiday school_holiday:i",
        _split_sales, with_(SALES, select="SELECT * FROM sales"),
    ),
    Query(
        "import_archive", "imported_at ds:d sales:r", _archived,
        with_(
            RAW,
            select="""SELECT imported_at, ds, sales FROM typed
                      CROSS JOIN (VALUES ('2024-01-01T000000'), ('2024-01-02T000000')) v(imported_at)
                      WHERE ds IS NOT NULL AND sales IS NOT NULL""",
        ),
    ),
    Query(
        "file_routing", "url is_store_file:b",
        lambda t: t.table("pages").select("url", csv.is_store_file(F.col("url")).alias("is_store_file")),
        r"""SELECT url, contains(b, 'rossmann') OR contains(b, 'store') OR contains(b, 'train') AS is_store_file
            FROM (SELECT url, lower(list_last(string_split_regex(url, '[/\\]'))) AS b FROM pages)""",
    ),
    Query(
        "parameter_clamps", "partkey:i window_size:i components:i lookback:i epochs:i folds:i learner_window:i",
        lambda t: t.table("part").select(
            F.col("p_partkey").alias("partkey"), clamp(F.col("p_size"), "window").alias("window_size"),
            clamp_components(F.col("p_size") - 5, clamp(F.col("p_size"), "window")).alias("components"),
            clamp(F.col("p_size"), "lookback").alias("lookback"), clamp(F.col("p_size") * 12, "epochs").alias("epochs"),
            clamp(F.col("p_size") - 10, "folds").alias("folds"), clamp(F.col("p_size") * 2, "learner_window").alias("learner_window"),
        ),
        """SELECT p_partkey AS partkey, greatest(2, least(30, p_size)) AS window_size,
           greatest(1, least(greatest(2, least(30, p_size)), p_size - 5)) AS components, greatest(7, least(30, p_size)) AS lookback,
           greatest(10, least(500, p_size * 12)) AS epochs, greatest(2, least(10, p_size - 10)) AS folds,
           greatest(7, least(90, p_size * 2)) AS learner_window FROM part""",
    ),
    Query(
        "sales_rejects", "raw_store raw_date reason", lambda t: csv.parse_sales(_broken_sales(t))[1],
        with_(
            SALES, _BROKEN_SALES,
            select="""SELECT raw_store, raw_date, CASE WHEN day(ds) IN (3, 4) THEN 'bad_store' ELSE 'bad_date' END AS reason
                      FROM text WHERE day(ds) BETWEEN 3 AND 5""",
        ),
    ),
    Query(
        "sales_accepted", "store_id:i ds:d sales:r customers:i open:i", lambda t: csv.parse_sales(_broken_sales(t))[0].withColumn(
            "customers", F.coalesce("customers", F.lit(-1))),
        with_(
            SALES, select="""SELECT store_id, ds, sales, CASE WHEN day(ds) = 7 THEN -1 ELSE customers END AS customers,
                             CASE WHEN day(ds) = 6 THEN 0 ELSE open END AS open FROM sales WHERE day(ds) NOT BETWEEN 3 AND 5""",
        ),
    ),
    Query(
        "scoring_rejects", "raw_store raw_date reason",
        lambda t: csv.parse_sales(_broken_sales(t).drop("Sales", "Customers"), scoring=True)[1],
        with_(
            SALES, _BROKEN_SALES,
            select="""SELECT raw_store, raw_date, CASE WHEN day(ds) IN (3, 4) THEN 'bad_store' ELSE 'bad_date' END AS reason
                      FROM text WHERE day(ds) BETWEEN 3 AND 5""",
        ),
    ),
    Query(
        "store_rejects", "raw_store reason", lambda t: csv.parse_store(_broken_store(t))[1],
        with_(STORE, select="SELECT '?' AS raw_store, 'bad_store' AS reason FROM store WHERE store_id % 9 = 0"),
    ),
    Query(
        "mixed_layout_scan", "ds:d sales:r reason", _mixed_layouts,
        with_(SUPPLIER, select="SELECT ds, y AS sales, '' AS reason FROM series"),
    ),
    Query(
        "registry_overwrite", "series_key rows:i window_size:i", _overwritten,
        with_(BRAND, select='SELECT DISTINCT series_key, 1 AS "rows", 7 AS window_size FROM series'),
    ),
    Query(
        "csv_round_trip", "ds:d sales:r rows:i day_sales:r", _csv_round_trip,
        with_(
            SUPPLIER, 'days AS (SELECT ds, count(*) AS "rows", sum(y) AS day_sales FROM series GROUP BY 1)',
            select='SELECT ds, y AS sales, "rows", day_sales FROM series JOIN days USING (ds)',
        ),
    ),
    Query(
        "registry_round_trip", "series_key model step:i ds:d yhat:r lo:r hi:r", _registry_round_trip,
        with_(BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, select="SELECT * FROM forecast"),
    ),
    Query(
        "model_versions", "version keys:i", _versions,
        """SELECT v.version, CASE WHEN v.version = '1.1' THEN (SELECT count(DISTINCT p_brand)
           FROM lineitem JOIN part ON l_partkey = p_partkey) ELSE 0 END AS keys
           FROM (VALUES ('1.0'), ('1.1')) v(version)""",
    ),
]
