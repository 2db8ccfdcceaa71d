import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions import calendar as cal
from seriesmill.functions import lookups, metrics, parsing
from seriesmill.operators import features, inventory, quality, recover, series
from seriesmill.schema import SALES, STORE

NAN = float("nan")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(df, column, key="series_key"):
    return {r[key]: r[column] for r in df.collect()}


# -- series ----------------------------------------------------------------------
def test_fill_gaps_positions(make):
    rows = series.fill_gaps(make({"k": [1, None, None, 4, 5], "j": [7]})).orderBy("series_key", "i").collect()
    assert [(r.series_key, r.i, r.n, r.y) for r in rows] == [
        ("j", 0, 1, 7.0), ("k", 0, 5, 1.0), ("k", 1, 5, 0.0), ("k", 2, 5, 0.0), ("k", 3, 5, 4.0), ("k", 4, 5, 5.0),
    ]


def test_hot_key_arrives_as_one_row_per_day(spark):
    """A key with almost all raw rows is combined before the shuffle by key."""
    raw = spark.range(20000).selectExpr(
        "if(id % 50 = 0, concat('k', id % 7), 'hot') AS key", "date_add(date'2024-01-01', cast(id % 10 AS int)) AS day", "1.0D AS v"
    )
    daily = series.to_series(raw, "key", "day", "v")
    assert daily.where("series_key = 'hot'").count() == 10
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.index("partial_sum") > plan.index("Exchange")


def test_recent_n_limits_before_the_shuffle(make):
    top = series.recent_n(make({"k": range(50)}), 3)
    assert sorted(r.y for r in top.collect()) == [47.0, 48.0, 49.0]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_pad_with_history(make):
    history, recent = make({"k": range(10)}), make({"k": [None] * 10 + [50, 51]})
    padded = series.pad_with_history(recent, history, 5)
    assert sorted(r.y for r in padded.collect()) == [7.0, 8.0, 9.0, 50.0, 51.0]


def test_split_and_short_series(make):
    data = make({"k": range(11), "j": [1, 2]})
    parts = series.train_test_split(data).groupBy("series_key", "part").count().collect()
    assert {(r[0], r[1]): r[2] for r in parts} == {
        ("k", "train"): 8, ("k", "recent"): 3, ("j", "train"): 1, ("j", "recent"): 1,
    }
    long_enough, short = series.split_by_length(data, 5)
    assert values(short, "n") == {"j": 2} and long_enough.select("series_key").distinct().count() == 1


def test_date_range_takes_whole_days(make, spark):
    cut = series.between_dates(make({"k": range(10)}), "2024-01-02", "2024-01-03")
    assert sorted(r.y for r in cut.collect()) == [1.0, 2.0]
    times = spark.sql("SELECT timestamp_ntz'1996-12-31 10:00' AS ds UNION ALL SELECT timestamp_ntz'1997-01-01 00:00'")
    assert series.between_dates(times, "1996-12-01", "1996-12-31").count() == 1


def test_far_gap_is_an_error_that_names_the_key(spark):
    import datetime as dt

    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 4), 2.0), ("b", dt.date(2024, 1, 1), 1.0), ("b", dt.date(9999, 12, 31), 1.0)],
                                 "series_key string, ds date, y double")
    assert [(r.series_key, r.ds, r.days) for r in series.far_gaps(rows).collect()] == [("b", dt.date(9999, 12, 31), (dt.date(9999, 12, 31) - dt.date(2024, 1, 1)).days)]
    with pytest.raises(Exception, match="after 2024-01-01 of b"):
        series.fill_gaps(rows).collect()
    assert series.fill_gaps(rows.where("series_key = 'a'"), limit=3).count() == 4


def test_sortedness(make):
    arrived = make({"k": [1, 2, 3, 4]}).withColumn("arrival", F.expr("array(2, 1, 3, 4)[datediff(ds, date'2024-01-01')]"))
    row = series.sortedness(arrived, "arrival").first()
    assert (row.inversions, row.is_sorted) == (1, False)


# -- quality ---------------------------------------------------------------------
def test_quality_counts(make):
    rows = make({
        "dirty": [NAN, -1, -2, -3] + [10] * 26,
        "gap": [5] * 10 + [None] + [5] * 10 + [None] + [5] * 10,
        "spike": [10 + i % 2 for i in range(59)] + [100],
        "zero": [0] * 30,
        "one": [3],
    })
    report = {r.series_key: r for r in quality.quality_report(rows).collect()}
    assert report["dirty"].missing_values == 4 and report["dirty"].negative_values == 3
    assert ("missing_share", 13.33, 0.1) in [(i.code, round(100 * i.figure, 2), i.limit) for i in report["dirty"].issues]
    assert report["gap"].date_gaps == 2 and series.fill_gaps(rows.where("series_key = 'gap'")).count() == 32
    assert (report["spike"].anomalies, report["spike"].oversize_values) == (1, 1)
    assert report["zero"].is_valid and report["zero"].anomalies == 0
    assert [tuple(i) for i in report["one"].issues] == [("too_short", 1.0, 30.0)]
    # dirty: mean 8.759 and deviation 3.729 over its 29 numbers put only -3 beyond three deviations
    found = {(r.series_key, r.value): r.zscore for r in quality.anomalies(rows).collect()}
    assert set(found) == {("dirty", -3.0), ("spike", 100.0)} and found["dirty", -3.0] == pytest.approx(3.153, abs=1e-3)


def test_repeated_days_count_as_gaps(spark):
    days = [1, 2, 2, 2, 3, 5]
    rows = spark.createDataFrame([("k", dt.date(2024, 1, d), 1.0) for d in days], "series_key string, ds date, y double")
    assert values(quality.date_gaps(rows), "date_gaps") == {"k": 3}


def test_guard_refuses_heavy_loss(make):
    rows = make({"dirty": [NAN, -1, -2, -3] + [10] * 26, "edge": [-1, -1, -1] + [2] * 27})
    kept = quality.clean_with_guard(rows).groupBy("series_key").count().collect()
    assert [(r[0], r[1]) for r in kept] == [("edge", 27)]


def test_recovery_by_error_class(make):
    data = make({
        "dirty": [-1] + [5 + i % 3 for i in range(59)], "lost": [-1] * 20 + [4] * 40, "short": [i % 5 for i in range(40)],
        "tiny": [1, 2, 3], "large": [i % 9 for i in range(2000)], "fine": [i % 4 for i in range(70)],
    })
    params, report = recover.fit_with_recovery(data, "lookback", {"lookback": 14}, lookback=29)
    got = {r.series_key: (r.error_type, r.action, r.recovered, r.rows_used, r.parameters) for r in report.collect()}
    assert got == {
        "dirty": ("invalid_values", "clean", True, 59, "lookback=29"), "lost": ("invalid_values", "clean", False, 0, "lookback=29"),
        "short": ("invalid_parameters", "fallback", True, 40, "lookback=14"),
        "tiny": ("invalid_parameters", "fallback", False, 0, "lookback=14"),
    }
    used = {r.series_key: r.n for r in params.collect()}
    assert used == {"dirty": 59, "short": 40, "large": 2000, "fine": 70}
    _, strict = recover.fit_with_recovery(data, "lookback", lookback=29)
    assert {r.series_key: (r.action, r.recovered) for r in strict.where("error_type = 'invalid_parameters'").collect()} == {
        "short": ("none", False), "tiny": ("none", False)}
    from seriesmill.operators.models import LookbackModel

    forecast = LookbackModel(29).predict(params, 3)
    assert forecast.where("yhat IS NOT NULL").count() == 12
    stats = {r.error_type: (r.attempts, r.open_attempts) for r in recover.error_statistics(report).collect()}
    assert stats == {"invalid_values": (2, 1), "invalid_parameters": (2, 1)}


# -- scalar rules ----------------------------------------------------------------
def test_week_and_promo_rules(spark):
    row = one(
        spark,
        cal.week_start(F.lit(2015), F.lit(1)).alias("a"), cal.week_start(F.lit(2018), F.lit(3)).alias("b"),
        cal.promo_blocks(F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date")).alias("before"),
        cal.competition_months(F.lit("2024-03-05").cast("date"), F.lit(2025), F.lit(1)).alias("future"),
        cal.competition_months(F.lit("2024-03-05").cast("date"), F.lit(None).cast("int"), F.lit(1)).alias("unknown"),
        cal.month_listed(F.lit("2024-09-05").cast("date"), F.lit("mar, SEP")).alias("listed"),
        cal.month_listed(F.lit("2024-09-05").cast("date"), F.lit("None")).alias("none"),
    )
    assert (row.a, row.b) == (dt.date(2014, 12, 29), dt.date(2018, 1, 15))
    assert (row.before, row.future, row.unknown, row.listed, row.none) == (-1, -10, 0, True, False)


def test_parsing(spark):
    texts = ["2024-03-05", "3/5/2024", "03/05/2024", "25/12/2023", "2024/03/05", "junk", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0].isoformat() if r[0] else None for r in df.select(parsing.parse_date(F.col("t"))).collect()]
    assert got == ["2024-03-05", "2024-03-05", "2024-03-05", "2023-12-25", "2024-03-05", None, None]
    numbers = spark.createDataFrame([(t,) for t in ("7", " 8.5 ", "NA", "", "x", "NaN")], "t string")
    assert [r[0] for r in numbers.select(parsing.parse_double(F.col("t"))).collect()] == [7.0, 8.5, None, None, None, None]


def test_lookup_tables(spark):
    def at(fn, *xs):
        return [one(spark, fn(F.lit(x)).alias("v")).v for x in xs]

    assert at(lookups.confidence_z, 0.995, 0.98, 0.96, 0.9, 0.85, 0.8, 0.5) == [2.58, 2.33, 1.96, 1.65, 1.44, 1.28, 1.96]
    assert at(lookups.safety_factor, 0.99, 0.95, 0.9, 0.5) == [2.33, 1.65, 1.28, 1.65]
    assert at(lookups.stock_band, 9, 10, 20, 40, 41) == ["CRITICAL", "WARNING", "GOOD", "GOOD", "EXCESS"]
    row = one(
        spark, lookups.band_for_argument(F.lit(9.0), F.lit("text:8")).alias("a"), lookups.band_for_argument(F.lit(9.0), F.lit("TEXT:x")).alias("b"),
        lookups.band_for_argument(F.lit(9.0), F.lit("color:8")).alias("c"), lookups.market_impact(F.lit("-0.1")).alias("d"),
        lookups.market_impact(F.lit("n/a")).alias("e"), lookups.method_for(F.lit("Simple (For basic trends)")).alias("f"),
    )
    assert tuple(row) == ("GOOD", "CRITICAL", None, "Negative", "Positive", "Standard")


def test_errors_with_zero_actuals(make):
    rows = make({"k": [0, 0, 0]}).withColumn("p", F.lit(2.0))
    row = rows.agg(
        metrics.mape(F.col("p"), F.col("y")).alias("mape"), metrics.rmse(F.col("p"), F.col("y")).alias("rmse"),
        metrics.mae(F.col("p"), F.col("y")).alias("mae"), F.max(metrics.relative_error(F.col("p"), F.col("y"))).alias("e"),
    ).first()
    assert tuple(row) == (None, 2.0, 2.0, None)


# -- features --------------------------------------------------------------------
def test_unmatched_sales_keep_defaults_and_first_store_wins(spark):
    sales = spark.createDataFrame([(1, dt.date(2024, 5, 1), 10.0, 3, 1, 1, "a", 0), (2, dt.date(2024, 12, 25), None, 0, 0, 0, "0", 1)], SALES)
    stores = spark.createDataFrame([
        (1, "b", "x", None, 4, 2020, 1, 1, 2024, "May,Nov"), (1, "a", "y", 5, None, None, 0, None, None, "None"),
    ], STORE)
    joined = features.enrich_sales(sales, features.first_per_key(stores, "store_id", F.col("assortment")))
    rows = {r.store_id: r for r in features.add_features(joined).withColumn("v", features.feature_vector()).collect()}
    assert (rows[1].store_type, rows[1].competition_open_months, rows[1].promo2_active_months, rows[1].promo2_active) == ("b", 49, 4, True)
    assert (rows[2].store_type, rows[2].promo_interval, rows[2].promo2, rows[2].promo2_active) == ("Unknown", "None", 0, False)
    assert rows[1].v == [1, 2024, 5, 1, 3, 0, 1, 1, 1, 0, -1, 49, 1, 4, 1]
    assert rows[1].is_easter_holiday and not rows[1].is_christmas and not rows[2].is_public_holiday
    assert [r[0] for r in sales.orderBy("store_id").select(features.label()).collect()] == [10.0, 0.0]
    other = {r.store_id: r for r in features.add_features(joined, "kaggle").collect()}
    assert other[1].is_public_holiday and other[1].day_of_week == 3 and other[1].promo2_active_months == 4


# -- inventory -------------------------------------------------------------------
def test_recommendation_numbers(spark):
    forecast = spark.createDataFrame(
        [("a", "m", s, dt.date(2024, 1, s), 10.0, 5.0, 15.0) for s in (1, 2, 3, 4)], "series_key string, model string, step int, ds date, yhat double, lo double, hi double"
    )
    stock = spark.createDataFrame([("a", 25)], "item string, stock int")
    row = inventory.recommendations(forecast, stock).first()
    safety = 5 * math.sqrt(3)
    assert row.lead_time_demand == 30 and row.safety_stock == pytest.approx(safety) and row.reorder_point == pytest.approx(30 + safety)
    assert (row.recommended_order, row.stock_status, row.days_of_supply) == (math.ceil(60 + safety - 25), "Low", 3)
    default = inventory.recommendations(forecast, stock.where("false"), default_stock=100).first()
    assert (default.current_stock, default.recommended_order, default.stock_status, default.days_of_supply) == (100, 0, "Adequate", 10)
    items = spark.createDataFrame([("A", "a", 2), ("B", "a", 60)], "item string, series_key string, stock int")
    shared = {r.item: r.stock_status for r in inventory.shared_recommendations(forecast, items).collect()}
    assert shared == {"A": "Critical", "B": "Adequate"}
    assert one(spark, inventory.eoq(F.lit(1000.0), F.lit(50.0), F.lit(4.0)).alias("q")).q == pytest.approx(math.sqrt(25000))
    assert one(spark, inventory.eoq(F.lit(1000.0), F.lit(50.0), F.lit(0.0)).alias("q")).q is None


def test_no_demand_means_no_days_of_supply(spark):
    assert one(spark, lookups.days_of_supply(F.lit(10), F.lit(0.0)).alias("d")).d == 0
    assert isinstance(STORE["store_id"].dataType, T.IntegerType)
