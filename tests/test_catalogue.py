import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry_point
from seriesmill.plans import callables, oracles

TABLES = "part supplier orders lineitem events pages".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(callables()) == set(oracles())
    assert set(callables()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 25


# Quick ones of each kind; tools/check_queries.py runs them all.
@pytest.mark.parametrize("name", [
    "gap_filled_series", "decompose", "ssa_moments", "feature_vector", "promo_features_kaggle", "reject_rows", "quality_report",
    "clean_with_guard", "forecast_decompose", "forecast_wma", "forecast_lookback", "forecast_ssa", "forecast_ensemble",
    "forecast_errors", "grid_search", "recover_failed", "recommendations", "market_quotes", "degradation_alerts", "stream_monitor",
])
def test_query_agrees_with_sql(spark, db, name):
    df = entry_point.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    found = db.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(repr(tuple(row[i] for i in order)) for row in found.fetchall())


def plan_of(spark, name):
    return entry_point.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "date_range")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l_ship" in plan and "LessThan(l_ship" in plan  # text is cut
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["forecast_decompose", "forecast_wma", "forecast_ssa", "cross_validate", "recover_failed"])
def test_two_shuffles_after_the_part_lookup(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("Exchange hashpartitioning") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_round_trip_gives_rows_and_the_totals_of_their_days(spark, db):
    """Both what single rows hold and what the daily sums do."""
    test_query_agrees_with_sql(spark, db, "csv_round_trip")
    rows = entry_point.queries()["csv_round_trip"](spark, DATA).collect()
    days = {}
    for r in rows:
        days.setdefault(r.ds, []).append(r.sales)
    assert all((r.rows, r.day_sales) == (len(days[r.ds]), sum(days[r.ds])) for r in rows)
    assert len(rows) > len(days)


@pytest.mark.parametrize("name", [
    "padded_window", "centered_moving_average", "user_model", "date_gaps", "date_gap_rows", "quality_report", "series_skip", "train_test_split",
    "short_series", "sortedness", "linear_trend", "recover_failed",
])
def test_many_keys_are_dealt_by_their_rows(spark, name):
    """Windows over the series of suppliers take partitions whose number follows the lines, which adaptive execution does not join."""
    assert "REPARTITION_BY_NUM" in plan_of(spark, name)


def test_partitions_follow_the_rows(spark, make):
    from seriesmill.operators import series, stats

    rows = make({str(k): [1.0] * 20 for k in range(50)})
    filled = series.fill_gaps(series.deal_by_key(rows, 1000, 100)).withColumn("trend", stats.moving_average(7))
    assert filled.rdd.getNumPartitions() == 10 and filled.count() == 1000


@pytest.mark.parametrize("name", ["centered_moving_average", "user_model", "padded_window", "date_gaps", "sortedness"])
def test_lines_are_dealt_before_they_are_summed(spark, name):
    """Nearly every line has a supplier and day of its own: sums beside the scan hold a whole split in memory and combine nothing."""
    scanned = plan_of(spark, name).rsplit("Exchange", 1)[1]
    assert "REPARTITION_BY_NUM" in scanned.splitlines()[0] and "ds" in scanned.splitlines()[0] and "Aggregate" not in scanned


def test_dealt_rows_give_the_same_series(spark):
    from seriesmill.operators import series

    lines = spark.sql("SELECT id % 7 AS k, date_add(DATE '2020-02-01', int(id % 11)) AS d, if(id % 13 = 0, double('NaN'), id / 2) AS v FROM range(500)")
    rows = lambda **more: sorted((r.series_key, r.ds, r.y) for r in series.to_series(lines, "k", "d", "v", **more).collect())
    assert rows(rows=500) == rows() and len(rows()) == 77
    assert series.to_series(lines.limit(0), "k", "d", "v", rows=0).count() == 0


@pytest.mark.parametrize("name", ["user_model", "sortedness", "recover_failed"])
def test_scans_deal_over_few_partitions_first(spark, monkeypatch, name):
    """For many partitions the shuffle writer keeps a split's rows in memory; Spark must not make one of the two deals."""
    from seriesmill.operators import series

    monkeypatch.setattr(series, "UNSORTED_PARTITIONS", 1, raising=False)
    scanned = plan_of(spark, name).split("Aggregate")[-1]
    assert scanned.count("REPARTITION_BY_NUM") == 2


def test_rows_dealt_twice_give_the_same_series(spark):
    from seriesmill.operators import series

    lines = spark.sql("SELECT string(id % 7) AS k, date_add(DATE '2020-02-01', int(id % 11)) AS d, double(id) AS v FROM range(500)")
    dealt = series.to_series(lines, "k", "d", "v", rows=201 * series.PARTITION_ROWS)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, series.to_series(lines, "k", "d", "v").collect()))
    assert "200), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString() and dealt.rdd.getNumPartitions() == 201
