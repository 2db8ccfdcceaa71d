import pytest
from pyspark.sql import functions as F

from seriesmill.operators.models import DecomposeModel, SsaModel
from seriesmill.schema import SALES
from seriesmill.sources import csv, market, registry

STORE_CSV = """Store,StoreType,Assortment,CompetitionDistance,CompetitionOpenSinceMonth,CompetitionOpenSinceYear,Promo2,Promo2SinceWeek,Promo2SinceYear,PromoInterval
1,c,a,1270,9,2008,0,,,
2,,b,,,,1,13,2010,"Jan,Apr,Jul,Oct"
x,a,a,1,1,2000,0,,,
"""
TRAIN_CSV = """Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday
1,5,2015-07-31,5263,555,1,1,0,1
2,5,2015-07-31,6064,625,1,1,,1
9,5,2015-07-31,100,10,1,0,a,0
2,5,not a day,6064,625,1,1,0,1
2,5,2015-07-30,many,625,1,1,0,1
"""
TEST_LIVE = """Store,DayOfWeek,Date,Open,Promo,StateHoliday,SchoolHoliday
1,4,2015-09-17,1,1,0,0
"""
TEST_OLDER = """Id,Store,DayOfWeek,Date,Open,Promo,StateHoliday,SchoolHoliday
77,1,4,2015-09-17,1,1,0,0
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "store.csv").write_text(STORE_CSV)
    (tmp_path / "train.csv").write_text(TRAIN_CSV)
    (tmp_path / "test.csv").write_text(TEST_LIVE)
    return tmp_path


def test_sales_folder(spark, folder):
    rows = {r.store_id: r for r in csv.load_sales_folder(spark, str(folder)).collect()}
    assert set(rows) == {1, 2, 9}
    assert (rows[2].store_type, rows[2].promo_interval, rows[2].competition_distance, rows[2].state_holiday) == (
        "Unknown", "Jan,Apr,Jul,Oct", None, "0",
    )
    assert (rows[9].store_type, rows[9].promo2, rows[9].promo_interval) == ("Unknown", 0, "None")
    assert (rows[1].sales, rows[1].competition_open_since_month, rows[1].promo_interval) == (5263.0, 9, "None")


@pytest.mark.parametrize("layout", [TEST_LIVE, TEST_OLDER])
def test_scoring_file_layouts(spark, folder, layout):
    (folder / "test.csv").write_text(layout)
    row = csv.load_sales_folder(spark, str(folder), scoring=True).first()
    assert (row.store_id, str(row.ds), row.sales, row.customers, row.open, row.store_type) == (1, "2015-09-17", 0.0, 0, 1, "c")


def test_missing_input_fails_early(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.load_sales_folder(spark, str(tmp_path))


def test_demand_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('SALES,holiday,date\n"12.5",a,2024-01-02\n7,,3/5/2024\nx,0,2024-01-04\n5,0,soon\n3\n')
    good, bad = csv.parse_demand(csv.read_text_table(spark, str(tmp_path / "d.csv")))
    assert sorted((str(r.ds), r.sales, r.state_holiday) for r in good.collect()) == [("2024-01-02", 12.5, "a"), ("2024-03-05", 7.0, "0")]
    assert sorted(r.reason for r in bad.collect()) == ["bad_date", "bad_number", "missing_fields"]
    (tmp_path / "e.csv").write_text("day,sales\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="missing column"):
        csv.load_demand(spark, str(tmp_path / "e.csv"))


def test_split_lines_and_file_routing(spark, folder):
    lines = spark.createDataFrame([("1,a,b",), ("2,c",), ("3,d,e,f",)], "value string")
    assert [(r.k, r.m) for r in csv.parse_split_lines(lines, ["k", "l", "m"], 3).collect()] == [("1", "b"), ("3", "e")]
    (folder / "demand.csv").write_text("Date,Sales\n2024-01-01,1\n")
    text = spark.read.text(str(folder))
    stores, others = csv.route_files(text)
    count = lambda df: {r[0] for r in df.select("_metadata.file_name").distinct().collect()}
    assert count(stores) == {"store.csv", "train.csv"} and count(others) == {"demand.csv", "test.csv"}


def test_archive_and_exports(spark, make, tmp_path):
    series = make({"k": range(40)})
    model = DecomposeModel()
    forecast = model.predict(model.fit(series), 3)
    csv.export_forecast(forecast, str(tmp_path / "f"))
    back = spark.read.option("header", True).csv(str(tmp_path / "f"))
    assert back.columns == forecast.columns and back.count() == 3
    with pytest.raises(ValueError):
        csv.export_forecast(series, str(tmp_path / "g"))
    for stamp in ("2024-01-01", "2024-01-02"):
        csv.archive_import(series, str(tmp_path / "a"), stamp)
    assert spark.read.parquet(str(tmp_path / "a")).groupBy("imported_at").count().count() == 2


def test_registry(spark, make, tmp_path):
    series = make({"k": [i % 7 + i / 3 for i in range(60)]})
    model, path = SsaModel(5, 2), str(tmp_path / "models")
    params = model.fit(series)
    registry.save_model(params, path, "ssa", "1.0", parameters=model.parameters())
    registry.save_model(params, path, "ssa", "1.10")
    assert sorted(r.version for r in registry.model_versions(spark, path, "ssa").collect()) == ["1.0", "1.10"]
    loaded = registry.load_model(spark, path, "ssa", "1.0")
    assert loaded.first().parameters == {"window": "5", "components": "2"}
    want = [r.yhat for r in model.predict(params, 4).orderBy("step").collect()]
    assert [r.yhat for r in model.predict(loaded, 4).orderBy("step").collect()] == pytest.approx(want)
    registry.save_model(SsaModel(7, 1).fit(series), path, "ssa", "1.0", parameters={"window": "7"})
    again = registry.load_model(spark, path, "ssa", "1.0").collect()
    assert [r.parameters["window"] for r in again] == ["7"] and registry.model_versions(spark, path, "ssa").count() == 2
    for name, version in (("ssa", "9"), ("none", "1.0")):
        with pytest.raises(FileNotFoundError):
            registry.load_model(spark, path, name, version)


def test_market_documents(spark):
    bodies = [
        '{"Global Quote": {"01. symbol": "ABC", "05. price": "12.5", "09. change": "-1", "10. change percent": "-2%"}}',
        '{"Global Quote": {}}', '{"Note": "limit"}', "not json",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = [tuple(r) for r in market.quotes(df).orderBy("id").select("id", "symbol", "price", "change_percent", "impact").collect()]
    assert rows == [(0, "ABC", "12.5", "-2%", "Negative"), (1, "SPY", "N/A", "0%", "Positive")]
    sector = '{"Rank A: Real-Time Performance": {"Meta Data": "x", "Energy": "1%", "Tech": null}}'
    got = market.sectors(spark.createDataFrame([(1, sector)], "id int, body string")).orderBy("symbol")
    assert [(r.symbol, float(r.price), r.change) for r in got.collect()] == [("Energy", 0.0, "1%"), ("Tech", 0.0, "0%")]
    row = spark.range(1).select(market.indicator(F.lit("k"), F.lit("1"), F.lit("2%"), F.lit("-3")).alias("i")).first().i
    assert (row.key, row.impact) == ("k", "Negative")


def test_split_tables(spark):
    def table(kind, *lines):
        return csv.parse_split_table(spark.createDataFrame([(x,) for x in lines], "value string"), kind)[0].collect()

    store = table("store", "1,a,b,,9,2008,1,,2010,Jan", "2,a,b,5", "x,a,b,,9,2008,1,,2010,Jan")
    assert [(r.store_id, r.competition_distance, r.promo2, r.promo2_since_week) for r in store] == [(1, None, 1, None)]
    sales = table("sales", "3,5,2015-07-31,12.5,4,1,0,a,1", "3,5,2015-07-31,12.5")
    assert [(r.store_id, r.sales, r.customers, r.state_holiday) for r in sales] == [(3, 12.5, 4, "a")]
    scoring = table("scoring", "77,3,4,2015-09-17,1,1,0,0")
    assert [(r.store_id, str(r.ds), r.sales, r.open) for r in scoring] == [(3, "2015-09-17", 0.0, 1)]


def test_every_row_is_accepted_or_rejected(spark):
    columns = "Store string, Date string, Sales string, Customers string, Open string, Promo string, StateHoliday string, SchoolHoliday string"
    rows = [("1", "2015-07-31", "5", "1", "", None, "0", "1"), ("x", "2015-07-31", "5", "1", "1", "1", "0", "1"), ("2", "soon", "5", "1", "1", "1", "0", "1"),
            ("3", "2015-07-31", "many", None, "1", "1", None, "2"), (None,) * 8]
    good, bad = csv.parse_sales(spark.createDataFrame(rows, columns))
    assert good.columns == SALES.names
    assert sorted((r.store_id, r.sales, r.customers, r.open, r.promo, r.school_holiday) for r in good.collect()) == [
        (1, 5.0, 1, 0, 0, 1), (3, None, None, 1, 1, 0)]
    assert sorted(((r.raw_store, r.raw_date, r.reason) for r in bad.collect()), key=str) == [
        ("2", "soon", "bad_date"), ("x", "2015-07-31", "bad_store"), (None, None, "bad_store")]
    lines = spark.createDataFrame([("3,5,2015-07-31,12.5,4,,0,a,1",), ("3,5",), ("s,5,2015-07-31,12.5,4,1,0,a,1",), ("3,5,no,1,4,1,0,a,1",)], "value string")
    good, bad = csv.parse_split_table(lines, "sales")
    assert [r.open for r in good.collect()] == [0] and sorted(r.reason for r in bad.collect()) == ["bad_date", "bad_store", "few_fields"]


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Sales\n2024-01-01,1\n2024-01-02,"2"\n')
    (tmp_path / "b.csv").write_text("Sales, Date ,Holiday\n3,2024-01-03,a\n")
    (tmp_path / "c.csv").write_text("date,sales\n")
    good, bad = csv.parse_demand(csv.read_mixed_tables(spark, str(tmp_path)))
    assert sorted((str(r.ds), r.sales, r.state_holiday) for r in good.collect()) == [
        ("2024-01-01", 1.0, "0"), ("2024-01-02", 2.0, "0"), ("2024-01-03", 3.0, "a")]
    assert bad.count() == 0


def test_shared_folder(spark):
    from seriesmill.session import is_local

    assert [is_local(m) for m in ("local", "local[8]", "local[*]", "local-cluster[3,2,1024]", "yarn", "spark://h:7077")] == [True, True, True, False, False, False]


def test_lines_of_mixed_files_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Sales\n2024-01-01,1\n")
    (tmp_path / "b.csv").write_text("\n")
    (tmp_path / "c.csv").write_text("Sales,Date\n" + "3,2024-01-03\n" * 500)
    rows = csv.read_mixed_tables(spark, str(tmp_path))
    assert rows.count() == 501
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
