"""Streams over several micro-batches give what the batch forms give."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import monitor
from seriesmill.schema import SERIES
from seriesmill.streaming.daily import daily_totals, daily_totals_batch
from seriesmill.streaming.learner import online_learner, ssa_step
from seriesmill.streaming.monitor import prediction_monitor, with_actuals
from seriesmill.streaming.run import drain, file_stream

START = dt.date(2024, 1, 1)


def files(spark, path, parts):
    """One Parquet file per part, in arrival order."""
    for at, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/part={at:03d}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", True
    ).parquet(str(path))


def run(stream, tmp_path):
    return drain(stream, "t", str(tmp_path / "out"), str(tmp_path / "progress"))


@pytest.fixture(scope="module")
def daily(spark):
    rng = random.Random(4)
    rows = [(k, START + dt.timedelta(days=d), float(rng.randint(1, 40))) for k in ("a", "b") for d in range(60)]
    rows = [r for r in rows if not (r[0] == "b" and r[1].day in (9, 10))]
    return spark.createDataFrame(rows, SERIES)


def in_parts(df, cuts):
    days = [START + dt.timedelta(days=d) for d in cuts]
    bounds = [START, *days, START + dt.timedelta(days=10000)]
    return [df.where((F.col("ds") >= a) & (F.col("ds") < b)) for a, b in zip(bounds, bounds[1:])]


def test_learner_equals_batch(spark, daily, tmp_path):
    stream = files(spark, tmp_path / "in", in_parts(daily, [13, 14, 40]))
    got = run(online_learner(stream, 14), tmp_path).where("error IS NOT NULL")
    errors = monitor.online_errors(daily, 14, 7)
    want = {(r.series_key, r.ds): r for r in monitor.learner_performance(errors, 14).collect()}
    rows = got.collect()
    assert len(rows) == len(want) > 60
    for r in rows:
        w = want[r.series_key, r.ds]
        for c in ("predicted", "error", "num_samples", "mean_error", "sd_error", "drift", "drifted"):
            assert getattr(r, c) == pytest.approx(getattr(w, c)), (r.series_key, r.ds, c)


def test_late_gapped_and_repeated_rows(spark, tmp_path):
    def rows(*days):
        return spark.createDataFrame([("k", START + dt.timedelta(days=d), 10.0 + d) for d in days], SERIES)

    # 14 days fill the window; then a gap, a late row and a repeated day.
    stream = files(spark, tmp_path / "in", [rows(*range(14)), rows(15), rows(12), rows(15, 16)])
    got = {}
    for r in run(online_learner(stream, 14), tmp_path).collect():
        got.setdefault((r.ds - START).days, []).append(r)
    assert got[13][0].next_forecast is not None and got[12][0].next_forecast is None
    assert [r.error for r in got[15] if not r.late] == [None]  # the day before is missing
    assert sorted(r.late for r in got[12]) == [False, True] and sorted(r.late for r in got[15]) == [False, True]
    assert got[16][0].error is not None and not got[16][0].late


def test_learner_with_ssa_model(spark, daily, tmp_path):
    stream = files(spark, tmp_path / "in", in_parts(daily, [30]))
    rows = run(online_learner(stream, 30, step=ssa_step(7, 2)), tmp_path).where("series_key = 'a'").collect()
    values = [r.y for r in daily.where("series_key = 'a'").orderBy("ds").collect()]
    by_day = {(r.ds - START).days: r for r in rows}
    import reference_models as loops

    a, w = loops.ssa_rule(values[10:40], 7, 2)
    assert by_day[39].next_forecast == pytest.approx(a + np.dot(w, values[33:40]))
    assert by_day[40].predicted == pytest.approx(by_day[39].next_forecast)


def test_monitor_equals_batch(spark, daily, tmp_path):
    yesterday = daily.select("series_key", F.date_add("ds", 1).alias("ds"), F.col("y").alias("predicted"))
    pairs = daily.withColumnRenamed("y", "actual").join(yesterday, ["series_key", "ds"])
    stream = files(spark, tmp_path / "in", in_parts(pairs, [5, 33]))
    rows = run(prediction_monitor(stream), tmp_path).collect()
    want = {(r.series_key, r.ds): r for r in monitor.rolling_performance(pairs).collect()}
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.series_key, r.ds]
        for c in ("error", "num_samples", "mean_error", "sd_error", "drift"):
            assert getattr(r, c) == pytest.approx(getattr(w, c)), c
    alerts = {(r.series_key, r.ds) for r in monitor.degradation_alerts(pairs).collect()}
    assert alerts == {(r.series_key, r.ds) for r in rows if r.alert} and alerts
    for key in ("a", "b"):
        days = sorted(d for k, d in alerts if k == key)
        assert all((b - a).days > 1 for a, b in zip(days, days[1:]))


def test_monitor_skips_zero_actuals(spark, make, tmp_path):
    pairs = make({"k": [0, 4, 0, 8]}).selectExpr("series_key", "ds", "2.0D AS predicted", "y AS actual")
    rows = run(prediction_monitor(files(spark, tmp_path / "in", [pairs])), tmp_path).orderBy("ds").collect()
    assert [(r.error, r.num_samples) for r in rows] == [(0.5, 1), (0.75, 2)]
    assert monitor.performance(pairs).first().num_samples == 2


def test_forecast_joined_to_a_stream_of_actuals(spark, make, tmp_path):
    actual = make({"k": [4, 8]})
    forecast = make({"k": [5, 8]}).withColumnRenamed("y", "yhat")
    rows = run(with_actuals(forecast, files(spark, tmp_path / "in", [actual])), tmp_path).orderBy("ds").collect()
    assert [(r.actual, r.predicted) for r in rows] == [(4.0, 5.0), (8.0, 8.0)]


def test_daily_totals_closed_days(spark, tmp_path):
    def part(*stamps):
        return spark.createDataFrame([("u", t, 1.0) for t in stamps], "u string, ts string, value double").withColumn(
            "ts", F.col("ts").cast("timestamp")
        )

    parts = [
        part("2024-01-01 05:00", "2024-01-01 23:00", "2024-01-02 01:00"),
        part("2024-01-02 09:00", "2024-01-01 22:00", "2024-01-04 12:00"),  # the second is late but inside the delay
        part("2024-01-06 00:30"),  # moves the watermark to 5 January, 00:30
        part("2024-01-01 10:00"),  # its day is closed
    ]
    got = {str(r.ds): r.y for r in run(daily_totals(files(spark, tmp_path / "in", parts), "u"), tmp_path).collect()}
    assert got == {"2024-01-01": 3.0, "2024-01-02": 2.0, "2024-01-04": 1.0}
    every = {str(r.ds): r.y for r in daily_totals_batch(parts[0].unionByName(parts[1]), "u").collect()}
    assert every["2024-01-01"] == 3.0 and every["2024-01-04"] == 1.0


def test_drained_stream_resumes(spark, make, tmp_path):
    first, second = make({"k": range(10)}), make({"k": [None] * 10 + [5] * 5})
    path = tmp_path / "in"
    first.coalesce(1).write.parquet(f"{path}/part=0")

    def source():
        return spark.readStream.schema(first.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(path))

    run(online_learner(source(), 7), tmp_path)
    second.coalesce(1).write.parquet(f"{path}/part=1")
    assert run(online_learner(source(), 7), tmp_path).count() == 15
    assert file_stream(spark, str(path), first).isStreaming


def arriving(daily):
    """Days in five parts; some rows come a part too late."""
    part = (F.datediff("ds", F.lit(START)) / 12).cast("int")
    behind = (F.datediff("ds", F.lit(START)) % 12 == 5) & (F.col("series_key") == "a")
    return daily.withColumn("part", F.least(part + behind.cast("int"), F.lit(4)))


def test_release_in_order_and_replay(spark, daily, tmp_path):
    from seriesmill.streaming.reorder import Ordered, late_rows, ordered_rows, release_in_order

    rows = arriving(daily)
    stream = files(spark, tmp_path / "in", [rows.where(F.col("part") == p).drop("part") for p in range(5)])
    paths = Ordered.below(str(tmp_path / "ordered"))
    release_in_order(stream, paths, 2, str(tmp_path / "progress"))
    late = {(r.series_key, r.ds) for r in late_rows(spark, paths, SERIES).collect()}
    assert late == {("a", START + dt.timedelta(days=d)) for d in (5, 17, 29, 41)}
    released = {(r.series_key, r.ds) for r in ordered_rows(spark, paths, SERIES).collect()}
    assert released | late == {(r.series_key, r.ds) for r in daily.collect()} and not released & late
    assert ordered_rows(spark, paths, SERIES, flush=False).agg(F.max("ds")).first()[0] == START + dt.timedelta(days=57)
    # Days of a batch lie behind those of the batches before it.
    highest = START - dt.timedelta(days=1)
    for batch in range(5):
        days = [r.ds for r in spark.read.parquet(f"{paths.released}/batch={batch}").collect()]
        assert min(days) > highest
        highest = max(days)
    # A run that lost its progress repeats all batches and leaves the same tables.
    release_in_order(files_again(spark, tmp_path / "in", SERIES), paths, 2, str(tmp_path / "progress2"))
    assert {(r.series_key, r.ds) for r in ordered_rows(spark, paths, SERIES).collect()} == released
    assert late_rows(spark, paths, SERIES).count() == len(late)


def files_again(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", True).parquet(str(path))


def test_daily_table_holds_every_day(spark, tmp_path):
    from seriesmill.streaming.daily import daily_table

    rows = [("a", dt.datetime(2024, 1, 1 + d, h), float(d + h)) for d in range(6) for h in (1, 9, 23)]
    schema = "k string, ts timestamp, value double"
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 4), (4, 10), (10, 18))]
    totals = daily_totals(files(spark, tmp_path / "in", parts), "k")
    got = {r.ds: r.y for r in daily_table(totals, str(tmp_path / "out"), str(tmp_path / "progress")).collect()}
    whole = spark.createDataFrame(rows, schema)
    assert got == {r.ds: r.y for r in daily_totals_batch(whole, "k").collect()} and len(got) == 6


def test_forecasts_and_actuals_of_two_streams(spark, daily, tmp_path):
    from seriesmill.streaming.monitor import stream_errors

    forecast = daily.select("series_key", "ds", (F.col("y") * 1.5).alias("yhat"))
    left = files(spark, tmp_path / "f", in_parts(forecast, [10, 30]))
    right = files(spark, tmp_path / "a", in_parts(daily, [20]))
    rows = run(stream_errors(left, right, "90 days"), tmp_path).collect()
    assert len(rows) == daily.count() and all(r.error == pytest.approx(0.5) for r in rows)


def test_online_forecasts_equal_the_model_and_expire(spark, daily, tmp_path):
    from seriesmill.operators.models import LookbackModel
    from seriesmill.streaming.learner import online_forecasts

    stream = files(spark, tmp_path / "in", in_parts(daily.where("series_key = 'a'"), [20, 40]))
    got = {(r.made, r.step): r for r in run(online_forecasts(stream, 14, 7, 5), tmp_path).collect()}
    model = LookbackModel(7)
    for last in (20, 33, 59):
        past = daily.where((F.col("series_key") == "a") & (F.col("ds") <= START + dt.timedelta(days=last)) & (F.col("ds") > START + dt.timedelta(days=last - 14)))
        for w in model.predict(model.fit(past), 5).collect():
            r = got[START + dt.timedelta(days=last), w.step]
            assert (r.ds, r.yhat, r.lo, r.hi) == (w.ds, pytest.approx(w.yhat), pytest.approx(w.lo), pytest.approx(w.hi))
    # "b" falls silent; with a short idle time its window starts anew, without one it goes on.
    cut = daily.where("series_key = 'a' OR ds < date'2024-01-19' OR ds >= date'2024-02-20'")
    parts = in_parts(cut, [12, 25, 38, 50])
    kept = run(online_forecasts(files(spark, tmp_path / "k", parts), 14, 7, 1), tmp_path / "kept").where("series_key = 'b'").count()
    lost = run(online_forecasts(files(spark, tmp_path / "l", parts), 14, 7, 1, idle="10 days"), tmp_path / "lost").where("series_key = 'b'").count()
    assert kept == lost + 10 and lost > 0


def test_a_value_that_is_missing_poisons_nothing(spark, tmp_path):
    rows = [("a", START + dt.timedelta(days=d), float("nan") if d == 20 else float(5 + d % 7)) for d in range(60)]
    got = run(online_learner(files(spark, tmp_path / "in", [spark.createDataFrame(rows, SERIES)]), 14), tmp_path)
    assert got.where("isnan(predicted) OR isnan(error) OR isnan(mean_error)").count() == 0 and got.where("error IS NOT NULL").count() > 40
