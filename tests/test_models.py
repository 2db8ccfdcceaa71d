import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
import reference_models as loops
from conftest import START
from pyspark.sql import functions as F

from seriesmill.operators.evaluate import cross_validate, cv_folds
from seriesmill.operators.forecast_run import forecast_run
from seriesmill.operators.models import (
    DecomposeModel, LookbackModel, SsaModel, WeightedModel, available_models, combine, decompose, ensemble_forecast,
    get_model, performance_weights,
)
from seriesmill.operators.models.base import UserModel
from seriesmill.operators.tune import best_parameters, grid_models, grid_search
from seriesmill.schema import SERIES as SERIES_SCHEMA

H = 14
random.seed(5)
TREND = [100 + 0.5 * i + (20 if i % 7 in (2, 5) else 0) for i in range(365)]
NOISE = [random.randint(0, 60) for _ in range(90)]
SERIES = {"trend": TREND, "noise": NOISE, "short": NOISE[:30], "level": [1e6 + v / 60 for v in NOISE], "flat": [5.0] * 40}


def by_key(forecast):
    out = {}
    for r in forecast.orderBy("series_key", "step").collect():
        out.setdefault(r.series_key, []).append(r)
    return out


@pytest.fixture(scope="module")
def series(make):
    return make(SERIES)


def predict(model, series, horizon=H):
    return by_key(model.predict(model.fit(series), horizon))


def test_decompose_forecast_matches_loop(series):
    got = predict(DecomposeModel(), series)
    for key, values in SERIES.items():
        for row, want in zip(got[key], loops.decompose_forecast(values, H), strict=True):
            assert (row.yhat, row.lo, row.hi) == pytest.approx(want, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("newest_heavy", [False, True])
def test_weighted_forecast_matches_loop(series, newest_heavy):
    got = predict(WeightedModel(newest_heavy=newest_heavy), series)
    for key, values in SERIES.items():
        want = loops.weighted_forecast(values, H, newest_heavy)
        assert [r.yhat for r in got[key]] == pytest.approx(want, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 13, 14])
def test_weighted_forecast_on_tiny_series(make, n):
    # The longest horizon exceeds the window, so forecasts leave it again.
    got = predict(WeightedModel(), make({"k": NOISE[:n]}), 40)["k"]
    assert [r.yhat for r in got] == pytest.approx(loops.weighted_forecast(NOISE[:n], 40), rel=1e-6, abs=1e-5)


def test_weighted_bounds_use_confidence(series):
    wide, narrow = (predict(WeightedModel(confidence=c), series)["noise"][3] for c in (0.99, 0.80))
    sd = np.std(NOISE, ddof=1)
    assert wide.hi - wide.yhat == pytest.approx(2.58 * sd * math.sqrt(1.3))
    assert narrow.hi - narrow.yhat == pytest.approx(1.28 * sd * math.sqrt(1.3))


def test_lookback_matches_loop(series):
    got = predict(LookbackModel(14), series)
    for key, values in SERIES.items():
        assert [r.yhat for r in got[key]] == pytest.approx(loops.lookback_forecast(values, H), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize(("window", "components"), [(7, 1), (7, 3), (2, 1), (14, 4)])
def test_ssa_matches_numpy(make, window, components):
    data = {k: SERIES[k] for k in ("trend", "noise", "short", "level")}
    got = predict(SsaModel(window, components), make(data))
    for key, values in data.items():
        want = loops.ssa_forecast(values, H, window, components)
        assert [r.yhat for r in got[key]] == pytest.approx(want, rel=1e-5), key


def test_ssa_bounds(make):
    rows = predict(SsaModel(7, 1), make({"long": TREND, "short": NOISE[:20]}))
    assert rows["long"][0].hi - rows["long"][0].yhat == pytest.approx(1.96 * np.std(TREND), rel=1e-6)
    first = rows["short"][0]
    assert first.hi - first.yhat == pytest.approx(1.96 * max(1.0, 0.1 * first.yhat), rel=1e-6)


def test_too_short_series_are_left_out(make):
    data = make({"one": [4], "two": [4, 6], "ok": NOISE[:28]})
    assert set(predict(DecomposeModel(), data)) == {"two", "ok"}
    assert set(predict(LookbackModel(14), data)) == {"ok"}
    assert set(predict(SsaModel(7, 3), data)) == {"ok"}


def test_two_points_extrapolate(make):
    rows = predict(DecomposeModel(window=1), make({"k": [4, 6]}), 3)["k"]
    want = loops.decompose_forecast([4, 6], 3, window=1)
    assert [r.yhat for r in rows] == pytest.approx([w[0] for w in want])


def test_forecast_shape_and_bounds(series):
    for model in (DecomposeModel(), WeightedModel(), LookbackModel(), SsaModel(7, 2)):
        rows = model.predict(model.fit(series), H)
        assert rows.count() == len(SERIES) * H
        assert rows.where((F.col("lo") > F.col("hi")) | (F.col("lo") < 0)).count() == 0
        assert rows.columns == ["series_key", "model", "step", "ds", "yhat", "lo", "hi"]


def test_parts_add_up_and_order_does_not_matter(make, spark):
    def shuffled(rows):
        rows = list(rows)
        random.Random(3).shuffle(rows)
        return rows

    rows = decompose(make(SERIES))
    off = rows.where(F.abs(F.col("trend") + F.col("seasonal") + F.col("residual") - F.col("y")) > 1e-6)
    assert off.count() == 0
    other = decompose(make(SERIES, shuffled).repartition(7))
    key = lambda r: (r.series_key, r.ds)
    for a, b in zip(sorted(rows.collect(), key=key), sorted(other.collect(), key=key), strict=True):
        assert a.trend == pytest.approx(b.trend) and a.seasonal == pytest.approx(b.seasonal, abs=1e-9)


def test_long_centred_window_equals_short_path(make):
    from seriesmill.operators.stats import moving_average

    data = make({"noise": NOISE}).selectExpr("*", "datediff(ds, date'2024-01-01') AS i")
    got = [r.t for r in data.withColumn("t", moving_average(41)).orderBy("i").collect()]
    assert got == pytest.approx([np.mean(NOISE[max(0, i - 20): i + 21]) for i in range(90)])


def test_ensemble_lies_between_members(series):
    models = [DecomposeModel(), WeightedModel(), LookbackModel()]
    members = [predict(m, series) for m in models]
    for key, rows in by_key(ensemble_forecast(series, models, H, {"wma": 3.0})).items():
        for at, row in enumerate(rows):
            values = [m[key][at].yhat for m in members]
            assert row.yhat == pytest.approx((values[0] + 3 * values[1] + values[2]) / 5)
            assert min(values) - 1e-9 <= row.yhat <= max(values) + 1e-9


def test_ensemble_needs_every_model(make):
    data = make({"one": [3], "ok": NOISE})
    models = [WeightedModel(), LookbackModel()]
    forecasts = [m.predict(m.fit(data), 2) for m in models]
    assert set(by_key(combine(forecasts))) == {"ok"}
    assert set(by_key(combine(forecasts, require_all=False))) == {"one", "ok"}


def test_weights_sum_to_one(spark):
    scores = spark.createDataFrame(
        [("a", "x", 0.0), ("a", "y", 1.0), ("b", "x", None), ("b", "y", 0.5), ("c", "x", None)],
        "series_key string, model string, mape double",
    )
    got = {(r.series_key, r.model): r.weight for r in performance_weights(scores).collect()}
    assert got == pytest.approx({("a", "x"): 2 / 3, ("a", "y"): 1 / 3, ("b", "x"): 0.0, ("b", "y"): 1.0, ("c", "x"): 1.0})


def test_forecast_run_fits_on_the_first_part(make):
    got = by_key(forecast_run(make({"k": NOISE}), "ssa", 5, window=7, components=2))["k"]
    a, w = loops.ssa_rule(NOISE[:72], 7, 2)
    values = list(NOISE)
    for _ in range(5):
        values.append(a + np.dot(w, values[-7:]))
    assert [r.yhat for r in got] == pytest.approx(values[90:], rel=1e-6)
    assert got[0].ds.isoformat() == "2024-03-31"
    with pytest.raises(ValueError):
        forecast_run(make({"k": NOISE}), "ssa", 0)


def test_registry_of_models():
    assert available_models() == ["decompose", "lookback", "ssa", "wma"]
    assert get_model("SSA", window=30).window == 30
    with pytest.raises(ValueError, match="unknown model"):
        get_model("nothing")


def mape_of(train, check, size):
    a, w = loops.ssa_rule(train, size, 2)
    errors = [
        abs((a + np.dot(w, check[t - size: t]) - check[t]) / check[t]) for t in range(size, len(check)) if check[t] > 0
    ]
    return np.mean(errors)


def test_cross_validation_matches_loop(make):
    values = [v + 1 for v in NOISE]
    row = cross_validate(make({"k": values}), SsaModel(5, 2), k=4).first()
    folds = np.array_split(np.array(values, float), 4)
    want = [mape_of(np.concatenate(folds[:f] + folds[f + 1:]), folds[f], 5) for f in range(4)]
    assert row.fold_results == pytest.approx(want, rel=1e-6)
    assert row.mean_mape == pytest.approx(np.mean(want)) and row.sd_mape == pytest.approx(np.std(want, ddof=1))


def test_fold_sizes_differ_by_at_most_one(make):
    for shuffle in (False, True):
        folds = cv_folds(make({"k": NOISE[:53], "j": NOISE[:11]}), 5, shuffle)
        sizes = folds.groupBy("series_key", "fold").count().collect()
        assert sorted(r["count"] for r in sizes if r.series_key == "k") == [10, 10, 11, 11, 11]
        assert sorted(r["count"] for r in sizes if r.series_key == "j") == [2, 2, 2, 2, 3]


def test_grid_search_handles_sets_that_fail(make):
    # 30 rows in 3 folds train on 20: enough for windows up to 10 only.
    models = grid_models("ssa", {"window": [5, 9, 12], "components": [1]})
    rows = {r.grid_id: r for r in grid_search(make({"k": [v + 1 for v in NOISE[:30]]}), models, 3).collect()}
    assert rows[2].mean_mape is None and rows[2].rank == 3
    assert rows[0].mean_mape is not None and rows[1].mean_mape is not None
    folds = np.array_split(np.array([v + 1 for v in NOISE[:30]], float), 3)
    a, w = loops.ssa_rule(np.concatenate(folds[1:]), 5, 1)
    want = np.mean([abs((a + np.dot(w, folds[0][t - 5: t]) - folds[0][t]) / folds[0][t]) for t in range(5, 10)])
    assert rows[0].fold_results[0] == pytest.approx(want)
    best = best_parameters(make({"k": [v + 1 for v in NOISE[:30]]}), models, 3).first()
    assert best.grid_id == min((r.mean_mape, g) for g, r in rows.items() if r.mean_mape is not None)[1]
    assert best.parameters == {"window": str(models[best.grid_id].window), "components": "1"}


def test_user_model_reports_failing_keys(make):
    def fn(pdf, horizon, level):
        if len(pdf) < 10:
            raise ValueError("too few rows")
        days = pd.date_range(pdf["ds"].iloc[-1], periods=horizon + 1)[1:]
        return pd.DataFrame({"ds": days.date, "yhat": level, "lo": level, "hi": level})

    good, bad = UserModel("const", fn, level=3.0).run(make({"a": NOISE, "b": NOISE[:4]}), 2)
    assert [(r.series_key, r.step, r.yhat) for r in good.orderBy("step").collect()] == [("a", 1, 3.0), ("a", 2, 3.0)]
    assert [(r.series_key, r.error_type, r.message) for r in bad.collect()] == [("b", "ValueError", "too few rows")]


def test_routing_by_method(make, spark):
    from seriesmill.operators.forecast_run import forecast_by_method

    data = make({"a": NOISE, "b": NOISE, "c": NOISE, "d": NOISE})
    routing = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "odd")], "series_key string, method string")
    models = {"x": DecomposeModel(), "y": WeightedModel()}
    rows = forecast_by_method(data, routing, models, 2, default="y").where("step = 1").collect()
    assert {r.series_key: r.model for r in rows} == {"a": "decompose", "b": "wma", "c": "wma", "d": "wma"}
    assert forecast_by_method(data, routing, models, 2).count() == 4
    with pytest.raises(ValueError):
        forecast_by_method(data, routing, models, 2, default="z")


def test_retried_prediction(make):
    from seriesmill.operators.recover import retry_prediction

    data = make({"k": NOISE, "dirty": [-1] * 5 + NOISE[:60], "bad": [-1] * 40})
    refit = retry_prediction(data.where("series_key = 'k'"), "not_fitted", LookbackModel(), 3).orderBy("step").collect()
    assert [r.yhat for r in refit] == pytest.approx(loops.lookback_forecast(NOISE, 3))
    newest = retry_prediction(data.where("series_key = 'k'"), "not_fitted", LookbackModel(), 3, recent=30).orderBy("step").collect()
    assert [r.yhat for r in newest] == pytest.approx(loops.lookback_forecast(NOISE[-30:], 3))
    cleaned = retry_prediction(data, "invalid_values", LookbackModel(), 1)
    got = {r.series_key: r.yhat for r in cleaned.collect()}
    assert set(got) == {"k", "dirty"} and got["dirty"] == pytest.approx(loops.lookback_forecast(NOISE[:60], 1)[0])


def test_result_does_not_depend_on_partitions(spark, make):
    data, model = make(SERIES), SsaModel(5, 2)
    want = {(r.series_key, r.step): r.yhat for r in model.predict(model.fit(data), 3).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = {(r.series_key, r.step): r.yhat for r in model.predict(model.fit(data.repartition(9)), 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("model", [DecomposeModel(), WeightedModel(), LookbackModel(), SsaModel(5, 2)])
def test_missing_values_are_reported_and_others_forecast(spark, make, model):
    """A null near the end, one in the middle, a NaN and nulls only: none is forecast, none stops the other keys."""
    from seriesmill.operators.series import fill_gaps

    day = lambda i: START + dt.timedelta(days=i)
    rows = [(k, day(i), float(NOISE[i % len(NOISE)])) for k in ("good",) for i in range(60)]
    for key, at, value in (("late", 59, None), ("middle", 30, None), ("nan", 40, math.nan)):
        rows += [(key, day(i), value if i == at else float(NOISE[i % len(NOISE)])) for i in range(60)]
    rows += [("none", day(i), None) for i in range(60)]
    data = spark.createDataFrame(rows, SERIES_SCHEMA)
    forecast = model.predict(model.fit(data), 3)
    assert {r.series_key for r in forecast.collect()} == {"good"}
    assert {(r.series_key, r.error_type) for r in model.skipped(data).collect()} == {(k, "missing_values") for k in ("late", "middle", "nan", "none")}
    filled = fill_gaps(data.where("series_key = 'late'"))
    assert model.predict(model.fit(filled), 2).where("yhat IS NOT NULL").count() == 2
    assert {r.error_type for r in model.skipped(make({"k": [1.0]})).collect()} == ({"too_short"} if model.min_rows > 1 else set())


def test_parameters_outside_their_limits_are_errors():
    for build in (lambda: SsaModel(60), lambda: SsaModel(7, 9), lambda: LookbackModel(3)):
        with pytest.raises(ValueError, match="must lie between"):
            build()


def test_run_of_a_model_without_a_window_ends_at_the_last_day(make):
    from seriesmill.operators.forecast_run import forecast_run

    line = make({"k": range(100)})
    rows = forecast_run(line, "decompose", 2).orderBy("step").collect()
    assert [str(r.ds) for r in rows] == ["2024-04-10", "2024-04-11"] and rows[0].yhat > 90
    assert forecast_run(line, "wma", 2).count() == 2
