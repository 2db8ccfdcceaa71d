"""Parameters without a fold, from sums over the others, against fits on the rows that are left."""

import numpy as np
import pytest
from conftest import START
from pyspark.sql import functions as F

from seriesmill.operators import evaluate, tune
from seriesmill.operators.evaluate import cv_folds
from seriesmill.operators.forecast_run import forecast_outcomes
from seriesmill.operators.models import DecomposeModel, EnsembleModel, LookbackModel, SsaModel, WeightedModel, combine
from seriesmill.operators.models.ssa import affine_rule, leading_vectors
from seriesmill.operators.series import with_position

RNG = np.random.default_rng(12)
SERIES = {name: (RNG.random(n) * 30 + 10 * np.sin(np.arange(n)) + 20).tolist() for name, n in (("a", 53), ("b", 20), ("c", 31))}
K = 4


def fits(make, model, shuffle):
    folds = cv_folds(make(SERIES), K, shuffle).select("series_key", "ds", "y", "n", "o", "fold", "fold_start", "fold_size")
    rows = tune._with_fits(folds, [model]).select("series_key", "o", "y", "fold", "_fit0").collect()
    found, values = {}, {}
    for r in rows:
        found[r.series_key, r.fold] = r._fit0
        values.setdefault(r.series_key, {})[r.o] = (r.y, r.fold)
    for key, fold in sorted(found):
        left = np.array([values[key][o][0] for o in sorted(values[key]) if values[key][o][1] != fold])
        yield found[key, fold], left


@pytest.mark.parametrize("shuffle", [False, True])
@pytest.mark.parametrize("window", [2, 5, 9])
def test_ssa_without_a_fold(make, window, shuffle):
    for fit, left in fits(make, SsaModel(window, 2), shuffle):
        if len(left) < 2 * window:
            assert fit is None
            continue
        rows = np.lib.stride_tricks.sliding_window_view(left, window)
        intercept, weights = affine_rule(rows.mean(0)[None], leading_vectors(np.cov(rows.T)[None], 2))
        assert fit.intercept == pytest.approx(intercept[0], abs=1e-6) and fit.weights == pytest.approx(weights[0].tolist(), abs=1e-7)


@pytest.mark.parametrize("shuffle", [False, True])
def test_positions_and_slope_without_a_fold(make, shuffle):
    for fit, left in fits(make, DecomposeModel(), shuffle):
        means = np.array([left[p::7].mean() if len(left[p::7]) else 0 for p in range(7)])
        assert fit.profile == pytest.approx((means - means.mean()).tolist())
    for fit, left in fits(make, WeightedModel(), shuffle):
        means = np.array([left[p::7].mean() for p in range(7)])
        assert fit.slope == pytest.approx(np.polyfit(np.arange(len(left)), left, 1)[0]) and fit.span == max(2, min(30, len(left) // 4))
        assert fit.deviations == pytest.approx((means - left.mean()).tolist() if len(left) >= 14 else [0.0] * 7)


def test_ensemble_of_kinds_in_one_grid(make):
    models = [EnsembleModel([DecomposeModel(), LookbackModel(7)], [1.0, 2.0]), LookbackModel(7), SsaModel(4, 2)]
    scores = {(r.series_key, r.grid_id, r.fold): r.mape for r in tune.grid_scores(make(SERIES), models, K).collect()}
    alone = {(r.series_key, r.fold): r.mape for r in evaluate.fold_scores(make(SERIES), LookbackModel(7), K).collect()}
    assert {(k, f): m for (k, g, f), m in scores.items() if g == 1} == alone and len(scores) == 3 * len(alone)
    assert {m is None for (k, g, f), m in scores.items() if k == "a" and g == 0} == {False}


def test_ensemble_is_the_weighted_mean_of_its_members(make):
    data = make(SERIES)
    members, weights = [DecomposeModel(), WeightedModel(), LookbackModel(7)], {"wma": 3.0}
    model = EnsembleModel(members, weights)
    want = combine([m.predict(m.fit(data), 5) for m in members], weights).collect()
    got = {(r.series_key, r.step): r for r in model.predict(model.fit(data), 5).collect()}
    assert len(got) == len(want) == 15
    for w in want:
        r = got[w.series_key, w.step]
        assert (r.ds, r.yhat, r.lo, r.hi) == (w.ds, pytest.approx(w.yhat), pytest.approx(w.lo), pytest.approx(w.hi))
    assert model.evaluate(model.fit(data), data).count() == 2  # "b" has no row behind a full look-back
    with pytest.raises(ValueError):
        EnsembleModel([SsaModel()])


def test_recurrence_continues_the_rebuilt_series(make):
    window, components, y = 6, 3, np.array(SERIES["a"])
    rows = np.lib.stride_tricks.sliding_window_view(y, window)
    mean, vectors = rows.mean(0), leading_vectors(np.cov(rows.T)[None], components)[0]
    projected = (rows - mean) @ vectors @ vectors.T + mean
    rebuilt = np.array([np.mean([projected[s, t - s] for s in range(len(rows)) if 0 <= t - s < window]) for t in range(len(y))])
    path = rebuilt[-(window - 1):].tolist()
    for _ in range(4):  # the value that puts the next window closest into the span, given the others
        head, last = vectors[:-1], vectors[-1]
        path.append(mean[-1] + (head @ last) @ (np.array(path[-(window - 1):]) - mean[:-1]) / (1 - last @ last))
    model = SsaModel(window, components, method="recurrent")
    found = model.predict(model.fit(make({"a": SERIES["a"]})), 4).orderBy("step").collect()
    assert [r.yhat for r in found] == pytest.approx(path[-4:])
    # A sum of a level and one wave obeys the recurrence exactly.
    wave = [50 + 9 * np.cos(0.7 * t + 1) for t in range(60)]
    model = SsaModel(8, 2, method="recurrent")
    found = model.predict(model.fit(make({"w": wave[:50]})), 10).orderBy("step").collect()
    assert [r.yhat for r in found] == pytest.approx(wave[50:], abs=0.5)
    with pytest.raises(ValueError):
        SsaModel(4, 4, method="recurrent")


def test_every_key_has_an_outcome(make, spark):
    data = with_position(make({"a": SERIES["a"], "b": SERIES["b"], "c": SERIES["c"], "d": [5.0], "e": SERIES["a"]}))
    gappy = data.withColumn("y", F.when((F.col("series_key") != "c") | (F.col("i") != 3), F.col("y")))
    routing = spark.createDataFrame([("a", "x"), ("b", "s"), ("c", "x"), ("d", "x"), ("d", "x"), ("e", "none")], "series_key string, method string")
    models = {"x": LookbackModel(7), "s": SsaModel(5, 2)}
    rows = forecast_outcomes(gappy, routing, models, 3).collect()
    failed = {r.series_key: (r.model, r.error_type, r.message) for r in rows if r.error_type}
    assert failed == {"c": ("lookback", "missing_values", "1 of 31 rows have no value"), "d": ("lookback", "too_short", "1 rows, 14 needed"),
                      "e": (None, "unknown_method", "method none")}
    assert sorted((r.series_key, r.model, r.step) for r in rows if not r.error_type) == [
        (k, m, s) for k, m in (("a", "lookback"), ("b", "ssa")) for s in (1, 2, 3)]
    assert min(r.ds for r in rows if r.series_key == "a") > START
