"""Forecast models over the brand and supplier series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from seriesmill.operators import inventory
from seriesmill.operators.evaluate import error_summary
from seriesmill.operators.forecast_run import forecast_by_method, forecast_outcomes, forecast_run
from seriesmill.operators.models import DecomposeModel, EnsembleModel, LookbackModel, SsaModel, WeightedModel, ensemble_forecast
from seriesmill.operators.models.base import UserModel
from seriesmill.operators.models.ensemble import ensemble_evaluate
from seriesmill.operators.models.lookback import one_step_predictions
from seriesmill.operators.recover import retry_prediction
from seriesmill.operators.series import fill_gaps, forecast_errors
from seriesmill.plans.base import Query, with_
from seriesmill.plans.series import DECOMPOSE_FORECAST, DECOMPOSED
from seriesmill.plans.ssa_sql import forecast_tables, moment_tables, projection_tables, recurrent_tables, rule_tables
from seriesmill.session import scratch_path
from seriesmill.sources import registry
from seriesmill.plans.tables import BRAND, FILLED, HOLEY, SUPPLIER, SUPPLIER_YEARS, TYPES, Tables

HORIZON = 14
FORECAST_COLUMNS = "series_key model step:i ds:d yhat:r lo:r hi:r"

# Brute force on purpose: the whole history is rescanned at every step.
WMA = """
wma0 AS (SELECT series_key, max(ds) AS last_ds, list(y ORDER BY i) AS h, coalesce(stddev_samp(y), 0) AS sd,
  greatest(2, least(30, count(*) // 4)) AS w, 0 AS k, CAST(NULL AS DOUBLE) AS f FROM filled GROUP BY 1),
wma AS (SELECT * FROM wma0 UNION ALL
  SELECT series_key, last_ds, list_append(h, v), sd, w, k + 1, v FROM (SELECT *, greatest(0,
    list_sum(list_transform(h[len(h) - w + 1:], lambda x, j: x * (w - j + 1))) / (w * (w + 1) / 2)
    + (k + 1) * (len(h) * list_sum(list_transform(h, lambda x, j: x * (j - 1))) - (len(h) * (len(h) - 1) / 2) * list_sum(h))
      / (len(h) * ((len(h) - 1) * len(h) * (2 * len(h) - 1) / 6.0) - (len(h) * (len(h) - 1) / 2) * (len(h) * (len(h) - 1) / 2))
    + list_avg(list_filter(h, lambda x, j: (j - 1) % 7 = (len(h) + k) % 7)) - list_avg(h)) AS v
    FROM wma WHERE k < 14)),
wma_forecast AS (SELECT series_key, 'wma' AS model, k AS step, last_ds + CAST(k AS INT) AS ds, f AS yhat,
  greatest(0, f - 1.96 * sd * sqrt(1 + (k - 1) * 0.1)) AS lo, f + 1.96 * sd * sqrt(1 + (k - 1) * 0.1) AS hi FROM wma WHERE k > 0)"""


def lookback_sql(fit: str, horizon: int = HORIZON, size: int = 14) -> str:
    """Recursive forecast from ``fit(series_key, last_ds, mean, sd, z)``."""
    return f"""
look AS (SELECT series_key, last_ds, mean, sd, z, 0 AS k, CAST(NULL AS DOUBLE) AS f FROM {fit} UNION ALL
  SELECT series_key, last_ds, mean, sd, list_append(z[2:], v), k + 1, v FROM (SELECT *, 2 * tanh(0.5 * (
    list_sum(list_transform(z, lambda x, j: x / (1 + exp(-10 * ((j - 1) / {size} - 0.5))))) + 0.2 * (z[{size}] - z[{size - 2}]))) AS v
    FROM look WHERE k < {horizon})),
look_forecast AS (SELECT series_key, 'lookback' AS model, k AS step, last_ds + CAST(k AS INT) AS ds, greatest(0, f * sd + mean) AS yhat,
  greatest(0, f * sd + mean - 0.5 * sd * (1 + sqrt(k) / sqrt(7))) AS lo,
  f * sd + mean + 0.5 * sd * (1 + sqrt(k) / sqrt(7)) AS hi FROM look WHERE k > 0)"""


def fit_sql(name: str, train: str = "i < n", window: str = "i >= n - 14", size: int = 14, minimum: int = 28) -> str:
    """Lookback fit on the ``train`` rows, window from the ``window`` rows."""
    return f"""
{name}0 AS (SELECT series_key, avg(y) FILTER ({train}) AS mean, greatest(0.1, stddev_pop(y) FILTER ({train})) AS sd,
  list(y ORDER BY i) FILTER ({window}) AS w, max(ds) FILTER ({window}) AS last_ds FROM filled GROUP BY 1
  HAVING count(*) FILTER ({train}) >= {minimum}),
{name} AS (SELECT series_key, last_ds, mean, sd, list_transform(w, lambda x: (x - mean) / sd) AS z FROM {name}0)"""


# Two lags and one component have a closed form: the angle of the leading axis.
SSA_TWO = """
pairs AS (SELECT series_key, y AS v0, lead(y) OVER (PARTITION BY series_key ORDER BY i) AS v1, i, n, ds FROM filled),
moment AS (SELECT series_key, avg(v0) AS m0, avg(v1) AS m1, covar_samp(v0, v0) AS c00, covar_samp(v0, v1) AS c01,
  covar_samp(v1, v1) AS c11 FROM pairs WHERE i < n - 1 GROUP BY 1),
axis AS (SELECT *, cos(0.5 * atan2(2 * c01, c00 - c11)) AS e0, sin(0.5 * atan2(2 * c01, c00 - c11)) AS e1 FROM moment),
rule AS (SELECT series_key, e0 * e1 AS b0, e1 * e1 AS b1, m1 - m0 * e0 * e1 - m1 * e1 * e1 AS a FROM axis),
tails AS (SELECT series_key, max(ds) AS last_ds, max(y) FILTER (i = n - 2) AS x, max(y) FILTER (i = n - 1) AS z,
  greatest(1, stddev_pop(y)) AS sd FROM filled GROUP BY 1),
ssa AS (SELECT t.series_key, last_ds, sd, a, b0, b1, x, z, 0 AS k FROM tails t JOIN rule r ON t.series_key = r.series_key UNION ALL
  SELECT series_key, last_ds, sd, a, b0, b1, z, a + b0 * x + b1 * z, k + 1 FROM ssa WHERE k < 14),
ssa_forecast AS (SELECT series_key, 'ssa' AS model, k AS step, last_ds + CAST(k AS INT) AS ds, z AS yhat,
  greatest(0, z - 1.96 * sd) AS lo, z + 1.96 * sd AS hi FROM ssa WHERE k > 0)"""

ONE_STEP = """
lagged AS (SELECT *, list(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS w FROM filled),
one_step AS (SELECT l.series_key, l.ds, l.i, l.y, mean + sd * 2 * tanh(0.5 * (
    list_sum(list_transform(w, lambda x, j: (x - mean) / sd / (1 + exp(-10 * ((j - 1) / 14 - 0.5))))) + 0.2 * (w[14] - w[12]) / sd)) AS yhat
  FROM lagged l JOIN (SELECT series_key, mean, sd FROM fit0) f ON l.series_key = f.series_key WHERE l.i >= 14)"""


def _hold_out(t: Tables):
    """Fit without the last 14 days, forecast them, join the actuals."""
    filled = t.brand_filled()
    past = filled.where(F.col("i") < F.col("n") - HORIZON).withColumn("n", F.col("n") - HORIZON)
    model = LookbackModel()
    return forecast_errors(model.predict(model.fit(past), HORIZON), filled)


def _run(model):
    return lambda t: model.predict(model.fit(t.brand_filled()), HORIZON)


_ODD_BRAND = "CAST(split_part(series_key, '#', 2) AS INT) % 2 = 1"


def _holey(model):
    """Forecast of brands of which some days have no value."""
    def build(t: Tables):
        series = fill_gaps(t.holey())
        return model.predict(model.fit(series), HORIZON)

    return build


def _routed(t: Tables):
    """Odd brand numbers by decomposition, even ones by lookback."""
    odd = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int") % 2 == 1
    routing = t.table("part").select(
        F.col("p_brand").alias("series_key"), F.when(odd, "Standard").otherwise("Advanced").alias("method")
    ).distinct()
    return forecast_by_method(t.brand_filled(), routing, {"Standard": DecomposeModel(), "Advanced": LookbackModel()}, HORIZON)


def _routed_outcomes(t: Tables):
    """Some brands name a method that does not exist, some none, and of some brands days have no value."""
    number = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")
    method = F.when(number % 5 == 1, "Deluxe").when(number % 5 == 2, "Standard").when(number % 5 == 3, "Weighted").when(number % 5 == 4, "Advanced")
    routing = t.table("part").select(F.col("p_brand").alias("series_key"), method.alias("method")).distinct()
    models = {"Standard": DecomposeModel(), "Advanced": LookbackModel(), "Weighted": WeightedModel()}
    gappy = t.brand_filled().withColumn("y", F.when((F.col("series_key") != "Brand#24") | (F.col("i") % 100 != 99), F.col("y")))
    return forecast_outcomes(gappy, routing, models, HORIZON)


_METHOD = """CASE CAST(split_part(series_key, '#', 2) AS INT) % 5 WHEN 1 THEN 'Deluxe' WHEN 2 THEN 'Standard' WHEN 3 THEN 'Weighted' WHEN 4 THEN 'Advanced' END"""
_GAPPY = "(SELECT count(*) FILTER (i % 100 = 99) FROM filled f WHERE f.series_key = k.series_key)"


def _members():
    return [DecomposeModel(), WeightedModel(), LookbackModel()]


def _registry_ensemble(t: Tables):
    """An ensemble's parameters saved and read back; the forecast is that of its members' weighted mean."""
    path = scratch_path(t.spark, "models")
    model = EnsembleModel([DecomposeModel(), WeightedModel(), LookbackModel()])
    registry.save_model(model.fit(t.brand_filled()), path, model.name, "1.0", parameters=model.parameters())
    return model.predict(registry.load_model(t.spark, path, model.name, "1.0"), 14)


def _detail(t: Tables):
    filled = t.brand_filled()
    model = DecomposeModel()
    return inventory.forecast_detail(model.predict(model.fit(filled), HORIZON), inventory.reorder_point(filled))


def _period_text(t: Tables):
    rows = _hold_out(t)
    text = inventory.period_text(*[F.col(c) for c in ("ds", "yhat", "lo", "hi", "actual", "error")])
    return rows.withColumn("line", text)


def _mean_model(pdf: pd.DataFrame, horizon: int) -> pd.DataFrame:
    """User model: mean of the last 28 days, plus and minus their deviation."""
    recent = pdf["y"].tail(28)
    days = pd.date_range(pdf["ds"].iloc[-1], periods=horizon + 1, freq="D")[1:]
    mean, sd = recent.mean(), recent.std(ddof=0)
    return pd.DataFrame({"ds": days.date, "yhat": mean, "lo": mean - sd, "hi": mean + sd})


_HOLD_OUT_SQL = (
    BRAND, FILLED, fit_sql("fit", "i < n - 14", "i >= n - 28 AND i < n - 14"), lookback_sql("fit"),
    """errors AS (SELECT p.*, f.y AS actual, CASE WHEN f.y <> 0 THEN abs((p.yhat - f.y) / f.y) END AS error
       FROM look_forecast p JOIN filled f ON p.series_key = f.series_key AND p.ds = f.ds)""",
)

QUERIES = [
    Query(
        "forecast_decompose", FORECAST_COLUMNS, _run(DecomposeModel()),
        with_(BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, select="SELECT * FROM forecast"),
    ),
    Query(
        "forecast_wma", FORECAST_COLUMNS, _run(WeightedModel()),
        with_(BRAND, FILLED, WMA, select="SELECT * FROM wma_forecast", recursive=True),
    ),
    Query(
        "forecast_lookback", FORECAST_COLUMNS, _run(LookbackModel()),
        with_(BRAND, FILLED, fit_sql("fit"), lookback_sql("fit"), select="SELECT * FROM look_forecast", recursive=True),
    ),
    Query(
        "forecast_ssa", FORECAST_COLUMNS, _run(SsaModel()),
        with_(
            BRAND, FILLED, "trained AS (SELECT series_key AS g, i, n, y FROM filled)",
            *rule_tables("rule", "trained", 7, 3), *forecast_tables("rule", 7, "true"),
            select="SELECT * FROM ssa_forecast", recursive=True,
        ),
    ),
    Query(
        "forecast_ssa_two_lags", FORECAST_COLUMNS, _run(SsaModel(2, 1)),
        with_(BRAND, FILLED, SSA_TWO, select="SELECT * FROM ssa_forecast", recursive=True),
    ),
    Query(
        "forecast_ensemble", FORECAST_COLUMNS,
        lambda t: ensemble_forecast(t.brand_filled(), _members(), HORIZON, {"decompose": 2.0, "wma": 1.0, "lookback": 1.0}),
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, WMA, fit_sql("fit"), lookback_sql("fit"),
            """stacked AS (SELECT *, 2.0 AS wt FROM forecast UNION ALL SELECT *, 1.0 FROM wma_forecast
               UNION ALL SELECT *, 1.0 FROM look_forecast)""",
            select="""SELECT series_key, 'ensemble' AS model, step, min(ds) AS ds, sum(yhat * wt) / sum(wt) AS yhat,
                      sum(lo * wt) / sum(wt) AS lo, sum(hi * wt) / sum(wt) AS hi FROM stacked GROUP BY series_key, step""",
            recursive=True,
        ),
    ),
    Query(
        "registry_ensemble", FORECAST_COLUMNS, _registry_ensemble,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, WMA, fit_sql("fit"), lookback_sql("fit"),
            "stacked AS (SELECT * FROM forecast UNION ALL SELECT * FROM wma_forecast UNION ALL SELECT * FROM look_forecast)",
            select="""SELECT series_key, 'ensemble' AS model, step, min(ds) AS ds, avg(yhat) AS yhat, avg(lo) AS lo, avg(hi) AS hi
                      FROM stacked GROUP BY series_key, step""",
            recursive=True,
        ),
    ),
    Query(
        "forecast_run", FORECAST_COLUMNS, lambda t: forecast_run(t.brand_filled(), "lookback", HORIZON),
        with_(
            BRAND, FILLED, fit_sql("fit", "i < floor(n * 0.8)"), lookback_sql("fit"),
            select="SELECT * FROM look_forecast", recursive=True,
        ),
    ),
    Query(
        "forecast_run_ssa", FORECAST_COLUMNS, lambda t: forecast_run(t.brand_filled(), "ssa", HORIZON),
        with_(
            BRAND, FILLED,
            "trained AS (SELECT series_key AS g, i, floor(n * 0.8) AS n, y FROM filled WHERE i < floor(n * 0.8))",
            *rule_tables("rule", "trained", 7, 3), *forecast_tables("rule", 7, "i < floor(n * 0.8)"),
            select="SELECT * FROM ssa_forecast", recursive=True,
        ),
    ),
    Query(
        "forecast_by_method", FORECAST_COLUMNS, _routed,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, fit_sql("fit"), lookback_sql("fit"),
            select=f"""SELECT * FROM forecast WHERE {_ODD_BRAND} UNION ALL
                       SELECT * FROM look_forecast WHERE NOT ({_ODD_BRAND})""",
            recursive=True,
        ),
    ),
    Query(
        "forecast_by_method_outcomes", "series_key model step:i ds:d yhat:r lo:r hi:r error_type message",
        lambda t: _routed_outcomes(t).withColumns({c: F.coalesce(F.col(c), F.lit("-")) for c in ("model", "error_type", "message")}).withColumns(
            {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("step", "yhat", "lo", "hi")}).withColumn("ds", F.coalesce("ds", F.lit("1970-01-01").cast("date"))),
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, fit_sql("fit"), lookback_sql("fit"), WMA.strip().removeprefix("\n"),
            f"""done AS (SELECT series_key, model, step, ds, yhat, lo, hi FROM forecast WHERE {_METHOD} = 'Standard'
                 UNION ALL SELECT series_key, model, step, ds, yhat, lo, hi FROM look_forecast WHERE {_METHOD} = 'Advanced' AND series_key <> 'Brand#24'
                 UNION ALL SELECT series_key, model, step, ds, yhat, lo, hi FROM wma_forecast WHERE {_METHOD} = 'Weighted')""",
            f"""failed AS (SELECT series_key, CASE WHEN {_METHOD} = 'Advanced' THEN 'lookback' ELSE '-' END AS model, -1 AS step, DATE '1970-01-01' AS ds, -1 AS yhat, -1 AS lo, -1 AS hi,
                 CASE WHEN {_METHOD} = 'Advanced' THEN 'missing_values' ELSE 'unknown_method' END AS error_type,
                 CASE WHEN {_METHOD} = 'Advanced' THEN {_GAPPY} || ' of ' || (SELECT count(*) FROM filled f WHERE f.series_key = k.series_key) || ' rows have no value'
                   ELSE coalesce('method ' || {_METHOD}, 'no method') END AS message
                 FROM (SELECT DISTINCT series_key FROM filled) k WHERE series_key NOT IN (SELECT series_key FROM done))""",
            select="SELECT *, '-' AS error_type, '-' AS message FROM done UNION ALL SELECT * FROM failed",
            recursive=True,
        ),
    ),
    Query(
        "forecast_ssa_recurrent", FORECAST_COLUMNS, _run(SsaModel(7, 3, method="recurrent")),
        with_(
            BRAND, FILLED, "trained AS (SELECT series_key AS g, i, n, y FROM filled)", *moment_tables("m", "trained", 7), *projection_tables("m", 3),
            *recurrent_tables("m", 7, 3), select="SELECT * FROM ssa_forecast", recursive=True,
        ),
    ),
    Query(
        "decompose_evaluate", "series_key model mape:r",
        lambda t: DecomposeModel().evaluate(DecomposeModel().fit(t.brand_filled()), t.brand_filled()),
        with_(
            BRAND, FILLED,
            """profile AS (SELECT series_key, q, m - avg(m) OVER (PARTITION BY series_key) AS s
                 FROM (SELECT series_key, i % 7 AS q, avg(y) AS m FROM filled GROUP BY ALL))""",
            """ahead AS (SELECT *, avg(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS t1,
                 avg(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS t2 FROM filled)""",
            select="""SELECT a.series_key, 'decompose' AS model, avg(abs((greatest(0, 2 * t1 - t2 + s) - y) / y)) FILTER (y > 0) AS mape
                      FROM ahead a JOIN profile p ON a.series_key = p.series_key AND i % 7 = q WHERE i >= 5 GROUP BY 1""",
        ),
    ),
    Query(
        "wma_evaluate", "series_key model mape:r",
        lambda t: WeightedModel().evaluate(WeightedModel().fit(t.brand_filled()), t.brand_filled()),
        with_(
            BRAND, FILLED,
            """rest AS (SELECT series_key, regr_slope(y, i) AS slope, avg(y) AS level, greatest(2, least(30, max(n) // 4)) AS span FROM filled GROUP BY 1)""",
            "days AS (SELECT series_key, i % 7 AS q, avg(y) AS m FROM filled GROUP BY ALL)",
            """ahead AS (SELECT *, list(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS w FROM filled)""",
            select="""SELECT a.series_key, 'wma' AS model, avg(abs((greatest(0,
                        list_sum(list_transform(w[len(w) - span + 1:], lambda x, j: x * (span - j + 1))) / (span * (span + 1) / 2) + slope + m - level) - y) / y))
                        FILTER (y > 0) AS mape
                      FROM ahead a JOIN rest r ON a.series_key = r.series_key JOIN days d ON a.series_key = d.series_key AND i % 7 = q
                      WHERE i >= 30 GROUP BY 1""",
        ),
    ),
    Query(
        "forecast_run_decompose", FORECAST_COLUMNS, lambda t: forecast_run(t.brand_filled(), "decompose", HORIZON),
        with_(BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, select="SELECT * FROM forecast"),
    ),
    Query(
        "missing_values_decompose", FORECAST_COLUMNS, _holey(DecomposeModel()),
        with_(HOLEY, FILLED, DECOMPOSED, DECOMPOSE_FORECAST, select="SELECT * FROM forecast"),
    ),
    Query(
        "missing_values_wma", FORECAST_COLUMNS, _holey(WeightedModel()),
        with_(HOLEY, FILLED, WMA, select="SELECT * FROM wma_forecast", recursive=True),
    ),
    Query(
        "missing_values_lookback", FORECAST_COLUMNS, _holey(LookbackModel()),
        with_(HOLEY, FILLED, fit_sql("fit"), lookback_sql("fit"), select="SELECT * FROM look_forecast", recursive=True),
    ),
    Query(
        "forecast_skipped_keys", "series_key model error_type message",
        lambda t: LookbackModel().skipped(t.holey()).unionByName(SsaModel(30, 3).skipped(t.supplier_years())),
        f"""SELECT series_key, 'lookback' AS model, 'missing_values' AS error_type, m || ' of ' || n || ' rows have no value' AS message
            FROM ({with_(HOLEY, select="SELECT series_key, count(*) AS n, count(*) - count(y) AS m FROM series GROUP BY 1")}) AS holes WHERE m > 0
            UNION ALL SELECT series_key, 'ssa', 'too_short', n || ' rows, 60 needed'
            FROM ({with_(SUPPLIER_YEARS, select="SELECT series_key, count(*) AS n FROM series GROUP BY 1")}) AS years WHERE n < 60""",
    ),
    Query(
        "predict_after_refit", FORECAST_COLUMNS,
        lambda t: retry_prediction(t.brand_filled(), "not_fitted", LookbackModel(), HORIZON),
        with_(
            BRAND, FILLED, fit_sql("fit"), lookback_sql("fit"), select="SELECT * FROM look_forecast", recursive=True,
        ),
    ),
    Query(
        "one_step_eval", "series_key ds:d y:r yhat:r",
        lambda t: one_step_predictions(LookbackModel(), LookbackModel().fit(t.brand_filled()), t.brand_filled()),
        with_(BRAND, FILLED, fit_sql("fit"), ONE_STEP, select="SELECT * FROM one_step"),
    ),
    Query(
        "lookback_evaluate", "series_key model mape:r",
        lambda t: LookbackModel().evaluate(LookbackModel().fit(t.brand_filled()), t.brand_filled()),
        with_(
            BRAND, FILLED, fit_sql("fit"), ONE_STEP,
            select="""SELECT series_key, 'lookback' AS model, avg(abs((yhat - y) / y)) FILTER (y > 0) AS mape
                      FROM one_step GROUP BY 1""",
        ),
    ),
    Query(
        "ssa_evaluate_two_lags", "series_key model mape:r",
        lambda t: SsaModel(2, 1).evaluate(SsaModel(2, 1).fit(t.brand_filled()), t.brand_filled()),
        with_(
            BRAND, FILLED, SSA_TWO,
            """l AS (SELECT *, lag(y, 2) OVER (PARTITION BY series_key ORDER BY i) AS w0,
                 lag(y) OVER (PARTITION BY series_key ORDER BY i) AS w1 FROM filled)""",
            select="""SELECT l.series_key, 'ssa' AS model, avg(abs((a + b0 * w0 + b1 * w1 - y) / y)) FILTER (y > 0 AND l.i >= 2) AS mape
                      FROM l JOIN rule ON l.series_key = rule.series_key GROUP BY 1""",
            recursive=True,
        ),
    ),
    Query(
        "ssa_evaluate", "series_key model mape:r",
        lambda t: SsaModel().evaluate(SsaModel().fit(t.brand_filled()), t.brand_filled()),
        with_(
            BRAND, FILLED, "trained AS (SELECT series_key AS g, i, n, y FROM filled)", *rule_tables("rule", "trained", 7, 3),
            """l AS (SELECT *, list(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS h FROM filled)""",
            select="""SELECT series_key, 'ssa' AS model,
                      avg(abs((a + list_sum(list_transform(h, lambda x, j: x * w[j])) - y) / y)) FILTER (y > 0) AS mape
                      FROM l JOIN rule ON series_key = g WHERE i >= 7 GROUP BY 1""",
        ),
    ),
    Query(
        "ensemble_evaluate", "series_key mape:r",
        lambda t: ensemble_evaluate(t.types(), [DecomposeModel(), LookbackModel()]),
        with_(
            TYPES,
            """placed AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS i,
                 count(*) OVER (PARTITION BY series_key) - 1 AS n FROM series)""",
            "filled AS (SELECT * FROM placed WHERE i < n)",
            DECOMPOSED, DECOMPOSE_FORECAST, fit_sql("fit"), lookback_sql("fit", 1),
            "last AS (SELECT series_key, y AS actual FROM placed WHERE i = n)",
            """both_models AS (SELECT series_key, avg(yhat) AS yhat FROM (SELECT series_key, yhat FROM forecast WHERE step = 1
                 UNION ALL SELECT series_key, yhat FROM look_forecast) GROUP BY 1)""",
            select="""SELECT b.series_key, avg(abs((yhat - actual) / actual)) FILTER (actual > 0) AS mape
                      FROM both_models b JOIN last ON b.series_key = last.series_key GROUP BY 1""",
            recursive=True,
        ),
    ),
    Query(
        "forecast_errors", "series_key step:i ds:d yhat:r actual:r known:b error:r",
        lambda t: _hold_out(t).withColumns({
            "known": F.col("error").isNotNull(), "error": F.coalesce("error", F.lit(-1.0)),
        }),
        with_(*_HOLD_OUT_SQL, select="SELECT * REPLACE (coalesce(error, -1) AS error), error IS NOT NULL AS known FROM errors", recursive=True),
    ),
    Query(
        "forecast_error_summary", "series_key n:i mape:r rmse:r mae:r", lambda t: error_summary(_hold_out(t)),
        with_(
            *_HOLD_OUT_SQL,
            select="""SELECT series_key, count(*) AS n, avg(abs((yhat - actual) / actual)) FILTER (actual > 0) AS mape,
                      sqrt(avg((actual - yhat) * (actual - yhat))) AS rmse, avg(abs(actual - yhat)) AS mae FROM errors GROUP BY 1""",
            recursive=True,
        ),
    ),
    Query(
        "forecast_detail", "series_key period forecasted_demand:r lower_bound:r upper_bound:r reorder_point:r", _detail,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST,
            "rop AS (SELECT series_key, avg(y) * 3 + 1.65 * stddev_samp(y) * sqrt(3) AS r FROM filled GROUP BY 1)",
            select="""SELECT f.series_key, strftime(ds, '%Y-%m-%d') AS period, round(yhat, 2) AS forecasted_demand,
                      round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound, round(r, 2) AS reorder_point
                      FROM forecast f JOIN rop ON f.series_key = rop.series_key""",
        ),
    ),
    Query(
        "forecast_period_text", "series_key step:i line", _period_text,
        with_(
            *_HOLD_OUT_SQL,
            select="""SELECT series_key, step, printf('%s: Forecast=%.2f, Bounds=[%.2f, %.2f]', strftime(ds, '%Y-%m-%d'), yhat, lo, hi)
                      || CASE WHEN error IS NOT NULL THEN printf(', Actual=%.2f, Error=%.2f%%', actual, error * 100) ELSE '' END AS line
                      FROM errors""",
            recursive=True,
        ),
    ),
    Query(
        "user_model", FORECAST_COLUMNS, lambda t: UserModel("mean28", _mean_model).run(t.supplier_filled(), 7)[0],
        with_(
            SUPPLIER, FILLED,
            """recent AS (SELECT series_key, max(ds) AS last_ds, avg(y) FILTER (i >= n - 28) AS m,
                 stddev_pop(y) FILTER (i >= n - 28) AS sd FROM filled GROUP BY 1)""",
            select="""SELECT series_key, 'mean28' AS model, step, last_ds + CAST(step AS INT) AS ds, m AS yhat, m - sd AS lo, m + sd AS hi
                      FROM recent CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS step) h""",
        ),
    ),
]
