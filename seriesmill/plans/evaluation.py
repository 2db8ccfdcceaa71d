"""Weights, folds, grids and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import evaluate, recover, tune
from seriesmill.operators.models import DecomposeModel, EnsembleModel, LookbackModel, SsaModel, WeightedModel, performance_weights
from seriesmill.plans.base import Query, with_
from seriesmill.plans.ssa_sql import moment_tables, projection_tables, rule_table
from seriesmill.plans.tables import BRAND, FILLED, SUPPLIER_YEARS, Tables

LOOKBACKS = (7, 14, 21)
FOLDS = 5
SSA_GRID = {"window": [5, 7, 10], "components": [1, 3]}
SSA_SETTINGS = [(p["window"], p["components"]) for p in tune.parameter_sets(SSA_GRID)]


def fold_sql(order: str = "i") -> str:
    return f"folded AS (SELECT *, ntile({FOLDS}) OVER (PARTITION BY series_key ORDER BY {order}) - 1 AS fold FROM filled)"


def scores_sql(sizes: tuple[int, ...], order: str = "i") -> str:
    """Fold errors of the lookback model, each size on its own."""
    parts = []
    for g, size in enumerate(sizes):
        parts.append(f"""SELECT {g} AS grid_id, l.series_key, l.fold, avg(abs((mean + sd * 2 * tanh(0.5 * (
          list_sum(list_transform(w, lambda x, j: (x - mean) / sd / (1 + exp(-10 * ((j - 1) / {size} - 0.5)))))
          + 0.2 * (w[{size}] - w[{size - 2}]) / sd)) - y) / y)) FILTER (y > 0) AS mape
          FROM (SELECT *, row_number() OVER (PARTITION BY series_key, fold ORDER BY {order}) - 1 AS p,
            list(y) OVER (PARTITION BY series_key, fold ORDER BY {order} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS w FROM folded) l
          JOIN train t ON l.series_key = t.series_key AND l.fold = t.fold WHERE p >= {size} GROUP BY 1, 2, 3""")
    return f"""
train AS (SELECT a.series_key, h.fold, avg(y) AS mean, greatest(0.1, stddev_pop(y)) AS sd
  FROM folded a CROSS JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS fold) h WHERE a.fold <> h.fold GROUP BY 1, 2),
scores AS ({' UNION ALL '.join(parts)})"""


def ssa_scores_sql(settings: list[tuple[int, int]]) -> list[str]:
    """Fold errors of singular-spectrum settings ``(window, components)`` on contiguous folds."""
    parts = [f"""
trained AS MATERIALIZED (SELECT f.series_key || '|' || h.fold AS g, f.y,
  row_number() OVER (PARTITION BY f.series_key, h.fold ORDER BY f.i) - 1 AS i, count(*) OVER (PARTITION BY f.series_key, h.fold) AS n
  FROM folded f CROSS JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS fold) h WHERE f.fold <> h.fold)"""]
    scores = []
    for size in sorted({window for window, _ in settings}):
        chosen = [(g, c) for g, (window, c) in enumerate(settings) if window == size]
        name = f"m{size}"
        parts += moment_tables(name, "trained", size) + projection_tables(name, max(c for _, c in chosen))
        for g, components in chosen:
            parts.append(rule_table(name, f"rule{g}", size, components))
            scores.append(f"""SELECT {g} AS grid_id, series_key, fold,
              avg(abs((a + list_sum(list_transform(h, lambda x, j: x * w[j])) - y) / y)) FILTER (y > 0) AS mape
              FROM (SELECT *, row_number() OVER (PARTITION BY series_key, fold ORDER BY i) - 1 AS p,
                list(y) OVER (PARTITION BY series_key, fold ORDER BY i ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS h FROM folded) v
              JOIN rule{g} ON g = series_key || '|' || fold WHERE p >= {size} GROUP BY 1, 2, 3""")
    return [*parts, f"scores AS ({' UNION ALL '.join(scores)})"]


# Rows of the other folds, numbered anew: what the models are fitted to when one fold is left out.
TRAINED = f"""
trained AS MATERIALIZED (SELECT f.series_key, h.fold, f.y,
  row_number() OVER (PARTITION BY f.series_key, h.fold ORDER BY f.i) - 1 AS p, count(*) OVER (PARTITION BY f.series_key, h.fold) AS n
  FROM folded f CROSS JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS fold) h WHERE f.fold <> h.fold)"""

PROFILES = """
profiles AS (SELECT series_key, fold, q, m - avg(m) OVER (PARTITION BY series_key, fold) AS s
  FROM (SELECT series_key, fold, p % 7 AS q, avg(y) AS m FROM trained GROUP BY ALL))"""


def decompose_scores_sql(windows: tuple[int, ...]) -> str:
    """Fold errors of the decomposition: the trend continued by its last step, and the profile of the other folds."""
    before = lambda rows: f"avg(y) OVER (PARTITION BY series_key, fold ORDER BY i ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    parts = [f"""SELECT {g} AS grid_id, v.series_key, v.fold,
          avg(abs((greatest(0, 2 * t1 - t2 + s) - y) / y)) FILTER (y > 0) AS mape
          FROM (SELECT *, row_number() OVER (PARTITION BY series_key, fold ORDER BY i) - 1 AS pos, {before(w // 2 + 1)} AS t1, {before(w // 2 + 2)} AS t2
            FROM folded) v
          JOIN profiles r ON v.series_key = r.series_key AND v.fold = r.fold AND v.i % 7 = q WHERE pos >= {w // 2 + 2} GROUP BY ALL"""
             for g, w in enumerate(windows)]
    return f"scores AS ({' UNION ALL '.join(parts)})"


WEIGHTED_SCORES = """
rest AS (SELECT series_key, fold, regr_slope(y, p) AS slope, avg(y) AS level, greatest(2, least(30, max(n) // 4)) AS span FROM trained GROUP BY ALL),
days AS (SELECT series_key, fold, p % 7 AS q, avg(y) AS m FROM trained GROUP BY ALL),
scores AS (SELECT 0 AS grid_id, v.series_key, v.fold, avg(abs((greatest(0,
    list_sum(list_transform(w[len(w) - span + 1:], lambda x, j: x * (span - j + 1))) / (span * (span + 1) / 2) + slope + m - level) - y) / y)) FILTER (y > 0) AS mape
  FROM (SELECT *, row_number() OVER (PARTITION BY series_key, fold ORDER BY i) - 1 AS pos,
      list(y) OVER (PARTITION BY series_key, fold ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS w FROM folded) v
    JOIN rest r ON v.series_key = r.series_key AND v.fold = r.fold JOIN days d ON v.series_key = d.series_key AND v.fold = d.fold AND v.i % 7 = q
  WHERE pos >= 30 GROUP BY ALL)"""

ENSEMBLE_SCORES = """
rest AS (SELECT series_key, fold, regr_slope(y, p) AS slope, avg(y) AS level, greatest(2, least(30, max(n) // 4)) AS span FROM trained GROUP BY ALL),
days AS (SELECT series_key, fold, p % 7 AS q, avg(y) AS m FROM trained GROUP BY ALL),
windows AS (SELECT *, row_number() OVER (PARTITION BY series_key, fold ORDER BY i) - 1 AS pos,
  list(y) OVER (PARTITION BY series_key, fold ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS w FROM folded),
both_models AS (SELECT v.series_key, v.fold, y,
    greatest(0, 2 * list_avg(w[len(w) - 3:]) - list_avg(w[len(w) - 4:]) + s) AS a,
    greatest(0, list_sum(list_transform(w[len(w) - span + 1:], lambda x, j: x * (span - j + 1))) / (span * (span + 1) / 2) + slope + m - level) AS b
  FROM windows v JOIN rest r ON v.series_key = r.series_key AND v.fold = r.fold JOIN days d ON v.series_key = d.series_key AND v.fold = d.fold AND v.i % 7 = d.q
    JOIN profiles f ON v.series_key = f.series_key AND v.fold = f.fold AND v.i % 7 = f.q WHERE pos >= 30),
scores AS (SELECT 0 AS grid_id, series_key, fold, avg(abs(((3 * a + b) / 4 - y) / y)) FILTER (y > 0) AS mape FROM both_models GROUP BY ALL)"""

SUMMARY = """
summary AS (SELECT series_key, grid_id, avg(mape) AS mean_mape, coalesce(stddev_samp(mape), 0) AS sd_mape, count(mape) AS num_folds,
  array_to_string(list(CAST(CAST(round(mape * 1000) AS BIGINT) AS VARCHAR) ORDER BY fold) FILTER (mape IS NOT NULL), ',') AS fold_results
  FROM scores GROUP BY 1, 2)"""

SHUFFLED = "(i * 1103515245 + 42 * 12345) % 2147483648, i"


def _listed(df):
    text = F.transform("fold_results", lambda m: F.round(m * 1000).cast("bigint").cast("string"))
    return df.withColumn("fold_results", F.array_join(text, ","))


def _grid():
    return tune.grid_models("lookback", {"lookback": list(LOOKBACKS)})


def _ssa_grid():
    return tune.grid_models("ssa", SSA_GRID)


def _weights(t: Tables):
    """Three lookback lengths scored on the last 20 % of each brand."""
    filled = t.brand_filled()
    cut = F.floor(F.col("n") * 0.8).cast("int")
    train = filled.where(F.col("i") < cut).withColumn("n", cut)
    recent = filled.where(F.col("i") >= cut).withColumns({"i": F.col("i") - cut, "n": F.col("n") - cut})
    models = [LookbackModel(size) for size in LOOKBACKS]
    scores = None
    for model in models:
        one = model.evaluate(model.fit(train), recent).withColumn("model", F.lit(f"lookback{model.lookback}"))
        scores = one if scores is None else scores.unionByName(one)
    return performance_weights(scores)


def _weights_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT l.series_key, 'lookback{size}' AS model, avg(abs((mean + sd * 2 * tanh(0.5 * (
          list_sum(list_transform(w, lambda x, j: (x - mean) / sd / (1 + exp(-10 * ((j - 1) / {size} - 0.5)))))
          + 0.2 * (w[{size}] - w[{size - 2}]) / sd)) - y) / y)) FILTER (y > 0) AS mape
          FROM (SELECT *, list(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS w FROM recent) l
          JOIN fit f ON l.series_key = f.series_key WHERE l.i >= floor(l.n * 0.8) + {size} GROUP BY 1"""
        for size in LOOKBACKS
    )
    return with_(
        BRAND, FILLED,
        """fit AS (SELECT series_key, avg(y) AS mean, greatest(0.1, stddev_pop(y)) AS sd FROM filled WHERE i < floor(n * 0.8) GROUP BY 1)""",
        "recent AS (SELECT * FROM filled WHERE i >= floor(n * 0.8))",
        f"scores AS ({parts})",
        select="""SELECT series_key, model, mape, (1 / (1 + mape)) / sum(1 / (1 + mape)) OVER (PARTITION BY series_key) AS weight
                  FROM scores""",
    )


def _report(t: Tables):
    """Supplier years with a few negatives; lookback 30 needs 60 days, which the last year has not."""
    return recover.fit_with_recovery(t.supplier_years(), "lookback", {"lookback": 14}, lookback=30)[1]


REPORT = """
counted AS (SELECT series_key, count(*) AS n, count(*) FILTER (y >= 0) AS v FROM series GROUP BY 1),
failed AS (SELECT *, CASE WHEN v < n THEN 'invalid_values' WHEN n < 60 THEN 'invalid_parameters' END AS error_type FROM counted),
rows_kept AS (SELECT *, CASE error_type WHEN 'invalid_values' THEN CASE WHEN v >= n * 0.9 AND v >= 60 THEN v ELSE 0 END
  ELSE CASE WHEN n >= 28 THEN n ELSE 0 END END AS kept FROM failed WHERE error_type IS NOT NULL),
report AS (SELECT series_key, error_type, CASE error_type WHEN 'invalid_values' THEN 'clean' ELSE 'fallback' END AS action,
  kept > 0 AS recovered, kept AS rows_used, 'lookback=' || CASE error_type WHEN 'invalid_values' THEN 30 ELSE 14 END AS parameters FROM rows_kept)"""

_FOLD_COLUMNS = "series_key ds:d o:i fold:i fold_start:i fold_size:i"


def _folds_sql(order: str) -> str:
    return with_(
        BRAND, FILLED, fold_sql(order),
        f"ordered AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY {order}) - 1 AS o FROM folded)",
        select="""SELECT *, min(o) OVER (PARTITION BY series_key, fold) AS fold_start,
                  count(*) OVER (PARTITION BY series_key, fold) AS fold_size FROM ordered""",
    )


TREND_WINDOWS = (5, 7, 9)


QUERIES = [
    Query(
        "cross_validate_decompose", "series_key mean_mape:r sd_mape:r num_folds:i fold_results",
        lambda t: _listed(evaluate.cross_validate(t.brand_filled(), DecomposeModel(), FOLDS)),
        with_(BRAND, FILLED, fold_sql(), TRAINED, PROFILES, decompose_scores_sql((7,)), SUMMARY, select="SELECT * FROM summary"),
    ),
    Query(
        "grid_search_decompose", "series_key grid_id:i trend_window:i mean_mape:r rank:i",
        lambda t: tune.grid_search(t.brand_filled(), tune.grid_models("decompose", {"window": list(TREND_WINDOWS)}), FOLDS).withColumn(
            "trend_window", F.col("parameters")["window"]),
        with_(
            BRAND, FILLED, fold_sql(), TRAINED, PROFILES, decompose_scores_sql(TREND_WINDOWS), SUMMARY,
            select="""SELECT *, 5 + 2 * grid_id AS trend_window,
                      row_number() OVER (PARTITION BY series_key ORDER BY mean_mape NULLS LAST, grid_id) AS rank FROM summary""",
        ),
    ),
    Query(
        "cross_validate_wma", "series_key mean_mape:r sd_mape:r num_folds:i",
        lambda t: evaluate.cross_validate(t.brand_filled(), WeightedModel(), FOLDS),
        with_(BRAND, FILLED, fold_sql(), TRAINED, WEIGHTED_SCORES, SUMMARY, select="SELECT * FROM summary"),
    ),
    Query(
        "ensemble_cross_validate", "series_key mean_mape:r sd_mape:r num_folds:i",
        lambda t: evaluate.cross_validate(t.brand_filled(), EnsembleModel([DecomposeModel(), WeightedModel()], {"decompose": 3.0}), FOLDS),
        with_(BRAND, FILLED, fold_sql(), TRAINED, PROFILES, ENSEMBLE_SCORES, SUMMARY, select="SELECT * FROM summary"),
    ),
    Query("ensemble_weights", "series_key model mape:r weight:r", _weights, _weights_sql()),
    Query("cv_folds", _FOLD_COLUMNS, lambda t: evaluate.cv_folds(t.brand_filled(), FOLDS), _folds_sql("i")),
    Query(
        "cv_folds_shuffled", _FOLD_COLUMNS, lambda t: evaluate.cv_folds(t.brand_filled(), FOLDS, shuffle=True),
        _folds_sql(SHUFFLED),
    ),
    Query(
        "cross_validate", "series_key mean_mape:r sd_mape:r num_folds:i fold_results",
        lambda t: _listed(evaluate.cross_validate(t.brand_filled(), LookbackModel(14), FOLDS)),
        with_(BRAND, FILLED, fold_sql(), scores_sql((14,)), SUMMARY, select="SELECT * FROM summary"),
    ),
    Query(
        "cross_validate_shuffled", "series_key mean_mape:r sd_mape:r num_folds:i",
        lambda t: evaluate.cross_validate(t.brand_filled(), LookbackModel(14), FOLDS, shuffle=True),
        with_(BRAND, FILLED, fold_sql(SHUFFLED), scores_sql((14,), SHUFFLED), SUMMARY, select="SELECT * FROM summary"),
    ),
    Query(
        "cross_validate_ssa", "series_key mean_mape:r sd_mape:r num_folds:i",
        lambda t: evaluate.cross_validate(t.brand_filled(), SsaModel(), FOLDS),
        with_(BRAND, FILLED, fold_sql(), *ssa_scores_sql([(7, 3)]), SUMMARY, select="SELECT * FROM summary"),
    ),
    Query(
        "grid_search", "series_key grid_id:i lookback:i mean_mape:r sd_mape:r num_folds:i rank:i",
        lambda t: tune.grid_search(t.brand_filled(), _grid(), FOLDS).withColumn("lookback", F.col("parameters")["lookback"]),
        with_(
            BRAND, FILLED, fold_sql(), scores_sql(LOOKBACKS), SUMMARY,
            select="""SELECT *, 7 + 7 * grid_id AS lookback,
                      row_number() OVER (PARTITION BY series_key ORDER BY mean_mape NULLS LAST, grid_id) AS rank FROM summary""",
        ),
    ),
    Query(
        "best_params", "series_key grid_id:i lookback:i mean_mape:r",
        lambda t: tune.best_parameters(t.brand_filled(), _grid(), FOLDS).withColumn("lookback", F.col("parameters")["lookback"]),
        with_(
            BRAND, FILLED, fold_sql(), scores_sql(LOOKBACKS), SUMMARY,
            select="""SELECT *, 7 + 7 * grid_id AS lookback FROM summary
                      QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY mean_mape NULLS LAST, grid_id) = 1""",
        ),
    ),
    Query(
        "grid_search_ssa", "series_key grid_id:i window_size:i components:i mean_mape:r rank:i",
        lambda t: tune.grid_search(t.brand_filled(), _ssa_grid(), FOLDS).withColumns({
            "window_size": F.col("parameters")["window"], "components": F.col("parameters")["components"],
        }),
        with_(
            BRAND, FILLED, fold_sql(), *ssa_scores_sql(SSA_SETTINGS), SUMMARY,
            select="""SELECT *, [5, 5, 7, 7, 10, 10][grid_id + 1] AS window_size, [1, 3, 1, 3, 1, 3][grid_id + 1] AS components,
                      row_number() OVER (PARTITION BY series_key ORDER BY mean_mape NULLS LAST, grid_id) AS rank FROM summary""",
        ),
    ),
    Query(
        "recover_failed", "series_key error_type action recovered:b rows_used:i parameters", _report,
        with_(SUPPLIER_YEARS, REPORT, select="SELECT * FROM report"),
    ),
    Query(
        "error_stats", "error_type attempts:i recovered:i open_attempts:i", lambda t: recover.error_statistics(_report(t)),
        with_(
            SUPPLIER_YEARS, REPORT,
            select="""SELECT error_type, count(*) AS attempts, count(*) FILTER (recovered) AS recovered,
                      count(*) FILTER (NOT recovered) AS open_attempts FROM report GROUP BY 1""",
        ),
    ),
]
