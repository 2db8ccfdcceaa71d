"""Grid search: every parameter set, fold and series in one job."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.lookups import within_limits
from seriesmill.functions.metrics import mape
from seriesmill.operators.evaluate import cv_folds, summarise_folds
from seriesmill.operators.models.base import get_model
from seriesmill.operators.models.lookback import SD_FLOOR
from seriesmill.operators.models.ssa import SsaModel, solve_folds
from seriesmill.operators.series import KEY, in_order, with_position
from seriesmill.operators.stats import PERIOD, fold_sums, lag_names, lagged, over


def parameter_sets(grid: dict[str, list]) -> list[dict]:
    """All combinations, in grid order (last parameter runs fastest)."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_models(name: str, grid: dict[str, list]) -> list:
    return [get_model(name, **p) for p in parameter_sets(grid)]


BY_FOLD = (KEY, "fold")


def _with_ssa_fits(folds: DataFrame, models: list) -> DataFrame:
    """Fold rows with ``_fit0, _fit1, …``, null where the training series is too short.

    Sums of products per fold give the lag covariance without any one of them, and those of the longest window serve
    every parameter set.  The fits of a key (one per fold) come back as a single row, so that the fold rows are joined by
    key, where they already lie.
    """
    longest = max(m.window for m in models)
    solved = solve_folds(fold_sums(folds, longest), [(m.window, m.components) for m in models], longest)
    return folds.join(solved, KEY, "left").select(*folds.columns, *[F.expr(f"_fits[fold][{g}] AS _fit{g}") for g in range(len(models))])


def _rest_sums(values: dict[str, str]) -> dict[str, Column]:
    """``{name}_a`` and ``{name}_b``: sums over the folds before and behind a row's own."""
    frame = f"(PARTITION BY {KEY} ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND"
    found = {}
    for name, value in values.items():
        found[f"{name}_a"] = F.expr(f"coalesce(sum({value}) OVER {frame} 1 PRECEDING), 0D)")
        found[f"{name}_b"] = F.expr(f"sum({value}) {over()} - sum({value}) OVER {frame} CURRENT ROW)")
    return found


def _with_position_fits(folds: DataFrame, models: list) -> DataFrame:
    """Fold rows with ``_fit0, _fit1, …`` for models of position sums, slope and level.

    Without a fold the rows behind it move up by its size, so their position sums are turned by the size modulo the period before
    they are added to those in front, and their positions count by so much less.
    """
    period = PERIOD
    values = {f"_s{p}": f"CASE WHEN o % {period} = {p} THEN y ELSE 0D END" for p in range(period)}
    values |= {"_y": "y", "_iy": "CAST(o AS DOUBLE) * y"}
    summed = folds.withColumns(_rest_sums(values)).withColumn("_gaps", F.expr(f"count_if(y IS NULL OR isnan(y)) {over()}"))
    turned = f"array({', '.join(f'_s{p}_b' for p in range(period))})"
    sums = ", ".join(f"_s{p}_a + {turned}[({p} + fold_size) % {period}]" for p in range(period))
    rest = summed.withColumn("_left", F.expr("n - fold_size")).withColumns({
        "_sums": F.expr(f"array({sums})"), "_sy": F.expr("_y_a + _y_b"), "_siy": F.expr("_iy_a + _iy_b - fold_size * _y_b"),
    })
    means = f"transform(_sums, (s, p) -> coalesce(try_divide(s, floor((_left - p + {period - 1}) / {period})), 0D))"
    rest = rest.withColumn("_means", F.expr(means))
    fits = [F.expr(f"CASE WHEN _gaps = 0 AND _left >= {m.min_rows} THEN {m.rest_fit()} END AS _fit{g}") for g, m in enumerate(models)]
    return rest.select(*folds.columns, *fits)


def _with_scaling_fits(folds: DataFrame, models: list) -> DataFrame:
    """Fold rows with ``_fit0, _fit1, …`` for models that only need mean and deviation.

    Sums over the other folds are those of the key minus those of the fold, taken
    around the mean of the key to keep the subtraction exact.
    """
    centred = folds.withColumn("_level", F.expr(f"avg(y) {over()}")).withColumn("_c", F.expr("y - _level"))
    rest = {
        name: F.expr(f"sum({value}) {over()} - sum({value}) {over(keys=BY_FOLD)}")
        for name, value in {"_k": "1", "_s": "_c", "_q": "_c * _c"}.items()
    }
    shift = "try_divide(_s, _k)"
    spread = f"sqrt(greatest(0D, try_divide(_q, _k) - {shift} * {shift}))"
    fit = f"struct(_level + {shift} AS mean, greatest({SD_FLOOR}D, {spread}) AS sd)"
    fits = [F.expr(f"CASE WHEN _k >= {m.min_rows} THEN {fit} END AS _fit{g}") for g, m in enumerate(models)]
    return centred.withColumns(rest).select(*folds.columns, *fits)


def _with_fits(folds: DataFrame, models: list) -> DataFrame:
    """Fold rows with ``_fit0, _fit1, …`` of models of any kinds; an ensemble's fit holds those of its members."""
    single = [m for model in models for m in getattr(model, "members", [model])]
    if any(isinstance(m, SsaModel) and m.method != "last" for m in single):
        raise ValueError("folds are scored with the last-value rule")
    kinds = [
        (_with_ssa_fits, lambda m: isinstance(m, SsaModel)), (_with_position_fits, lambda m: hasattr(m, "rest_fit")),
        (_with_scaling_fits, lambda m: not isinstance(m, SsaModel) and not hasattr(m, "rest_fit"))]
    found = folds
    for make, of_kind in kinds:
        chosen = [k for k, m in enumerate(single) if of_kind(m)]
        if chosen:
            found = make(found, [single[k] for k in chosen]).withColumnsRenamed({f"_fit{g}": f"_own{k}" for g, k in enumerate(chosen)})
    fits, at = {}, 0
    for g, model in enumerate(models):
        own = [F.col(f"_own{at + k}") for k in range(len(getattr(model, "members", [model])))]
        at += len(own)
        every = reduce(lambda a, b: a & b, [c.isNotNull() for c in own])
        fits[f"_fit{g}"] = F.when(every, F.struct(*[c.alias(f"m{k}") for k, c in enumerate(own)])) if hasattr(model, "members") else own[0]
    return found.select(*folds.columns, *[c.alias(n) for n, c in fits.items()])


def grid_scores(series: DataFrame, models: list, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Rows ``key, grid_id, fold, mape`` for models of any kinds.

    The parameters without a fold come from sums over the others; no row is copied.  Validation rows are windowed once for the longest look-back; each model is
    one more aggregate column, so rows are not multiplied by the grid.
    """
    k = within_limits(k, "folds")
    folds = cv_folds(with_position(series).where(F.col("n") >= 2 * k), k, shuffle, seed).select(
        KEY, "ds", "y", "n", "o", "fold", "fold_start", "fold_size"
    )
    longest = max(m.look_back for m in models)
    fitted = _with_fits(folds, models)
    fits = [f"_fit{g}" for g in range(len(models))]
    windows = fitted.select(
        KEY, "fold", "o", "y", (F.col("o") - F.col("fold_start")).alias("_at"), *fits, *lagged(longest, "o", BY_FOLD)
    )
    scored = windows.groupBy(*BY_FOLD).agg(*[
        mape(F.when(F.col("_at") >= m.look_back, m.one_step(lag_names(longest), fit, "o")), F.col("y")).alias(f"_m{g}")
        for g, (m, fit) in enumerate(zip(models, fits))
    ])
    cells = F.expr("array(" + ", ".join(f"struct({g} AS grid_id, _m{g} AS mape)" for g in range(len(models))) + ")")
    return scored.select(KEY, "fold", F.explode(cells).alias("_cell")).select(KEY, "_cell.grid_id", "fold", "_cell.mape")


def _with_parameters(scores: DataFrame, models: list) -> DataFrame:
    texts = [F.create_map(*[F.lit(x) for pair in m.parameters().items() for x in pair]) for m in models]
    return scores.withColumn("parameters", F.get(F.array(*texts), F.col("grid_id")))


def grid_search(series: DataFrame, models: list, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Every parameter set with its fold summary and its rank within the key."""
    summary = summarise_folds(grid_scores(series, models, k, shuffle, seed), "grid_id")
    worst_last = F.col("mean_mape").isNull()
    order = in_order("_order")
    ranked = summary.withColumn("_order", F.struct(worst_last, F.col("mean_mape"), F.col("grid_id")))
    return _with_parameters(ranked.withColumn("rank", F.row_number().over(order)).drop("_order"), models)


def best_parameters(series: DataFrame, models: list, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Lowest mean error per key; sets that failed lose, ties go to the first set."""
    summary = summarise_folds(grid_scores(series, models, k, shuffle, seed), "grid_id")
    order = F.struct(F.col("mean_mape").isNull(), F.col("mean_mape"), F.col("grid_id"))
    best = summary.groupBy(KEY).agg(F.min_by(F.struct("grid_id", "mean_mape"), order).alias("_b"))
    return _with_parameters(best.select(KEY, "_b.*"), models)
