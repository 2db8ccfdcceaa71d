"""Fit on the first part of each series, forecast from its newest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.arrays import last_values
from seriesmill.operators.models.base import check_horizon, fit_side_by_side, get_model
from seriesmill.operators.series import KEY, missing, train_test_split, with_position


def forecast_run(series: DataFrame, model="lookback", horizon: int = 14, share: float = 0.8, **parameters) -> DataFrame:
    """Models that forecast from a window of values: fit on the first ``share``, predict from the last values of all.

    Other models carry their level, so they are fitted on all rows.  The newest window is the recent part, topped up with training rows when the
    recent part is shorter than the window - which is the tail of the whole series.
    """
    check_horizon(horizon)
    fitted = get_model(model, **parameters) if isinstance(model, str) else model
    if not fitted.rewindows:
        return fitted.predict(fitted.fit(with_position(series)), horizon)
    marked = train_test_split(with_position(series), share)
    cut = F.floor(F.col("n") * F.lit(share)).cast("int")
    params = fitted.fit(marked.where(F.col("part") == "train").withColumn("n", cut))
    newest = marked.groupBy(KEY).agg(
        F.max("ds").alias("last_ds"),
        last_values(F.col("i"), F.col("y"), fitted.window, F.col("n")).alias("window"),
    )
    return fitted.predict(params.drop("last_ds", "window").join(newest, KEY), horizon)


def forecast_by_method(
    series: DataFrame, routing: DataFrame, models: dict, horizon: int = 14, default: str | None = None
) -> DataFrame:
    """The forecast rows of ``forecast_outcomes``; keys without a forecast are told there only."""
    found = forecast_outcomes(series, routing, models, horizon, default)
    return found.where(F.col("error_type").isNull()).drop("error_type", "message")


def forecast_outcomes(
    series: DataFrame, routing: DataFrame, models: dict, horizon: int = 14, default: str | None = None
) -> DataFrame:
    """Each key forecast by the model its ``method`` names in ``routing(series_key, method)``.

    Keys that are not routed, or name none of ``models``, take the ``default`` method.  Forecast rows have ``error_type`` and
    ``message`` null; a key that could not be forecast has one row with both and without a step, so every key of ``series`` comes
    back.  Models that are aggregates of a key's rows are fitted side by side in one pass over the series and each key
    takes the forecast of its own; others are fitted on their keys' rows.
    """
    if default is not None and default not in models:
        raise ValueError(f"unknown default method {default!r}")
    check_horizon(horizon)
    named = F.when(F.col("method").isin(list(models)), F.col("method")).otherwise(F.lit(default))
    given = routing.groupBy(KEY).agg(F.min("method").alias("method"))
    placed = with_position(series).join(given, KEY, "left").withColumn("_named", named)
    beside = {f"_{k}": m for k, m in enumerate(models.values()) if hasattr(m, "aggregates")}
    tags = dict(zip(models, [f"_{k}" for k in range(len(models))]))
    fitted = fit_side_by_side(
        placed, beside, F.max("method").alias("method"), F.max("_named").alias("_named"), F.max("n").alias("_rows"), F.count_if(missing()).alias("_gaps"))
    steps, least, label = F.lit(None), F.lit(None).cast("int"), F.lit(None).cast("string")
    for method, tag in tags.items():
        mine = F.col("_named") == method
        label = F.when(mine, F.lit(models[method].name)).otherwise(label)
        if tag in beside:
            fit = F.col(f"{tag}fit")
            steps = F.when(mine & fit.isNotNull(), F.struct(fit["last_ds"].alias("last_ds"), models[method].steps(horizon, f"{tag}fit.").alias("path"))).otherwise(steps)
            least = F.when(mine, F.lit(models[method].min_rows)).otherwise(least)
    own = [method for method, tag in tags.items() if tag not in beside]
    chosen = fitted.select(KEY, "method", "_named", "_rows", "_gaps", steps.alias("_steps"), least.alias("_least"), label.alias("model"))
    kind = F.when(F.col("_named").isNull(), "unknown_method").when(F.col("_gaps") > 0, "missing_values").otherwise("too_short")
    text = F.when(F.col("_named").isNull(), F.coalesce(F.concat(F.lit("method "), F.col("method")), F.lit("no method"))).when(
        F.col("_gaps") > 0, F.concat(F.col("_gaps"), F.lit(" of "), F.col("_rows"), F.lit(" rows have no value"))).otherwise(
        F.concat(F.col("_rows"), F.lit(" rows, "), F.col("_least"), F.lit(" needed")))
    # A key without a path has one row without a step; keys of other models are told below.
    mine = chosen.where(F.coalesce(~F.col("_named").isin(own), F.lit(True))) if own else chosen
    rows = mine.select(
        KEY, "model", F.col("_steps.last_ds").alias("_last"), F.posexplode_outer("_steps.path").alias("_pos", "_f"), kind.alias("_kind"), text.alias("_text"))
    failed = F.col("_pos").isNull()
    result = rows.select(
        KEY, "model", (F.col("_pos") + 1).alias("step"), F.date_add("_last", F.col("_pos") + 1).alias("ds"), *[F.col(f"_f.{c}").alias(c) for c in ("yhat", "lo", "hi")],
        F.when(failed, F.col("_kind")).alias("error_type"), F.when(failed, F.col("_text")).alias("message"))
    for method in own:
        model, part = models[method], placed.where(F.col("_named") == method).drop("method", "_named")
        none = F.lit(None).cast("string")
        result = result.unionByName(model.predict(model.fit(part), horizon).withColumns({"error_type": none, "message": none}))
        result = result.unionByName(model.skipped(part).select(KEY, "model", "error_type", "message"), allowMissingColumns=True)
    return result
