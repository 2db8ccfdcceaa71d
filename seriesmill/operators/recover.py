"""Second pass over the series a model could not be fitted to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.operators.models.base import fit_side_by_side, get_model
from seriesmill.operators.quality import MIN_VALID_SHARE, is_valid
from seriesmill.operators.series import KEY, recent_n, with_position

# Error class -> what is tried.
TRAINING_ACTIONS = {"invalid_values": "clean", "invalid_parameters": "fallback"}


def diagnose(series: DataFrame, min_rows: int) -> DataFrame:
    """Rows with the ``error_type`` of their key (null: can be fitted as it is), and ``i, n`` among the rows a fit uses.

    A fit uses the valid rows of a key that loses at most a tenth of them, or all rows; the others have no position.
    Window passes over the daily series of a key decide everything, so no second scan is needed.
    """
    whole = Window.partitionBy(KEY)
    marked = series.select(
        KEY, "ds", "y",
        is_valid().alias("_ok"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.count_if(is_valid()).over(whole).alias("_valid"),
    )
    error = F.when(F.col("_valid") < F.col("_n"), "invalid_values").when(F.col("_n") < min_rows, "invalid_parameters")
    clean = F.col("_ok") & (F.col("_valid") >= F.col("_n") * MIN_VALID_SHARE)
    kept = marked.withColumn("error_type", error).withColumn("keep", F.when(F.col("error_type") == "invalid_values", clean).otherwise(True))
    place = F.sum(F.col("keep").cast("int")).over(Window.partitionBy(KEY).orderBy("ds").rowsBetween(Window.unboundedPreceding, 0))
    return kept.select(
        KEY, "ds", "y", "error_type", F.when(F.col("keep"), (place - 1).cast("int")).alias("i"),
        F.count_if(F.col("keep")).over(whole).cast("int").alias("n"))


def fit_with_recovery(
    series: DataFrame, model: str, fallback: dict | None = None, **parameters
) -> tuple[DataFrame, DataFrame]:
    """(parameter rows of all fitted keys, one report row per failed key).

    Keys with invalid values are fitted again on their valid rows with the wanted parameters.  Keys too short for
    those are fitted with the parameters ``fallback``; without them they stay failed.  Report columns:
    ``series_key, error_type, action, recovered, rows_used, parameters``; ``recovered`` and ``rows_used`` are what the
    second fit returned.  Both settings are fitted side by side as columns of one aggregate, and each key takes the one
    its error calls for.  The model must be one that is fitted by aggregates.
    """
    wanted = get_model(model, **parameters)
    if not hasattr(wanted, "aggregates"):
        raise ValueError(f"{model!r} is not fitted by aggregates; clean its series first and fit it again")
    models = {"wanted": wanted}
    if fallback is not None:
        models["second"] = get_model(model, **fallback)
    fitted = fit_side_by_side(diagnose(series, wanted.min_rows), models, F.max("error_type").alias("error_type"))
    short = F.col("error_type") == "invalid_parameters"
    second = F.col("secondfit") if fallback is not None else F.lit(None)
    chosen = fitted.withColumn("fit", F.when(F.coalesce(short, F.lit(False)), second).otherwise(F.col("wantedfit")))
    params = chosen.where(F.col("fit").isNotNull()).select(KEY, F.lit(wanted.name).alias("model"), "fit.*")
    texts = {t: F.lit(", ".join(f"{k}={v}" for k, v in m.parameters().items())) for t, m in models.items()}
    actions = F.create_map(*[F.lit(x) for pair in TRAINING_ACTIONS.items() for x in pair])
    action = F.when(short & F.lit(fallback is None), "none").otherwise(F.element_at(actions, F.col("error_type")))
    report = chosen.where(F.col("error_type").isNotNull()).select(
        KEY, "error_type", action.alias("action"), F.col("fit").isNotNull().alias("recovered"),
        F.coalesce(F.col("fit.n").cast("long"), F.lit(0)).alias("rows_used"),
        F.when(short, texts.get("second", F.lit(""))).otherwise(texts["wanted"]).alias("parameters"),
    )
    return params, report


def retry_prediction(series: DataFrame, error_type: str, model, horizon: int = 1, recent: int | None = None) -> DataFrame:
    """Forecast after a failed prediction, from newly fitted parameters.

    ``invalid_values`` fits and predicts on the valid rows, anything else on all rows.  ``recent`` limits both to
    the newest rows of a key, if that is wanted.  A key without usable rows gives no forecast.
    """
    rows = series.select(KEY, "ds", "y")
    if error_type == "invalid_values":
        rows = rows.where(is_valid())
    if recent is not None:
        rows = recent_n(rows, recent)
    placed = with_position(rows)
    return model.predict(model.fit(placed), horizon)


def error_statistics(reports: DataFrame) -> DataFrame:
    """Attempts per error class: ``open_attempts`` counts unrecovered ones only."""
    return reports.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("recovered")).alias("recovered"),
        F.count_if(~F.col("recovered")).alias("open_attempts"),
    )
