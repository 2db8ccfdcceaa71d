"""Combine model forecasts by weight, and weights by past error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.metrics import mape
from seriesmill.operators.models.base import fit_one, fit_when, forecast_rows
from seriesmill.operators.models.lookback import one_step_mape
from seriesmill.operators.series import KEY, by_key, unusable, with_position


def combine(
    forecasts: list[DataFrame],
    weights: dict[str, float] | DataFrame | None = None,
    name: str = "ensemble",
    require_all: bool = True,
) -> DataFrame:
    """Weighted mean of forecasts and bounds per key and step.

    ``weights`` by model name (default 1), or a table ``series_key, model, weight``.
    Weights are renormalised over the models present.  With ``require_all`` a key
    that any model could not forecast is left out.
    """
    stacked = reduce(DataFrame.unionByName, forecasts)
    if isinstance(weights, DataFrame):
        weighted = stacked.join(weights.select(KEY, "model", "weight"), [KEY, "model"])
    else:
        table = F.create_map(*[F.lit(v) for pair in (weights or {"": 1.0}).items() for v in pair])
        weighted = stacked.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("model")), F.lit(1.0)))

    def mean(c: str):
        return F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")).alias(c)

    grouped = weighted.groupBy(KEY, "step").agg(
        F.min("ds").alias("ds"), mean("yhat"), mean("lo"), mean("hi"), F.count(F.lit(1)).alias("_models")
    )
    if require_all:
        grouped = grouped.where(F.col("_models") == len(forecasts))
    return grouped.select(KEY, F.lit(name).alias("model"), "step", "ds", "yhat", "lo", "hi")


class EnsembleModel:
    """Weighted mean of several models, itself a model: its parameters hold those of its members, which are fitted in one pass.

    Members are models that are aggregates of a key's rows; a key that any member cannot be fitted to is left out.
    ``weights`` go by member name or, for members of one name, by their order; 1 when not given.
    """

    name = "ensemble"
    rewindows = False

    def __init__(self, members: list, weights: dict[str, float] | list[float] | None = None):
        if not members or not all(hasattr(m, "aggregates") for m in members):
            raise ValueError("an ensemble needs members that are fitted by aggregates")
        self.members = list(members)
        given = weights or {}
        self.weights = [float(w) for w in given] if isinstance(given, list) else [float(given.get(m.name, 1.0)) for m in members]
        if len(self.weights) != len(members) or sum(self.weights) <= 0:
            raise ValueError("weights must be one for each member and not all 0")
        self.min_rows = max(m.min_rows for m in members)
        self.look_back = max(m.look_back for m in members)

    def _mean(self, values: list[Column]) -> Column:
        return sum((v * w for v, w in zip(values, self.weights)), F.lit(0.0)) / sum(self.weights)

    def parameters(self) -> dict[str, str]:
        return {f"{k}.{n}": v for k, m in enumerate(self.members) for n, v in {"model": m.name, "weight": str(self.weights[k]), **m.parameters()}.items()}

    def skipped(self, series: DataFrame) -> DataFrame:
        return unusable(series, self.min_rows, self.name)

    def prepare(self, placed: DataFrame, tag: str) -> DataFrame:
        for k, member in enumerate(self.members):
            placed = member.prepare(placed, f"{tag}m{k}_")
        return placed

    def aggregates(self, tag: str) -> list[Column]:
        return [a for k, member in enumerate(self.members) for a in member.aggregates(f"{tag}m{k}_")]

    def finish(self, grouped: DataFrame, tag: str) -> DataFrame:
        for k, member in enumerate(self.members):
            grouped = member.finish(grouped, f"{tag}m{k}_")
        fits = {f"m{k}": F.col(f"{tag}m{k}_fit") for k in range(len(self.members))}
        every = reduce(lambda a, b: a & b, [f.isNotNull() for f in fits.values()])
        return grouped.withColumn(f"{tag}fit", fit_when(every, n=fits["m0"]["n"], last_ds=fits["m0"]["last_ds"], **fits))

    def fit(self, series: DataFrame) -> DataFrame:
        return fit_one(with_position(series), self)

    def steps(self, horizon: int, of: str = "") -> Column:
        paths = [m.steps(horizon, f"{of}m{k}.") for k, m in enumerate(self.members)]
        zipped = F.arrays_zip(*[p.alias(f"p{k}") for k, p in enumerate(paths)])
        part = lambda x, c: self._mean([x[f"p{k}"][c] for k in range(len(paths))]).alias(c)
        return F.transform(zipped, lambda x: F.struct(part(x, "yhat"), part(x, "lo"), part(x, "hi")))

    def predict(self, params: DataFrame, horizon: int) -> DataFrame:
        return forecast_rows(params, self.name, self.steps(horizon))

    def fit_struct(self, of: str = "") -> Column:
        return F.struct(*[m.fit_struct(f"{of}m{k}.").alias(f"m{k}") for k, m in enumerate(self.members)])

    def one_step(self, lags: list[str], fit: str, position: str = "i") -> Column:
        return self._mean([m.one_step(lags, f"{fit}.m{k}", position) for k, m in enumerate(self.members)])

    def evaluate(self, params: DataFrame, series: DataFrame) -> DataFrame:
        return one_step_mape(self, params, series)


def ensemble_forecast(series: DataFrame, models: list, horizon: int, weights=None) -> DataFrame:
    return combine([m.predict(m.fit(series), horizon) for m in models], weights)


def ensemble_evaluate(series: DataFrame, models: list, weights=None) -> DataFrame:
    """One-step error of the ensemble on the last row, fitted on the rows before it."""
    placed = with_position(series)
    past = placed.where(F.col("i") < F.col("n") - 1).withColumn("n", F.col("n") - 1)
    last = placed.where(F.col("i") == F.col("n") - 1).select(KEY, F.col("y").alias("actual"))
    forecast = ensemble_forecast(past, models, 1, weights)
    return (
        forecast.join(last, KEY)
        .groupBy(KEY)
        .agg(mape(F.col("yhat"), F.col("actual")).alias("mape"))
    )


def performance_weights(scores: DataFrame) -> DataFrame:
    """``key, model, mape [, weight]`` to normalised weights ``1 / (1 + mape)``.

    An undefined error scores 0; where every score of a key is 0 the given
    weights stay (1 when there are none).
    """
    score = F.when(F.col("mape").isNull(), 0.0).otherwise(1.0 / (1.0 + F.col("mape")))
    kept = F.col("weight") if "weight" in scores.columns else F.lit(1.0)
    scored = scores.withColumns({"_score": score, "_kept": kept})
    total = F.sum("_score").over(by_key())
    return scored.withColumn("_total", total).select(
        KEY, "model", "mape",
        F.when(F.col("_total") > 0, F.col("_score") / F.col("_total")).otherwise(F.col("_kept")).alias("weight"),
    )
