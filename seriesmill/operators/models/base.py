"""Model contract, registry and user-written models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill import schema
from seriesmill.operators.series import KEY


class Model(Protocol):
    """DataFrame in, DataFrame out; nothing runs until the result is used."""

    name: str
    min_rows: int
    rewindows: bool  # can fitted parameters forecast from another window of values?

    def parameters(self) -> dict[str, str]:
        """The model's settings as text."""

    def skipped(self, series: DataFrame) -> DataFrame:
        """Error rows of the keys that ``fit`` leaves out."""

    def fit(self, series: DataFrame) -> DataFrame:
        """One parameter row per key that is long enough and has no missing value."""

    def predict(self, params: DataFrame, horizon: int) -> DataFrame:
        """Rows ``series_key, model, step, ds, yhat, lo, hi``."""

    # Models whose parameters are aggregates of a key's rows also have ``prepare``, ``aggregates``, ``finish`` and ``steps``,
    # so that several of them are fitted side by side in one pass (see ``fit_side_by_side``).


_REGISTRY: dict[str, Callable[..., Model]] = {}


def register_model(name: str, factory: Callable[..., Model]) -> None:
    _REGISTRY[name.lower()] = factory


def get_model(name: str, **parameters) -> Model:
    try:
        factory = _REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"unknown model {name!r}; available: {', '.join(available_models())}") from None
    return factory(**parameters)


def available_models() -> list[str]:
    return sorted(_REGISTRY)


def check_horizon(horizon: int) -> int:
    if horizon <= 0:
        raise ValueError("forecast horizon must be positive")
    return int(horizon)


def forecast_rows(params: DataFrame, model: str, steps: Column) -> DataFrame:
    """Unfold an array of ``(yhat, lo, hi)`` per key into one row per step."""
    return params.select(KEY, "last_ds", F.posexplode(steps).alias("_pos", "_f")).select(
        KEY,
        F.lit(model).alias("model"),
        (F.col("_pos") + 1).alias("step"),
        F.date_add("last_ds", F.col("_pos") + 1).alias("ds"),
        F.col("_f.yhat").alias("yhat"),
        F.col("_f.lo").alias("lo"),
        F.col("_f.hi").alias("hi"),
    )


def fit_side_by_side(placed: DataFrame, models: dict[str, Model], *others: Column) -> DataFrame:
    """One row per key with a column ``{tag}fit`` for each model: its parameters, or null if the key cannot be fitted.

    All models are columns of one aggregate over ``series_key, ds, y, i, n``; rows without a position ``i`` belong to the
    key but are not learned from.  ``others`` are further aggregates.
    """
    for tag, model in models.items():
        placed = model.prepare(placed, tag)
    grouped = placed.groupBy(KEY).agg(*[a for tag, model in models.items() for a in model.aggregates(tag)], *others)
    for tag, model in models.items():
        grouped = model.finish(grouped, tag)
    return grouped


def fit_one(placed: DataFrame, model: Model) -> DataFrame:
    """Parameter rows of one model that is an aggregate of its rows."""
    fitted = fit_side_by_side(placed, {model.name: model}).where(F.col(f"{model.name}fit").isNotNull())
    return fitted.select(KEY, F.lit(model.name).alias("model"), f"{model.name}fit.*")


def fit_when(test: Column, **columns: Column) -> Column:
    return F.when(test, F.struct(*[c.alias(n) for n, c in columns.items()]))


def bounds(yhat: Column, margin: Column) -> Column:
    """Forecast struct with a lower bound floored at 0."""
    return F.struct(
        yhat.alias("yhat"), F.greatest(F.lit(0.0), yhat - margin).alias("lo"), (yhat + margin).alias("hi")
    )


class UserModel:
    """A Python function ``fn(pdf, horizon, **parameters) -> pdf(ds, yhat, lo, hi)`` per key.

    The group handed to ``fn`` is one daily series (at most one row per calendar
    day).  A key whose function raises becomes an error row; the job goes on.
    """

    _RESULT = T.StructType(schema.FORECAST.fields + schema.ERRORS.fields[2:])

    def __init__(self, name: str, fn: Callable[..., pd.DataFrame], **parameters):
        self.name, self.fn, self.parameters = name, fn, parameters

    def run(self, series: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
        """(forecast rows, error rows)."""
        name, fn, parameters = self.name, self.fn, self.parameters
        columns = [f.name for f in self._RESULT.fields]
        plain = [f.name for f in self._RESULT.fields if isinstance(f.dataType, (T.StringType, T.DateType))]

        def one_key(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ds", ignore_index=True)
            key = pdf[KEY].iloc[0]
            try:
                out = fn(pdf, check_horizon(horizon), **parameters).copy()
                out["step"] = range(1, len(out) + 1)
            except Exception as error:  # noqa: BLE001 - reported as a row
                out = pd.DataFrame({
                    "operation": ["predict"], "error_type": [type(error).__name__], "message": [str(error)],
                })
            out[KEY], out["model"] = key, name
            # Either half of the columns is missing: give it types that can hold nulls.
            out = out.reindex(columns=columns).astype({**dict.fromkeys(plain, object), "step": "Int64"})
            out[plain] = out[plain].where(out[plain].notna(), None)
            return out

        result = series.select(KEY, "ds", "y").groupBy(KEY).applyInPandas(one_key, self._RESULT)
        failed = F.col("error_type").isNotNull()
        return (
            result.where(~failed).select(*[f.name for f in schema.FORECAST.fields]),
            result.where(failed).select(*[f.name for f in schema.ERRORS.fields]),
        )
