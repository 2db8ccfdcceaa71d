"""Forecast models: ``fit`` gives one parameter row per key, ``predict`` the forecasts."""

from seriesmill.operators.models.base import available_models, get_model, register_model
from seriesmill.operators.models.decompose import DecomposeModel, decompose
from seriesmill.operators.models.ensemble import EnsembleModel, combine, ensemble_forecast, performance_weights
from seriesmill.operators.models.lookback import LookbackModel
from seriesmill.operators.models.ssa import SsaModel
from seriesmill.operators.models.wma import WeightedModel

register_model("decompose", DecomposeModel)
register_model("wma", WeightedModel)
register_model("ssa", SsaModel)
register_model("lookback", LookbackModel)
register_model("ensemble", EnsembleModel)

__all__ = [
    "DecomposeModel", "EnsembleModel", "LookbackModel", "SsaModel", "WeightedModel", "available_models", "combine",
    "decompose", "ensemble_forecast", "get_model", "performance_weights", "register_model",
]
