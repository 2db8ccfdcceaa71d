"""Catalogue of ready queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesmill.plans.base import Query
from seriesmill.plans.tables import Tables


def catalogue() -> dict[str, Query]:
    from seriesmill.plans import evaluation, features, forecasts, ingest, inventory, market, monitoring, quality, series

    groups = (series, features, ingest, quality, forecasts, evaluation, inventory, market, monitoring)
    found: dict[str, Query] = {}
    for group in groups:
        for query in group.QUERIES:
            if query.name in found:
                raise ValueError(f"two queries named {query.name}")
            found[query.name] = query
    return found


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query):
        return lambda spark, sf_dir: query.run(Tables(spark, sf_dir))

    return {name: bind(query) for name, query in catalogue().items()}


def oracles() -> dict[str, str]:
    return {name: query.oracle() for name, query in catalogue().items() if query.sql}
