"""Short fixed-length arrays (at most 30 values: the longest model window)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def push(window: Column, value: Column) -> Column:
    """Drop the oldest value, append the newest."""
    return F.concat(F.slice(window, 2, F.greatest(F.size(window) - 1, F.lit(0))), F.array(value))


def last_values(index: Column, y: Column, count: Column | int, n: Column) -> Column:
    """Aggregate: the last ``count`` values of a series in order (``index`` 0 … n-1)."""
    pairs = F.collect_list(F.when(index >= n - count, F.struct(index.alias("i"), y.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def roll_forward(window: Column, horizon: int, step: Callable[[Column], Column]) -> Column:
    """Feed ``step(window)`` back into the window ``horizon`` times; array of the steps."""
    start = F.struct(window.alias("w"), F.expr("cast(array() as array<double>)").alias("out"))

    def advance(state, _):
        nxt = step(state["w"])
        # One evaluation of the step per round: bind it through a one-element array.
        return F.element_at(
            F.transform(
                F.array(nxt),
                lambda v: F.struct(push(state["w"], v).alias("w"), F.array_append(state["out"], v).alias("out")),
            ),
            1,
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda s: s["out"])
