"""A query: result columns, Spark plan and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    """``columns`` is a space-separated list of ``name`` or ``name:kind``.

    Kinds: ``d`` date as text, ``r`` number at four decimals, ``i`` whole number,
    ``b`` boolean.  Both sides are shaped by the same list.
    """

    name: str
    columns: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def shape(self) -> list[tuple[str, str]]:
        return [(c.split(":") + [""])[:2] for c in self.columns.split()]

    def run(self, tables: Tables) -> DataFrame:
        forms = {
            "": lambda c: c,
            "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
            "r": lambda c: F.round(c.cast("double"), 4),
            "i": lambda c: c.cast("bigint"),
            "b": lambda c: c.cast("boolean"),
        }
        return self.build(tables).select(*[forms[k](F.col(n)).alias(n) for n, k in self.shape()])

    def oracle(self) -> str:
        forms = {
            "": "{n}",
            "d": "strftime({n}, '%Y-%m-%d') AS {n}",
            "r": "round(CAST({n} AS DOUBLE), 4) + 0.0 AS {n}",
            "i": "CAST({n} AS BIGINT) AS {n}",
            "b": "CAST({n} AS BOOLEAN) AS {n}",
        }
        columns = ", ".join(forms[k].format(n=n) for n, k in self.shape())
        return f"SELECT {columns} FROM ({self.sql}) AS result"


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    """``WITH`` clause from table expressions and the final select."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"
