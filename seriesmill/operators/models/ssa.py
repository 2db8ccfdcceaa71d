"""Singular-spectrum forecast.

The series is reduced to lag sums inside Spark (``stats.lag_sums``).  Only the
small eigenproblem, at most 30 x 30, runs in Python: on Arrow batches holding one
row per key, solved for a whole batch at once.  Its result folds into an affine
rule ``intercept + sum(b_j * w_j)``, so forecasting is native again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.arrays import dot, roll_forward
from seriesmill.functions.lookups import within_limits
from seriesmill.operators.models.base import bounds, check_horizon, forecast_rows
from seriesmill.operators.models.lookback import one_step_mape
from seriesmill.operators.series import KEY, unusable, with_position
from seriesmill.operators.stats import lag_sums

Z = 1.96
SHORT_SERIES = 30


def lag_covariance(products, head, tail, total, n, window: int):
    """Means (m, L) and covariance (m, L, L) of the trajectory columns for ``m`` keys.

    ``head``/``tail`` hold at least the first/last ``window - 1`` values, relative to the base.
    """
    size = window
    rows = (n - size + 1).astype(float)
    head = head[:, : size - 1]
    tail = tail[:, tail.shape[1] - (size - 1):]
    means = np.empty((len(n), size))
    cov = np.empty((len(n), size, size))
    for a in range(size):
        # column a covers positions a … n - size + a
        means[:, a] = (total - head[:, :a].sum(1) - tail[:, a:].sum(1)) / rows
    for a in range(size):
        for b in range(a, size):
            d = b - a
            early = (head[:, d:b] * head[:, : b - d]).sum(1)
            late = (tail[:, d + a:] * tail[:, a: size - 1 - d]).sum(1)
            cross = products[:, d] - early - late
            cov[:, a, b] = cov[:, b, a] = (cross - rows * means[:, a] * means[:, b]) / (rows - 1)
    return means, cov


def leading_vectors(cov, components: int):
    """Eigenvectors of the largest eigenvalues, columns in falling order."""
    _, vectors = np.linalg.eigh(cov)
    return vectors[:, :, ::-1][:, :, :components]


def affine_rule(means, vectors):
    """Weights of the last reconstructed coordinate; independent of vector signs."""
    weights = np.einsum("mjc,mc->mj", vectors, vectors[:, -1, :])
    return means[:, -1] - (means * weights).sum(1), weights


def _matrix(batch: pa.RecordBatch, name: str):
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _vectors_column(rows) -> pa.Array:
    rows = np.asarray(rows, dtype=float)
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def recurrence(means, vectors):
    """Weights of the value that follows ``L - 1`` others if all ``L`` lie in the span of the vectors; intercept and weights."""
    last = vectors[:, -1, :]
    weights = np.einsum("mjc,mc->mj", vectors[:, :-1, :], last) / (1.0 - (last**2).sum(1))[:, None]
    return means[:, -1] - (means[:, :-1] * weights).sum(1), weights


def rebuilt_tail(values, means, vectors):
    """The last ``L - 1`` values of the rebuilt series, from the last ``2 L - 2`` observed.

    Every window is projected on the vectors; a day's value is the mean over the anti-diagonal, that is over all windows that hold it.
    """
    size = means.shape[1]
    windows = np.lib.stride_tricks.sliding_window_view(values, size, axis=1)
    centred = windows - means[:, None, :]
    projected = np.einsum("mwc,mjc->mwj", np.einsum("mwj,mjc->mwc", centred, vectors), vectors) + means[:, None, :]
    total, seen = np.zeros_like(values), np.zeros(values.shape[1])
    for w in range(windows.shape[1]):
        total[:, w : w + size] += projected[:, w]
        seen[w : w + size] += 1
    return (total / seen)[:, -(size - 1) :]


def recurrences(sums: DataFrame, window: int, components: int) -> DataFrame:
    """Like ``solve``, for the recurrence: ``_a0``, ``_b0`` and in ``window`` the rebuilt values it starts from."""
    kept = [KEY, "n", "last_ds", "sd_pop"]
    fields = [sums.schema[c] for c in kept] + [
        T.StructField("_a0", T.DoubleType()), T.StructField("_b0", T.ArrayType(T.DoubleType())), T.StructField("window", T.ArrayType(T.DoubleType()))]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows == 0:
                continue
            products, head, tail, values = (_matrix(batch, c) for c in ("products", "head", "tail", "window"))
            n, total, level = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "offset_sum", "base"))
            means, cov = lag_covariance(products, head, tail, total, n, window)
            vectors = leading_vectors(cov, components)
            intercept, weights = recurrence(means, vectors)
            rebuilt = rebuilt_tail(values - level[:, None], means, vectors) + level[:, None]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(level + intercept - level * weights.sum(1)), _vectors_column(weights), _vectors_column(rebuilt)],
                names=[*kept, "_a0", "_b0", "window"])

    return sums.select(*kept, "base", "products", "head", "tail", "offset_sum", "window").mapInArrow(batches, T.StructType(fields))


def solve(sums: DataFrame, settings: list[tuple[int, int]], keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Adds per setting ``(window, components)``: ``_a{g}`` intercept, ``_b{g}`` weights.

    The values of a setting mean nothing for keys with fewer than two windows of rows.
    """
    kept = [*keys, "n", "last_ds", "base", "sd_pop", "window"]
    fields = [sums.schema[c] for c in kept]
    for g in range(len(settings)):
        fields.append(T.StructField(f"_a{g}", T.DoubleType()))
        fields.append(T.StructField(f"_b{g}", T.ArrayType(T.DoubleType())))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows == 0:
                continue
            products, head, tail = (_matrix(batch, c) for c in ("products", "head", "tail"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            total = batch.column("offset_sum").to_numpy(zero_copy_only=False)
            level = batch.column("base").to_numpy(zero_copy_only=False)
            columns = [batch.column(c) for c in kept]
            names = list(kept)
            for g, (window, components) in enumerate(settings):
                long_enough = n >= 2 * window
                usable = np.where(long_enough, n, 2 * window)
                means, cov = lag_covariance(products, head, tail, total, usable, window)
                cov[~long_enough] = np.eye(window)
                intercept, weights = affine_rule(means, leading_vectors(cov, components))
                # back from relative values: level + intercept + b . (w - level)
                columns.append(pa.array(level + intercept - level * weights.sum(1)))
                columns.append(_vectors_column(weights))
                names += [f"_a{g}", f"_b{g}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = [*kept, "products", "head", "tail", "offset_sum"]
    return sums.select(*columns).mapInArrow(batches, T.StructType(fields))


def fold_moments(folds: list[dict], n: int, base: float, window: int):
    """What ``lag_covariance`` needs of a series without each of its folds, by additive sums.

    ``folds`` hold, in order, ``start``, ``size``, ``total`` and ``products`` of their rows relative to ``base`` (a product belongs to its later
    row) and the values within ``window - 1`` rows of their ends.  Left out is one fold at a time: the products of the rows before it are sums of
    whole folds, so are those behind it but for the rows whose partner lies across the gap, and the two sides meet at a
    new seam.  Returns arrays ``(products, head, tail, total, rows)`` with a row per fold.
    """
    near = np.zeros(n)
    for f in folds:
        for o, value in (e.values() for e in f["edge"]):
            near[o] = value
    before = np.cumsum([np.zeros(window), *(f["products"] for f in folds)], axis=0)
    totals = np.array([f["total"] for f in folds])
    edge, out = window - 1, []
    for k, f in enumerate(folds):
        start, end = f["start"], f["start"] + f["size"]
        left = n - f["size"]
        products = before[k] + before[-1] - before[k + 1]
        rest = np.concatenate([near[max(0, start - edge) : start], near[end : end + edge]])  # the rows around the seam
        mid = min(start, edge)
        for d in range(1, window):
            behind = near[end : min(end + d, n)]
            partner = np.arange(end, end + len(behind)) - d
            products[d] -= (behind * np.where(partner >= 0, near[np.maximum(partner, 0)], 0.0)).sum()
            first = np.arange(max(0, mid - d), min(mid, len(rest) - d))
            products[d] += (rest[first] * rest[first + d]).sum()
        places = np.concatenate([np.arange(edge), np.arange(left - edge, left)]) if left >= edge else np.zeros(0, int)
        ends = near[np.where(places < start, places, places + f["size"])] if len(places) else np.zeros(2 * edge)
        out.append((products, ends[:edge], ends[edge:], totals.sum() - f["total"], left))
    return tuple(np.array(x) for x in zip(*out))


def solve_folds(sums: DataFrame, settings: list[tuple[int, int]], longest: int) -> DataFrame:
    """``series_key, _fits``: for each left-out fold an array with ``(intercept, weights)`` of every setting, null where too short.

    ``sums`` has a row per key: ``n, base`` and the array ``folds``.
    """
    fit = T.StructType([T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    out = T.StructType([sums.schema[KEY], T.StructField("_fits", T.ArrayType(T.ArrayType(fit)))])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            rows = batch.to_pylist()
            parts = [fold_moments(sorted(r["folds"], key=lambda f: f["start"]), r["n"], r["base"], longest) for r in rows]
            products, head, tail, total, left = (np.concatenate(x) for x in zip(*parts))
            level = np.repeat([r["base"] for r in rows], [len(p[4]) for p in parts])
            fits = []
            for window, components in settings:
                ok = left >= 2 * window
                means, cov = lag_covariance(products, head, tail, total, np.where(ok, left, 2 * window), window)
                cov[~ok] = np.eye(window)
                intercept, weights = affine_rule(means, leading_vectors(cov, components))
                shift = level + intercept - level * weights.sum(1)
                fits.append([{"intercept": a, "weights": w} if good else None for a, w, good in zip(shift.tolist(), weights.tolist(), ok)])
            by_fold = list(map(list, zip(*fits)))
            ends = np.cumsum([0, *(len(p[4]) for p in parts)])
            yield pa.RecordBatch.from_pylist([{KEY: r[KEY], "_fits": by_fold[a:b]} for r, a, b in zip(rows, ends[:-1], ends[1:])], schema=_arrow(out))

    return sums.select(KEY, "n", "base", "folds").mapInArrow(batches, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def moments(series: DataFrame, window: int) -> DataFrame:
    """Rows ``key, a, b, mean_a, covariance`` for the lag columns ``a <= b``."""
    sums = lag_sums(with_position(series).where(F.col("n") >= 2 * window), window)
    key_type = sums.schema[KEY].dataType
    out = T.StructType([
        T.StructField(KEY, key_type), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
        T.StructField("mean_a", T.DoubleType()), T.StructField("covariance", T.DoubleType()),
    ])
    low, high = np.triu_indices(window)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows == 0:
                continue
            products, head, tail = (_matrix(batch, c) for c in ("products", "head", "tail"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            total = batch.column("offset_sum").to_numpy(zero_copy_only=False)
            level = batch.column("base").to_numpy(zero_copy_only=False)
            means, cov = lag_covariance(products, head, tail, total, n, window)
            means = means + level[:, None]
            repeat = np.repeat(np.arange(batch.num_rows), len(low))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(KEY).take(pa.array(repeat)),
                    pa.array(np.tile(low, batch.num_rows).astype(np.int32)),
                    pa.array(np.tile(high, batch.num_rows).astype(np.int32)),
                    pa.array(means[:, low].reshape(-1)),
                    pa.array(cov[:, low, high].reshape(-1)),
                ],
                names=[f.name for f in out.fields],
            )

    return sums.select(KEY, "n", "base", "products", "head", "tail", "offset_sum").mapInArrow(batches, out)


class SsaModel:
    name = "ssa"
    rewindows = True

    def __init__(self, window: int = 7, components: int = 3, method: str = "last"):
        """``method``: ``last`` rebuilds the last value of each window; ``recurrent`` continues the rebuilt series by its linear recurrence."""
        if method not in ("last", "recurrent"):
            raise ValueError(f"unknown method {method!r}")
        if method == "recurrent" and components >= window:
            raise ValueError("a recurrence needs fewer components than the window")
        self.method = method
        self.window = within_limits(window, "window")
        if not 1 <= components <= self.window:
            raise ValueError(f"components must lie between 1 and the window {self.window}, not {components}")
        self.components = int(components)
        self.look_back = self.window if method == "last" else self.window - 1
        self.min_rows = 2 * self.window

    def parameters(self) -> dict[str, str]:
        chosen = {"window": str(self.window), "components": str(self.components)}
        return chosen if self.method == "last" else chosen | {"method": self.method}

    def skipped(self, series: DataFrame) -> DataFrame:
        return unusable(series, self.min_rows, self.name)

    def fit(self, series: DataFrame) -> DataFrame:
        recurrent = self.method == "recurrent"
        keep = 2 * self.window - 2 if recurrent else None
        sums = lag_sums(with_position(series).where(F.col("n") >= self.min_rows), self.window, keep=keep)
        solved = recurrences(sums, self.window, self.components) if recurrent else solve(sums, [(self.window, self.components)])
        return solved.select(
            KEY, F.lit(self.name).alias("model"), "n", "last_ds", "sd_pop",
            F.col("_a0").alias("intercept"), F.col("_b0").alias("weights"), "window",
        )

    def predict(self, params: DataFrame, horizon: int = 10) -> DataFrame:
        def step(w: Column) -> Column:
            return F.col("intercept") + dot(w, F.col("weights"))

        def spread(v: Column) -> Column:
            sd = F.when(F.col("n") < SHORT_SERIES, F.greatest(F.lit(1.0), v * 0.1)).otherwise(
                F.greatest(F.lit(1.0), F.col("sd_pop"))
            )
            return bounds(v, sd * Z)

        path = roll_forward(F.col("window"), check_horizon(horizon), step)
        return forecast_rows(params, self.name, F.transform(path, spread))

    # -- scoring ---------------------------------------------------------------
    def fit_struct(self, of: str = "") -> Column:
        return F.struct(F.col(of + "intercept").alias("intercept"), F.col(of + "weights").alias("weights"))

    def one_step(self, lags: list[str], fit: str, position: str = "i") -> Column:
        terms = [f"{fit}.weights[{j}] * {x}" for j, x in enumerate(lags[-self.look_back:])]
        return F.expr(" + ".join([f"{fit}.intercept", *terms]))

    def evaluate(self, params: DataFrame, series: DataFrame) -> DataFrame:
        return one_step_mape(self, params, series)
