"""Sparse integer matrices by compressed rows, and their row-by-row product."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from seriesmill.llm.chunks import ragged


@dataclass(frozen=True)
class Csr:
    """Row ``i`` has ``data[indptr[i]:indptr[i + 1]]`` in the columns ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    @property
    def T(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.row_of()[order], self.data[order], self.rows)

    def __matmul__(self, other: Csr) -> Csr:
        """Gustavson's product: row ``i`` merges the rows of ``other`` that row ``i`` names, each times its entry."""
        if self.columns != other.rows:
            raise ValueError(f"{self.columns} columns against {other.rows} rows")
        lengths = np.diff(other.indptr)[self.indices]
        met = ragged(other.indptr[:-1][self.indices], lengths)
        rows = np.repeat(self.row_of(), lengths)
        values = np.repeat(self.data, lengths) * other.data[met]
        key = rows * max(other.columns, 1) + other.indices[met]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        merged = np.add.reduceat(values, first) if len(first) else values
        rows, columns = np.divmod(key[first], max(other.columns, 1))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=self.rows))])
        return Csr(indptr, columns, merged, other.columns)


def runs(starts: np.ndarray, lengths: np.ndarray, columns: int) -> Csr:
    """A matrix of ones: row ``i`` covers ``lengths[i]`` columns from ``starts[i]`` on."""
    indices = ragged(starts, lengths)
    return Csr(np.concatenate([[0], np.cumsum(lengths)]), indices, np.ones(len(indices), np.int64), columns)


def members(group: np.ndarray, groups: int) -> Csr:
    """A matrix of ones: row ``i`` belongs to ``group[i]``."""
    return runs(group, np.ones(len(group), np.int64), groups)
