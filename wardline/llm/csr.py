"""Sparse matrices in compressed rows and Gustavson's row-by-row product."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, counts)


@dataclass(frozen=True)
class Csr:
    """Row ``i`` holds columns ``indices[indptr[i]:indptr[i + 1]]`` with the values beside them."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_columns: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of each stored value."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))

    def transpose(self) -> Csr:
        """The same values by column; those of a column stay in row order."""
        counts = np.bincount(self.indices, minlength=self.n_columns)
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return Csr(indptr, self.rows()[order], self.data[order], self.n_rows)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of the other's rows that row i names, each by its value.

        The rows named are laid out one after the other; values that meet in one cell
        are added up.
        """
        assert self.n_columns == other.n_rows
        lengths = np.diff(other.indptr)[self.indices]
        at = spread(other.indptr[:-1][self.indices], lengths)
        cell = np.repeat(self.rows(), lengths) * np.int64(max(other.n_columns, 1)) + other.indices[at]
        value = np.repeat(self.data, lengths) * other.data[at]
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, dtype=np.int64)
        summed = np.add.reduceat(value, first) if len(first) else value
        row, column = np.divmod(cell[first], max(other.n_columns, 1))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.n_rows))]).astype(np.int64)
        return Csr(indptr, column, summed, other.n_columns)

    def apply(self, vector: np.ndarray) -> np.ndarray:
        """The product with a column of integers, exactly."""
        run = np.concatenate([[0], np.cumsum(self.data * vector[self.indices])])
        return run[self.indptr[1:]] - run[self.indptr[:-1]]


def intervals(ends: np.ndarray, n_columns: int) -> Csr:
    """Incidence of rows that cover consecutive columns without gaps, the row's last column before ``ends``."""
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(n_columns, dtype=np.int64), np.ones(n_columns, dtype=np.int64), n_columns)


def members(groups: np.ndarray, n_groups: int) -> Csr:
    """Incidence of rows that belong to one group each."""
    return Csr(np.arange(len(groups) + 1, dtype=np.int64), groups.astype(np.int64), np.ones(len(groups), dtype=np.int64), n_groups)


def tally(starts: np.ndarray, columns: np.ndarray, n_columns: int) -> Csr:
    """How often each row's list, from its start to the next one's, names each column."""
    width = np.int64(max(n_columns, 1))
    cell, counts = np.unique(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * width + columns, return_counts=True)
    row, column = np.divmod(cell, width)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(starts) - 1))]).astype(np.int64)
    return Csr(indptr, column, counts.astype(np.int64), n_columns)
