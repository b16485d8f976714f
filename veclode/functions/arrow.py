"""Vectors in Arrow batches as numpy matrices, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column) -> np.ndarray:
    """A list column of one width, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def from_matrix(x: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()))


def usable(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that operators work on, as doubles, and their positions. A vector that is null, has
    another width (width None: than most have, ties to the wider) or holds a null or non-finite element takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if width is None:
        own, n = np.unique(size[size >= 0], return_counts=True)
        width = int(own[np.flatnonzero(n == n.max())[-1]]) if len(own) else 0
    at = np.flatnonzero(size == width)
    if len(at) < len(size):
        column = column.take(pa.array(at))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
    whole = np.isfinite(x).all(1)
    return (x, at) if whole.all() else (x[whole], at[whole])


def widths(column) -> list[int]:
    """The widths that occur in a list column."""
    return sorted(set(column.combine_chunks().value_lengths().drop_null().to_pylist() if isinstance(column, pa.ChunkedArray) else column.value_lengths().drop_null().to_pylist()))


def best_rows(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row, equal scores by the smaller id, in no order."""
    k = min(k, s.shape[1])
    rows = np.repeat(np.arange(len(s)), k)
    if k == s.shape[1]:
        return rows, np.tile(np.arange(k), len(s))
    order = None
    if (ids[1:] < ids[:-1]).any():
        order = np.argsort(ids, kind="stable")
        s = s[:, order]
    least = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
    take, ties = s > least, s == least
    room = k - take.sum(1)
    if (ties.sum(1) > room).any():
        ties &= np.cumsum(ties, axis=1) <= room[:, None]
    cols = np.nonzero(take | ties)[1]
    return rows, cols if order is None else order[cols]
