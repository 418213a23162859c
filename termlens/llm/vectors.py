"""Embedding rows as integer matrices, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: components are held within +-LIMIT, so that squared distances fit in 64 bits
LIMIT = (1 << 27) - 1


def lists_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (null: -1), first positions and flat values (null: nan) of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, col.offsets.to_numpy()[:-1].astype(np.int64), col.values.to_numpy(zero_copy_only=False).astype(np.float64)


def integer_rows(col: pa.Array, dims: int, scale: int, rows_at_once: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(scale * x) as int64 rows) of the vectors with exactly `dims` components, all finite."""
    size, first, values = lists_of(col)
    rows = np.flatnonzero(size == dims)
    for k in range(0, len(rows), rows_at_once):
        part = rows[k:k + rows_at_once]
        x = values[first[part][:, None] + np.arange(dims)]
        good = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            yield part[good], np.clip(np.floor(x[good] * scale), -LIMIT, LIMIT).astype(np.int64)
