"""Vectors out of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rows_of(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Usable rows and their vectors, by length.

    Returns the flags of usable rows (not null, not empty, all components finite) and, for each
    length that occurs, the pair of row numbers and a matrix in double precision.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    values = pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    good = np.zeros(len(column), bool)
    out: dict[int, np.ndarray] = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        matrix = values[(ends[at] - size)[:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        good[at[fine]] = True
        out[size] = (at[fine], matrix[fine])
    return good, out
