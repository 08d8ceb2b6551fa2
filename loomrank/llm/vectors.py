"""Arrow helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows x dim doubles, usable)``: a vector is usable if it has ``dim`` finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    out, good = np.zeros((len(column), dim)), length == dim
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan))
    at = np.cumsum(length) - length
    if good.any():
        out[good] = flat[at[good][:, None] + np.arange(dim)]
    good &= np.isfinite(out).all(1) & (out != 0).any(1)
    out[~good] = 0
    return out, good
