"""Vectors of an Arrow column as rows of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCALE = 256
#: Integer components are held inside this bound, 65,536 times what a unit vector has, so that sums of products stay in 64 bits.
LIMIT = 1 << 24


def integers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each vector is there with finite components only, the lengths of those that are, and their components floor(scale * x) one after the other."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ends = np.cumsum(lengths)
    good = there & (bad[ends] == bad[ends - lengths])
    x = x[np.repeat(good, lengths)]
    return good, lengths[good], np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)


def matrix(lengths: np.ndarray, flat: np.ndarray, width: int | None = None) -> np.ndarray:
    """One row per vector; shorter ones are filled up with 0."""
    width = int(lengths.max(initial=0)) if width is None else width
    if not len(lengths) or (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
