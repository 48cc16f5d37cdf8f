"""Vectors as matrices within Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a float64 matrix; null entries become NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def table_of(batches) -> pa.Table | None:
    """All batches of a task as one table, or None without rows."""
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None
