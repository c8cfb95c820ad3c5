"""Which vectors take part in comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by their length: row numbers, and the vectors as a float64 matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    found = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        found[int(d)] = rows, values[(starts[rows, None] + np.arange(d)).ravel()].reshape(len(rows), d)
    return found
