"""Integer vectors from a table of float vectors, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Components outside are taken at these bounds; both are exact as doubles.
_LOW, _HIGH = -(1 << 62), 1 << 62


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""

    def bad(x: Column) -> Column:
        value = x.cast("double")
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of doubles as 64-bit integers, all floors downwards."""
    return np.clip(np.floor(values.astype(np.float64) * scale), _LOW, _HIGH).astype(np.int64)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return np.diff(offsets), values.to_numpy(zero_copy_only=False)
