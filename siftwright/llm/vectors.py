"""What the two vector operators share: reading vector columns into arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(name: str) -> Column:
    """True for vectors that are not null, not empty and hold finite numbers only."""
    v = F.col(f"`{name}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def matrix(blobs: list[bytes], dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim)


def rows_of(column: pa.Array, kind=np.float64) -> list[np.ndarray]:
    """List column (no nulls inside) to one array per row, without Python numbers."""
    flat = np.asarray(column.flatten().cast(pa.float64())).astype(kind, copy=False)
    ends = np.cumsum(np.asarray(column.value_lengths()))
    return np.split(flat, ends[:-1]) if len(ends) else []
