"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers beyond this are clamped to it, so that squared distances of vectors of
#: up to 2048 components fit a long.
LARGEST = 2**25


def all_finite(vector: str) -> Column:
    """The vector is known, has components, and none is null, NaN or infinite."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component x, as longs."""
    large = F.lit(float(LARGEST))
    scaled = F.transform(F.col(f"`{vector}`"), lambda x: F.greatest(-large, F.least(large, x.cast("double") * scale)))
    return F.transform(scaled, lambda x: F.floor(x))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A list column whose rows are equally long, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d) if d else np.zeros(n + 1), pa.int32()), pa.array(rows.ravel()))


