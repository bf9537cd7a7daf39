"""Vectors of whole numbers, made from arrays of floats and carried to numpy through Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to this are exact as doubles, and so are sums that stay below it.
EXACT = 2 ** 53


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale x) of every component as a double (whole, hence exact); null if a component is null or not finite."""
    up = vector.cast("array<double>")
    scaled = lambda c: c * F.lit(float(scale))
    floor = lambda c: F.when(F.abs(scaled(c)) < F.lit(float(EXACT)), F.floor(scaled(c)).cast("double")).otherwise(scaled(c))
    # a difference from itself is 0 only for finite numbers; the product by scale may leave the doubles too
    good = F.forall(up, lambda c: F.coalesce(scaled(c) - scaled(c) == 0, F.lit(False)))
    return F.when(good, F.transform(up, floor))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter lists count as zero in the components that they lack."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out
