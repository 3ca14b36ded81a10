"""Vectors as scaled integers, the common ground of the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest integer component: sums of squares of 1,024 of them fit 64 bits.
LARGEST = 1 << 26


def complete(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component as ``array<int>``."""
    def one(x: Column) -> Column:
        v = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(v) <= LARGEST, v.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} exceeds {LARGEST}")).cast("int"))

    return F.transform(vector, one)


def filled(vector: str, size: int) -> Column:
    """The vector with zeros behind it up to ``size`` components."""
    return F.concat(F.col(vector), F.array_repeat(F.lit(0), F.lit(size) - F.size(vector)))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of lists of ``size`` numbers as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def longest(rows: DataFrame, vector: str) -> Column:
    return F.coalesce(F.max(F.size(vector)), F.lit(0))
