"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest whole component: four times a squared distance of 256 such components still fits 64 bits.
LIMIT = 1 << 25
#: Whole numbers that a double holds exactly.
EXACT = 1 << 53


def sound(vector: str) -> Column:
    """True for a vector without null or non-finite components; false for a null vector."""
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, as array<int>; an error beyond LIMIT, where distances wouldn't fit a long."""
    def one(v: Column) -> Column:
        scaled = v.cast("double") * F.lit(float(scale))
        return F.when(F.abs(scaled) < LIMIT, F.floor(scaled).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("int"))

    return F.transform(F.col(vector), one)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column of rows of dims whole numbers as a matrix: doubles where every squared distance is exact in
    them, else 64-bit integers."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return x.astype(kind(x, dims))


def kind(x: np.ndarray, dims: int) -> type:
    top = int(np.abs(x.astype(np.int64)).max(initial=0)) + 1
    return np.float64 if dims * 4 * top * top < EXACT else np.int64


def floor_mean(total: int, n: int) -> int:
    return int(total) // int(n)
