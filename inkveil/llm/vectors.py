"""What the operators on vectors have in common: which rows take part, and how batches become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    infinite = F.lit(float("inf"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(whole, F.lit(False))


def usable(table: DataFrame, vector_col: str, **columns: Column) -> tuple[DataFrame, int]:
    """Rows with finite vectors as ``columns`` and ``vector`` (doubles), and the vectors' length.

    The length is the most frequent one (of equally frequent ones the largest); as inner products need
    one length, rows of another length take no part. Without any row the length is 0.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(*(c.alias(k) for k, c in columns.items()), vector.alias("vector")).where(finite(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    length = most["length"] if most else 0
    return rows.where(F.size("vector") == length), length


def matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """The vectors of a batch as a matrix of doubles, one row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(vectors), length)


def listed(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column, one list for each row."""
    n, length = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * length, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def floored(values: np.ndarray, scale: float, limit: int) -> np.ndarray:
    """``floor(scale * value)`` as longs; an error for a magnitude of ``limit`` or more, which sums could not hold exactly."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= limit:
        raise ValueError(f"a component times {scale:g} reaches {limit}: beyond exact integer work")
    return scaled.astype(np.int64)
