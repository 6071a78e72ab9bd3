"""Shared pieces of the operators on vectors: rows that can be used, and matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column, below: float = float("inf")) -> Column:
    """Whether the vector is there and all its components are, none NaN and each smaller than the bound in magnitude."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < below)), F.lit(False))


def frequent_length(rows: DataFrame, vector_col: str) -> int | None:
    """The most frequent length of the vectors (of equally frequent ones the larger), other than 0; None without rows."""
    lengths = rows.groupBy(F.size(vector_col).alias("n")).count().where("n > 0")
    found = lengths.agg(F.max(F.struct("count", "n")).alias("x")).first()["x"]
    return found["n"] if found else None


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """The lists of a column, all of one width, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel(), kind))
