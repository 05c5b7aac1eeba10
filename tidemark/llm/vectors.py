"""What the vector operators share: which vectors count, and Arrow arrays as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, no null or non-finite component."""
    big = F.lit(float("inf"))
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != big))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that squares stay in range."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def one_length(df: DataFrame) -> DataFrame:
    """Adds dim, the vector's length: rows of one Arrow batch may differ in it, groups of one dim may not."""
    return df.withColumn("dim", F.size("embedding"))
