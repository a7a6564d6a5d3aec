"""Vectors that take part in a comparison, and their form in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def taking_part(vectors: DataFrame, *more: str) -> DataFrame:
    """(vec_id, embedding, more ...) of the rows that take part, components as doubles."""
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *more
    ).filter(usable("embedding"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)
