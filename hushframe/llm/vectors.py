"""Vectors fit to be computed with, and their components as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    broken = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, broken), F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the longer of two equally frequent ones; 0 if there is none."""
    best = rows.where(finite(vector)).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def usable(rows: DataFrame, vector: str, d: int) -> DataFrame:
    """Rows whose vector is finite and of length ``d``; a vector of another length counts as broken."""
    return rows.where(finite(vector) & (F.size(vector) == d))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of vectors of length ``d`` without nulls as doubles, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
