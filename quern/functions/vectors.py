"""Vector expressions over arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def as_doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mahalanobis_diagonal(center: Column, stdev: Column, point: Column) -> Column:
    """Distance in units of the deviation of each dimension; infinite where a deviation is 0."""
    scaled = F.zip_with(F.zip_with(point, center, lambda x, c: x - c), stdev, lambda d, s: F.try_divide(d, s))
    distance = F.sqrt(_sum(F.transform(scaled, lambda z: z * z)))
    return F.when(F.exists(stdev, lambda s: s == 0), F.lit(float("inf"))).otherwise(distance)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """One row per vector of an Arrow column of vectors of one width."""
    parts = [np.asarray(chunk.flatten(), float).reshape(len(chunk), -1) for chunk in column.chunks if len(chunk)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))
