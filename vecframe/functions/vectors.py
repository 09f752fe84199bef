"""Vector distances as columns, and the packed little-endian form of vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecframe.schema import Metric, VectorType

_DTYPES = {VectorType.FLOAT32: "<f4", VectorType.FLOAT64: "<f8"}


def encode(vector: Sequence[float], datatype: VectorType = VectorType.FLOAT32) -> bytes:
    datatype.width  # noqa: B018 - rejects types that can't be queried
    return np.asarray(vector, _DTYPES[datatype]).tobytes()


def decode(payload: bytes, datatype: VectorType = VectorType.FLOAT32) -> list[float]:
    if len(payload) % datatype.width:
        raise ValueError(f"{len(payload)} bytes are no vector of {datatype.value}")
    return np.frombuffer(payload, _DTYPES[datatype]).astype(float).tolist()


def literal(vector: Sequence[float]) -> Column:
    """A vector as a constant column: one literal, however many parts it has."""
    return F.lit(np.asarray(vector, np.float64))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def distance(metric: Metric, a: Column, b: Column, b_norm: float | Column | None = None) -> Column:
    """COSINE 1 - cos, L2 the squared distance, IP 1 - dot. Null if a part is null, lengths differ or a norm is zero."""
    if metric is Metric.COSINE:
        if not isinstance(b_norm, Column):
            b_norm = norm(b) if b_norm is None else F.lit(b_norm)
        d = 1 - F.try_divide(dot(a, b), norm(a) * b_norm)
    elif metric is Metric.L2:
        d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    else:
        d = 1 - dot(a, b)
    return F.when(F.size(a) == F.size(b), d)


def distance_to(metric: Metric, a: Column, query: Sequence[float]) -> Column:
    """The distance of a column to a constant vector, whose norm is computed once."""
    q = np.asarray(query, float)
    return distance(metric, a, literal(q), math.sqrt(float(q @ q)))
