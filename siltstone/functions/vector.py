"""Dense vectors: products, distances and scores as columns, summed in double precision from left to right."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Invalid


def checked(query: Sequence[float], dim: int | None = None) -> list[float]:
    if not query or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in query):
        raise Invalid("the query vector must be a non-empty list of finite numbers")
    if dim is not None and len(query) != dim:
        raise Invalid(f"the query vector has {len(query)} dimensions, the vectors here have {dim}")
    return [float(x) for x in query]


def _folded(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def literal(query: Sequence[float]) -> Column:
    return F.lit([float(x) for x in query])


def dot(vector: Column, query: Column) -> Column:
    return _folded(F.zip_with(vector, query, lambda x, y: x.cast("double") * y.cast("double")))


def l2(vector: Column, query: Column) -> Column:
    return _folded(F.zip_with(vector, query, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(vector: Column) -> Column:
    return F.sqrt(_folded(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """0 where either side has no length. The query's length is computed here, once."""
    own = math.sqrt(sum(x * x for x in query))
    length = norm(vector) * F.lit(own)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(vector, literal(query)) / length)


def score(vector: Column, query: Sequence[float], metric: str) -> Column:
    """Higher is better."""
    if metric == "cosine":
        return cosine(vector, query)
    return -l2(vector, literal(query)) if metric == "l2" else dot(vector, literal(query))


def distance(vector: Column, query: Sequence[float], metric: str) -> Column:
    """Lower is better: 1 - cosine, squared distance, or the negated product."""
    if metric == "cosine":
        return F.lit(1.0) - cosine(vector, query)
    return l2(vector, literal(query)) if metric == "l2" else -dot(vector, literal(query))
