"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCES = ("cosine", "dot", "euclid", "manhattan")


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_zero(a: Column) -> Column:
    """Null, empty, or with a norm under 1e-12."""
    return F.coalesce((F.size(a) == 0) | (norm(a) < 1e-12), F.lit(True))


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths or a norm of zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def score(a: Column, b: Column, distance: str) -> Column:
    """Similarity (cosine, dot) or distance (euclid, manhattan); null where lengths differ."""
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}, not {distance!r}")
    value = {"cosine": cosine, "dot": dot, "euclid": euclid, "manhattan": manhattan}[distance](a, b)
    return F.when(F.size(a) == F.size(b), value)


def larger_is_better(distance: str) -> bool:
    return distance in ("cosine", "dot")
