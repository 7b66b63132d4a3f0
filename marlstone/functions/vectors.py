"""Distances, norms and relevance of dense vectors, as expressions on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def literal(vector) -> Column:
    """A query vector as a constant column of floats."""
    values = [float(x) for x in vector]
    if not values or any(math.isnan(x) or math.isinf(x) for x in values):
        raise ValueError("a vector needs at least one number, all of them finite")
    return F.array(*(F.lit(x) for x in values)).cast("array<float>")


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """v of length 1, as floats; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def l2_radius(r: float) -> float:
    """The radius of a range search under `l2`, whose distances are squared."""
    return r * r


def distance(a: Column, b: Column, metric: str, normalized: bool = False) -> Column:
    """Smaller is closer: squared l2; ip is minus the dot product; cosine is 1 - cos, at least 0, and 1 for zero vectors.

    A distance that isn't a number sorts last, as infinity. normalized: both sides have length 1 or are zero.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "l2":
        d = _fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    elif metric == "ip":
        d = -dot(a, b)
    else:
        a, b = (a, b) if normalized else (normalize(a), normalize(b))
        d = F.greatest(F.lit(0.0), 1 - dot(a, b))
    return F.nanvl(d, F.lit(float("inf")))


def truncate(v: Column, n: int) -> Column:
    """The first n dimensions."""
    if n < 1:
        raise ValueError("a vector keeps at least one dimension")
    return F.slice(v, 1, n)


def valid(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def relevance(d: Column, metric: str) -> Column:
    """A distance as a relevance between 0 and 1."""
    if metric == "cosine":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d / 2))
    if metric == "ip":
        return 1 / (1 + F.exp(d))
    return 1 / (1 + F.greatest(F.lit(0.0), d))
