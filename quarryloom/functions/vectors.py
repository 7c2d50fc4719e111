"""Similarities and distances of array<float> columns, in double arithmetic.

Vectors of different length, empty ones and null give the neutral value
(0 similarity, 1 cosine distance, 0 for the others), as does a zero norm.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot_product", "manhattan")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _same(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.when(_same(a, b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(F.lit(0.0))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    scaled = lambda m: F.when(m == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / m))
    return F.element_at(F.transform(F.array(magnitude(a)), scaled), 1)  # so that the magnitude is computed once, not for each entry


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits in double arithmetic, as C and SQL engines do it: away from zero where two are as near, and with the sign of what becomes zero.

    F.round goes by the decimal digits of x, and its zeros have no sign.
    """
    unit = F.lit(10.0**digits)
    up = lambda y: F.round(y * unit, 0) / unit
    return F.when(x < 0, -up(-x)).when(x == 0, x).otherwise(up(x))


def cosine(a: Column, b: Column) -> Column:
    norms = magnitude(a) * magnitude(b)
    return F.when(_same(a, b) & (norms > 0), dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(_same(a, b), F.sqrt(_sum(F.transform(d, lambda x: x * x)))).otherwise(F.lit(0.0))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(_same(a, b), _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))).otherwise(F.lit(0.0))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The smaller the nearer; dot_product is negated. Unknown metrics count as cosine."""
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "manhattan":
        return manhattan(a, b)
    if metric == "dot_product":
        return -dot(a, b)
    return cosine_distance(a, b)


def score(distance: Column, metric: str, mode: str = "metric") -> Column:
    """A score, the higher the nearer: mode is inverse (1 / (1 + d)), complement (1 - d, inverse if that is negative) or metric (what suits the metric)."""
    inverse = F.try_divide(F.lit(1.0), F.lit(1.0) + distance)
    if mode == "inverse":
        return inverse
    if mode == "complement":
        return F.when(F.lit(1.0) - distance < 0, inverse).otherwise(F.lit(1.0) - distance)
    if metric == "dot_product":
        return -distance
    if metric in ("euclidean", "manhattan"):
        return inverse
    return F.lit(1.0) - distance


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def to_json(vector: Column) -> Column:
    return F.to_json(vector)
