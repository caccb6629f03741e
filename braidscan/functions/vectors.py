"""Vector expressions over array columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    # The norm is bound by an outer transform: inside the inner one it would be taken again for each component.
    scaled = lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    """For unit vectors: 1 - a.b."""
    return F.lit(1.0) - dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sparse_dot(a: Column, b: Column) -> Column:
    """Of map<int,double> vectors."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)


def sparse_manhattan(a: Column, b: Column) -> Column:
    both = F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)


def close(a: Column, b: Column) -> Column:
    """Equal within rtol 1e-5 of b and atol 1e-8."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
