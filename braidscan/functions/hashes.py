"""Locality-sensitive hash keys as column expressions. Normals are data: a seed gives the same ones everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidscan.functions.vectors import dot


def normal(seed: int, bit: int, dim: int) -> list[float]:
    """A pseudo-random direction from integer arithmetic, so SQL can make the same one."""
    return [(((seed * 131 + bit) * 137 + d) * 2654435761 % 4294967296) / 4294967296.0 - 0.5 for d in range(dim)]


def normals(seed: int, bits: int, dim: int) -> list[list[float]]:
    return [normal(seed, b, dim) for b in range(bits)]


def _lit(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def binary_key(v: Column, rows: list[list[float]]) -> Column:
    """One character a hyperplane: 1 on its positive side."""
    return F.concat(*[F.when(dot(v, _lit(r)) > 0, F.lit("1")).otherwise(F.lit("0")) for r in rows])


def discretised_key(v: Column, rows: list[list[float]], width: float) -> Column:
    return F.concat_ws("_", *[F.floor(dot(v, _lit(r)) / F.lit(width)).cast("long").cast("string") for r in rows])


def one_bit_flips(key: Column, bits: int) -> Column:
    """The key itself and every key one bit away."""
    flips = [F.concat(F.substring(key, 1, i), F.when(F.substring(key, i + 1, 1) == "1", "0").otherwise("1"), F.substring(key, i + 2, bits)) for i in range(bits)]
    return F.array(key, *flips)


def permuted(key: Column, order: list[int]) -> Column:
    return F.concat(*[F.substring(key, i + 1, 1) for i in order])


def key_number(key: Column) -> Column:
    return F.conv(key, 2, 10).cast("long")
