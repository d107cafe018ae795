"""Arithmetic on ARRAY<FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """Divide by the length; a zero vector stays zero.

    The length is repeated into an array so that it is computed once, not once per element.
    """
    length = F.greatest(l2_norm(a), F.lit(eps))
    return F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, n: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(1e-12)) * F.greatest(l2_norm(b), F.lit(1e-12)))
