"""Expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm_squared(v: Column) -> Column:
    """As dot(v, v), but v is made once."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(norm_squared(v))


def l2_squared(a: Column, b: Column) -> Column:
    """Difference form: no cancellation where norms are large."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")
