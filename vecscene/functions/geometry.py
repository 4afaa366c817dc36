"""Quaternions, covariance and bounds of splats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .vector import norm


def normalize_quaternion(q: Column) -> Column:
    """Unit quaternion; a zero one stays as it is."""
    n = norm(q)
    return F.when(n > 0, F.transform(q, lambda x: x / n)).otherwise(q)


def rotation_matrix(q: Column) -> list[list[Column]]:
    """3 x 3 entries for (w, x, y, z), with the sign pattern of the inverse rotation."""
    w, x, y, z = (q[i] for i in range(4))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)],
        [2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)],
        [2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(q: Column, scale: Column) -> list[list[Column]]:
    """R diag(s squared) R transposed."""
    r = rotation_matrix(q)
    return [[sum((r[i][k] * scale[k] * scale[k] * r[j][k] for k in range(1, 3)), r[i][0] * scale[0] * scale[0] * r[j][0]) for j in range(3)] for i in range(3)]


def contains(low: Column, high: Column, point: Column) -> Column:
    """Whether a point lies in a box, borders included."""
    out = F.lit(True)
    for k in range(3):
        out = out & (point[k] >= low[k]) & (point[k] <= high[k])
    return out
