"""Array-column arithmetic: vectors and 3x3 matrices (row-major arrays of nine)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9)))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double"))
                                  * (p.cast("double") - q.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def mat(h: Column) -> list[Column]:
    """The nine entries of a matrix column."""
    return [h[i] for i in range(9)]


def mat_mul(a: list[Column], b: list[Column]) -> list[Column]:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j])
            for i in range(3) for j in range(3)]


def mat_det(m: list[Column]) -> Column:
    return (m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6])
            + m[2] * (m[3] * m[7] - m[4] * m[6]))


def mat_inv(m: list[Column]) -> list[Column]:
    """Inverse by cofactors; null for a singular matrix."""
    det = mat_det(m)
    safe = F.when(F.abs(det) > 0, det)
    adj = [m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
           m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
           m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3]]
    return [a / safe for a in adj]


def project(m: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    """Plane point through a 3x3 matrix; null on the horizon."""
    w = m[6] * u + m[7] * v + m[8]
    safe = F.when(F.abs(w) >= 1e-12, w)
    return (m[0] * u + m[1] * v + m[2]) / safe, (m[3] * u + m[4] * v + m[5]) / safe
