"""Column expressions on vectors (``array<double>``); everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    """Cast before any arithmetic: float vectors would lose seven digits."""
    return vec.cast("array<double>")


def usable(vec: Column) -> Column:
    """No missing element: neither NULL nor NaN."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    """NULL when a side is missing or sizes differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def cosine(a: Column, b: Column) -> Column:
    """L2-normalised similarity; a zero vector gives 0, unequal sizes NULL."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def blocks(vec: Column, size: int) -> list[Column]:
    """Positional thirds of a vector of ``size`` elements: floor division, the last counted from the end."""
    k = size // 3
    return [F.slice(vec, 1, k), F.slice(vec, k + 1, k), F.slice(vec, size - k + 1, k)]


def weighted(parts_a: list[Column], parts_b: list[Column], weights: tuple[float, ...], measure) -> Column:
    out = F.lit(0.0)
    for a, b, w in zip(parts_a, parts_b, weights, strict=True):
        out = out + F.lit(float(w)) * measure(a, b)
    return out


def length_norm(distance: Column, length: float) -> Column:
    return distance / F.sqrt(F.lit(float(length)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def torsion(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed angle in degrees around the line b-c; NULL for collinear points."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    flat = (dot(n1, n1) > 0) & (dot(n2, n2) > 0)
    return F.when(flat, F.degrees(F.atan2(F.sqrt(dot(v, v)) * dot(u, n2), dot(n1, n2))))
