"""Vector algebra on ``array`` columns (any length) and on x/y/z column triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def dist2(a: Column, b: Column) -> Column:
    gap = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(dist2(a, b))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(a: Column) -> Column:
    length = norm(a)
    return F.transform(as_double(a), lambda x: F.when(length > 0, x / length).otherwise(0.0))


def block(v: Column, offset: int, width: int) -> Column:
    """Slice of ``width`` values starting at 0-based ``offset``."""
    return F.slice(v, offset + 1, width)


Vec3 = tuple[Column, Column, Column]


def vec3(prefix: str) -> Vec3:
    """Columns ``<prefix>x, <prefix>y, <prefix>z``."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub3(a: Vec3, b: Vec3) -> Vec3:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot3(a: Vec3, b: Vec3) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Vec3, b: Vec3) -> Vec3:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def len3(a: Vec3) -> Column:
    return F.sqrt(dot3(a, a))


def angle_degrees3(a: Vec3, b: Vec3) -> Column:
    """Angle by ``atan2(|a x b|, a . b)``, accurate for near-parallel vectors."""
    return F.degrees(F.atan2(len3(cross3(a, b)), dot3(a, b)))


def transform3(p: Vec3, matrix: list[list[float]]) -> Vec3:
    """Apply a 3x4 or 4x4 affine matrix (row-major literals) to a point."""
    return tuple(
        p[0] * row[0] + p[1] * row[1] + p[2] * row[2] + F.lit(float(row[3])) for row in matrix[:3]
    )
