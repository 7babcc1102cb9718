"""Matrix algebra on ``array<array<double>>`` columns (a list of rows): products, elimination, 4x4 transforms.

Everything is a column expression.  Elimination folds over the columns of the matrix, so its size may differ from row to
row.  A singular system or matrix gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot smaller than this share of the largest entry counts as zero.
TINY = 1e-13


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _rows(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def matrix(entries: list[list[Column | float]]) -> Column:
    """A matrix of columns or numbers."""
    cell = lambda x: (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    return F.array(*[F.array(*[cell(x) for x in row]) for row in entries])


def from_flat(flat: Column, width: int) -> Column:
    """Rows of ``width`` values cut from one array."""
    count = F.floor(F.size(flat) / width).cast("int")
    return F.transform(_rows(count), lambda i: F.slice(flat, i * width + 1, F.lit(width)).cast("array<double>"))


def transpose(a: Column) -> Column:
    return F.transform(_rows(F.size(a[0])), lambda j: F.transform(a, lambda row: F.get(row, j)))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def times_vector(a: Column, v: Column) -> Column:
    return F.transform(a, lambda row: _dot(row, v))


def multiply(a: Column, b: Column) -> Column:
    return _let(transpose(b), lambda columns: F.transform(a, lambda row: F.transform(columns, lambda c: _dot(row, c))))


def identity(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(_rows(n), lambda i: F.transform(_rows(n), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def _reduce(rows: Column, n: Column, least: Column) -> Column:
    """Gauss-Jordan elimination of the first ``n`` columns; ``struct(m, det)`` with NULL rows once a pivot is zero."""

    def step(state: Column, k: Column) -> Column:
        def with_pivot(at: Column) -> Column:
            def with_row(pivot: Column) -> Column:
                top = F.get(pivot, k)
                rest = F.filter(state["m"], lambda _, i: i != at)
                ordered = F.concat(F.slice(rest, F.lit(1), k), F.array(pivot), F.slice(rest, k + 1, F.size(rest)))
                unit = F.transform(pivot, lambda x: F.try_divide(x, top))
                cleared = F.transform(
                    ordered,
                    lambda row, i: F.when(i == k, unit).otherwise(F.zip_with(row, unit, lambda x, u: x - F.get(row, k) * u)),
                )
                # moving row ``at`` up to ``k`` passes ``at - k`` others, and each changes the sign
                sign = F.when((at - k) % 2 == 0, 1.0).otherwise(-1.0)
                return F.when(F.abs(top) > least, F.struct(cleared.alias("m"), (state["det"] * top * sign).alias("det")))

            return _let(F.get(state["m"], at), with_row)

        sizes = F.transform(F.slice(state["m"], k + 1, n - k), lambda row: F.abs(F.get(row, k)))
        place = k + F.array_position(sizes, F.array_max(sizes)).cast("int") - 1
        none = F.lit(None).cast("struct<m:array<array<double>>,det:double>")
        return F.when(state["m"].isNotNull(), _let(place, with_pivot)).otherwise(none)

    start = F.struct(rows.cast("array<array<double>>").alias("m"), F.lit(1.0).alias("det"))
    return F.aggregate(_rows(n), start, step)


def _least(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda row: F.array_max(F.transform(row, F.abs)))) * TINY


def solve(a: Column, b: Column) -> Column:
    """``x`` with ``a x = b`` for a square ``a``; NULL if singular."""
    augmented = F.zip_with(a, b, lambda row, x: F.concat(row, F.array(x)))
    return F.transform(_reduce(augmented, F.size(a), _least(a))["m"], lambda row: F.element_at(row, -1))


def inverse(a: Column) -> Column:
    n = F.size(a)
    augmented = F.zip_with(a, identity(n), lambda row, unit: F.concat(row, unit))
    return F.transform(_reduce(augmented, n, _least(a))["m"], lambda row: F.slice(row, n + 1, n))


def determinant(a: Column) -> Column:
    """0 if singular."""
    return F.coalesce(_reduce(a, F.size(a), _least(a))["det"], F.when(a.isNotNull(), 0.0))


def translation(x, y, z) -> Column:
    return matrix([[1, 0, 0, x], [0, 1, 0, y], [0, 0, 1, z], [0, 0, 0, 1]])


def scaling(x, y, z) -> Column:
    return matrix([[x, 0, 0, 0], [0, y, 0, 0], [0, 0, z, 0], [0, 0, 0, 1]])


def _from_quaternion(q: list[Column], shift: list[Column] | None = None) -> Column:
    w, x, y, z = q
    t = shift or [F.lit(0.0)] * 3
    return matrix(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), t[0]],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), t[1]],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), t[2]],
            [0, 0, 0, 1],
        ]
    )


def rotation(angle: Column, x: Column, y: Column, z: Column) -> Column:
    """Turn by ``angle`` about an axis of any length; no turn about an axis without length."""
    size = F.sqrt(x * x + y * y + z * z)
    share = F.when(size > 0, F.try_divide(F.sin(angle / 2), size)).otherwise(0.0)
    turn = F.when(size > 0, F.cos(angle / 2)).otherwise(1.0)
    return _let(F.array(turn, x * share, y * share, z * share), lambda q: _from_quaternion([q[i] for i in range(4)]))


def rotation_only(a: Column) -> Column:
    return matrix([[a[i][j] if i < 3 and j < 3 else float(i == j) for j in range(4)] for i in range(4)])


def translation_only(a: Column) -> Column:
    return matrix([[a[i][3] if i < 3 and j == 3 else float(i == j) for j in range(4)] for i in range(4)])


def normal_transform(a: Column) -> Column:
    """What ``a`` does to normals: the transposed inverse without its translation."""
    return _let(inverse(a), lambda m: rotation_only(transpose(m)))


def orthogonalise(a: Column) -> Column:
    """A rotation and translation near ``a``: the unit quaternion along its trace and its antisymmetric part.

    A zero in the last corner counts as one; a matrix without any such quaternion keeps its translation only.
    """
    corner = F.when(a[3][3] == 0, 1.0).otherwise(a[3][3])
    raw = [a[0][0] + a[1][1] + a[2][2] + corner, a[2][1] - a[1][2], a[0][2] - a[2][0], a[1][0] - a[0][1]]

    def rotated(q: Column, size: Column) -> Column:
        unit = [F.when(size > 0, F.try_divide(q[i], size)).otherwise(1.0 if i == 0 else 0.0) for i in range(4)]
        return _from_quaternion(unit, [a[i][3] / corner for i in range(3)])

    return _let(F.array(*raw), lambda q: _let(F.sqrt(_dot(q, q)), lambda size: rotated(q, size)))


def transform_point(a: Column, x: Column, y: Column, z: Column) -> Column:
    """``array(x, y, z)`` after a 4x4 transform, with the perspective division."""
    return _let(
        times_vector(a, F.array(x.cast("double"), y.cast("double"), z.cast("double"), F.lit(1.0))),
        lambda h: F.transform(F.slice(h, 1, 3), lambda v: F.try_divide(v, h[3])),
    )
