"""Queries for linear systems and 4x4 transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import matrices as X
from facetry.plans.registry import query
from facetry.session import spread

R, col = F.round, F.col


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return f"({m[0][0]})"
    parts = [f"({'-' if j % 2 else ''}({m[0][j]})*{_det([r[:j] + r[j + 1:] for r in m[1:]])})" for j in range(len(m))]
    return "(" + " + ".join(parts) + ")"


N = 4
ENTRY = [[f"e[{N * i + j + 1}] + {2.0 if i == j else 0.0}" for j in range(N)] for i in range(N)]
SIDE = [f"e[{N * N + i + 1}]" for i in range(N)]


def _cramer(k: int) -> str:
    return _det([row[:k] + [SIDE[i]] + row[k + 1 :] for i, row in enumerate(ENTRY)])


@query(
    "solve_systems",
    f"WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round({_det(ENTRY)}, 6) AS det, "
    + ", ".join(f"round({_cramer(k)} / {_det(ENTRY)}, 6) AS x{k}" for k in range(N))
    + " FROM a",
)
def solve_systems(t):
    """A system of four equations from the numbers of each embedding, by elimination with pivots."""
    e = col("embedding").cast("array<double>")
    a = X.from_flat(F.slice(e, 1, N * N), N)
    a = F.zip_with(a, X.identity(N), lambda row, unit: F.zip_with(row, unit, lambda x, u: x + 2 * u))
    rows = spread(t.embeddings.select("vec_id", "embedding")).select("vec_id", a.alias("a"), F.slice(e, N * N + 1, N).alias("b"))
    rows = rows.select("vec_id", R(X.determinant(col("a")), 6).alias("det"), X.solve(col("a"), col("b")).alias("x"))
    return rows.select("vec_id", "det", *[R(col("x")[k], 6).alias(f"x{k}") for k in range(N)])


TRANSFORMS = """WITH c AS (SELECT c_custkey AS id, c_custkey / 10.0 AS th, (c_nationkey + 1)::DOUBLE AS x, (c_custkey % 7)::DOUBLE AS y, 2.0::DOUBLE AS z,
        c_acctbal::DOUBLE / 1000 AS tx, (c_custkey % 5)::DOUBLE AS ty, 1.5::DOUBLE AS tz, 1.0 + c_custkey % 3 AS sx, 0.5::DOUBLE AS sy, 2.0 + c_nationkey % 2 AS sz FROM customer),
     n AS (SELECT *, x/sqrt(x*x+y*y+z*z) AS ux, y/sqrt(x*x+y*y+z*z) AS uy, z/sqrt(x*x+y*y+z*z) AS uz, cos(th) AS co, sin(th) AS si FROM c),
     r AS (SELECT *, co+ux*ux*(1-co) AS r00, ux*uy*(1-co)-uz*si AS r01, ux*uz*(1-co)+uy*si AS r02, uy*ux*(1-co)+uz*si AS r10, co+uy*uy*(1-co) AS r11,
        uy*uz*(1-co)-ux*si AS r12, uz*ux*(1-co)-uy*si AS r20, uz*uy*(1-co)+ux*si AS r21, co+uz*uz*(1-co) AS r22 FROM n),
     m AS (SELECT *, r00*sx AS m00, r01*sy AS m01, r02*sz AS m02, r10*sx AS m10, r11*sy AS m11, r12*sz AS m12, r20*sx AS m20, r21*sy AS m21, r22*sz AS m22 FROM r),
     q AS (SELECT *, m00+m11+m22+1 AS q0, m21-m12 AS q1, m02-m20 AS q2, m10-m01 AS q3 FROM m),
     o AS (SELECT *, q0/sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS w, q1/sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS i, q2/sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS j,
        q3/sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS k FROM q)
     SELECT id, round(m00+2*m01+3*m02+tx, 6) AS px, round(m10+2*m11+3*m12+ty, 6) AS py, round(m20+2*m21+3*m22+tz, 6) AS pz,
        round((r00*(1-tx)+r10*(1-ty)+r20*(1-tz))/sx, 6) AS bx, round((r01*(1-tx)+r11*(1-ty)+r21*(1-tz))/sy, 6) AS b_y, round((r02*(1-tx)+r12*(1-ty)+r22*(1-tz))/sz, 6) AS bz,
        round(sx*sy*sz, 6) AS det, round(r00/sx + r01/sy + r02/sz, 6) AS nx,
        round(1-2*(j*j+k*k), 6) AS o00, round(2*(i*j-w*k), 6) AS o01, round(2*(i*k+w*j), 6) AS o02, round(tx, 6) AS o03 FROM o"""


@query("transform_algebra", TRANSFORMS)
def transform_algebra(t):
    """Scaling, turning and moving as one transform: applied, inverted, for normals, and made orthogonal again."""
    key, nation = col("c_custkey"), col("c_nationkey")
    d = lambda c: c.cast("double")
    turn = X.rotation(key / 10, d(nation + 1), d(key % 7), F.lit(2.0))
    move = X.translation(d(col("c_acctbal")) / 1000, d(key % 5), 1.5)
    size = X.scaling(d(1 + key % 3), 0.5, d(2 + nation % 2))
    customers = spread(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"))
    rows = customers.select(key.alias("id"), X.multiply(X.multiply(move, turn), size).alias("m"))
    m, one = col("m"), F.lit(1.0)
    rows = rows.select(
        "id", X.transform_point(m, one, F.lit(2.0), F.lit(3.0)).alias("p"), X.transform_point(X.inverse(m), one, one, one).alias("b"),
        X.determinant(m).alias("det"), X.transform_point(X.normal_transform(m), one, one, one).alias("n"), X.orthogonalise(m).alias("o"),
    )
    named = {"px": "p", "py": "p", "pz": "p", "bx": "b", "b_y": "b", "bz": "b"}
    return rows.select(
        "id", *[R(col(c)["xyz".index(n[-1])], 6).alias(n) for n, c in named.items()], R("det", 6).alias("det"),
        R(col("n")[0], 6).alias("nx"), *[R(col("o")[0][j], 6).alias(f"o0{j}") for j in range(4)],
    )
