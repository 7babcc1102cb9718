"""How curvature changes over a surface: a symmetric tensor of third order at every vertex.

Along an edge ``e`` of a face the curvature tensor changes by ``K``; the face's derivative ``D``, a symmetric form in three
tangents, should give ``D(e, ., .) = K``.  The sum of the squared errors over the edges is least where the symmetric part
of ``D A``, with ``A = sum(e e')``, is that of ``sum(K e')``.  Along the main axes of ``A`` these equations come apart:
``D_ijk = 3 B_ijk / (a_i + a_j + a_k)`` with the eigenvalues ``a`` of ``A`` and the symmetric part ``B``.  A vertex averages
the faces around it by their nearest area, read along its own curvature directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.vectors import Vec3, cross3, dot3, sub3, vec3
from facetry.operators.mesh import M, corner_areas
from facetry.operators.stats import weighted_mean

AXES = "xyz"
PARTS = ("c111", "c112", "c122", "c222")


def carried(x: Vec3, n: Vec3, f: Vec3) -> Vec3:
    """``x`` turned by the rotation that takes the unit vector ``n`` to ``f``; for opposite vectors, reversed."""
    turn, cosine = cross3(n, f), dot3(n, f)
    swept, along = cross3(turn, x), dot3(turn, x)
    back = cosine <= -1 + 1e-12
    share = F.try_divide(along, 1 + cosine)
    return tuple(F.when(back, -x[k]).otherwise(x[k] * cosine + swept[k] + turn[k] * share) for k in range(3))


def _put(df: DataFrame, **vectors: Vec3) -> DataFrame:
    return df.withColumns({f"{n}{k}": c for n, v in vectors.items() for k, c in zip(AXES, v)})


def _unit3(v: Vec3) -> Vec3:
    size = F.sqrt(dot3(v, v))
    return tuple(F.when(size > 0, F.try_divide(c, size)).otherwise(0.0) for c in v)


def curvature_derivatives(geometry: DataFrame, normals: DataFrame, curvatures: DataFrame) -> DataFrame:
    """``(mesh_id, v, c111, c112, c122, c222, norm2)`` from the results of ``principal_curvatures``.

    ``c111`` is the change of the first curvature along its own direction, and so on; their signs follow the
    directions' signs.  ``norm2``, the squared size of the tensor, does not depend on the directions.  A face without area
    gives nothing; a vertex without any other face has zeros.
    """
    g = geometry
    for i, c in enumerate("abc"):
        at = normals.join(curvatures, [M, "v"]).select(
            M, F.col("v").alias(f"v{i}"), *[F.col(f"n{k}").alias(f"{c}n{k}") for k in AXES],
            *[F.col(f"k{j}").alias(f"{c}k{j}") for j in (1, 2)], *[F.col(f"d{j}{k}").alias(f"{c}d{j}{k}") for j in (1, 2) for k in AXES],
        )
        g = g.join(at, [M, f"v{i}"])
    point = [vec3(c) for c in "abc"]
    sides = [(0, 1), (1, 2), (2, 0)]
    edges = [sub3(point[j], point[i]) for i, j in sides]
    face = _unit3(vec3("r"))
    g = _put(g, f_=face, t_=_unit3(edges[0]))
    g = _put(g, b_=cross3(vec3("f_"), vec3("t_")))
    # main axes of A in the plane of the face
    flat = [(dot3(e, vec3("t_")), dot3(e, vec3("b_"))) for e in edges]
    total = lambda terms: sum(terms, F.lit(0.0))
    a00, a01, a11 = (total(e[i] * e[j] for e in flat) for i, j in ((0, 0), (0, 1), (1, 1)))
    angle = F.atan2(2 * a01, a00 - a11) / 2
    g = g.withColumn("_angle", angle)
    cos, sin = F.cos("_angle"), F.sin("_angle")
    g = _put(
        g,
        u_=tuple(cos * t + sin * b for t, b in zip(vec3("t_"), vec3("b_"))),
        w_=tuple(cos * b - sin * t for t, b in zip(vec3("t_"), vec3("b_"))),
    )
    axes = (vec3("u_"), vec3("w_"))
    # the curvature tensors of the corners, read along the axes turned into the vertex planes
    for c in "abc":
        own, dirs = vec3(f"{c}n"), (vec3(f"{c}d1"), vec3(f"{c}d2"))
        turned = [carried(x, vec3("f_"), own) for x in axes]
        within = [[dot3(x, d) for d in dirs] for x in turned]
        for name, (i, j) in (("uu", (0, 0)), ("uw", (0, 1)), ("ww", (1, 1))):
            value = total(F.col(f"{c}k{m + 1}") * within[i][m] * within[j][m] for m in range(2))
            g = g.withColumn(f"_{c}{name}", value)
    x, y = [dot3(e, axes[0]) for e in edges], [dot3(e, axes[1]) for e in edges]
    change = {n: [F.col(f"_{'abc'[j]}{n}") - F.col(f"_{'abc'[i]}{n}") for i, j in sides] for n in ("uu", "uw", "ww")}
    large, small = total(v * v for v in x), total(v * v for v in y)
    solved = {
        "_d0": (total(k * v for k, v in zip(change["uu"], x)), large),
        "_d1": (total(k * w + 2 * m * v for k, m, v, w in zip(change["uu"], change["uw"], x, y)), 2 * large + small),
        "_d2": (total(k * v + 2 * m * w for k, m, v, w in zip(change["ww"], change["uw"], x, y)), large + 2 * small),
        "_d3": (total(k * w for k, w in zip(change["ww"], y)), small),
    }
    g = g.withColumns({n: F.when(small > 1e-30, F.try_divide(top, below)).otherwise(0.0) for n, (top, below) in solved.items()})
    share = corner_areas(g)
    corner = F.array(*[F.struct(F.col(f"v{i}").alias("v"), share[i].alias("w")) for i in range(3)])
    c = g.select(M, *[f"{n}_{k}" for n in "fuw" for k in AXES], *solved, F.inline(corner))
    frame = normals.join(curvatures, [M, "v"]).select(M, "v", *[f"n{k}" for k in AXES], *[f"d{j}{k}" for j in (1, 2) for k in AXES])
    c = c.join(frame, [M, "v"])
    at = [carried(vec3(f"d{j}"), vec3("n"), vec3("f_")) for j in (1, 2)]
    c = c.withColumns({f"_{n}{j}": dot3(vec, vec3(f"{n}_")) for j, vec in enumerate(at) for n in "uw"})
    along = [(F.col(f"_u{j}"), F.col(f"_w{j}")) for j in range(2)]

    def read(*which: int) -> Column:
        """The form along three of the two directions."""
        out = F.lit(0.0)
        for bits in range(8):
            index = [bits >> k & 1 for k in range(3)]
            term = F.col(f"_d{sum(index)}")
            for i, j in zip(index, which):
                term = term * along[j][i]
            out = out + term
        return out

    parts = dict(zip(PARTS, (read(0, 0, 0), read(0, 0, 1), read(0, 1, 1), read(1, 1, 1))))
    s = c.groupBy(M, "v").agg(*[F.coalesce(weighted_mean(e, F.col("w")), F.lit(0.0)).alias(n) for n, e in parts.items()])
    norm2 = F.col("c111") ** 2 + 3 * F.col("c112") ** 2 + 3 * F.col("c122") ** 2 + F.col("c222") ** 2
    return s.withColumn("norm2", norm2)
