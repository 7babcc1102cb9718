"""Triangle meshes as tables: geometry, connectivity, normalisation, editing.

``vertices(mesh_id, v, x, y, z)`` and ``faces(mesh_id, face, v0, v1, v2)``; many meshes per table.
Every join key contains a vertex, an edge or a face, never a mesh alone (except against one row per
mesh), so a mesh of any size spreads over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import sgn
from facetry.functions.vectors import Vec3, cross3, dot3, len3, sub3, vec3
from facetry.operators.ordered import running
from facetry.operators.stats import floor_percentiles, weighted_mean
from facetry.session import dealt

# Fixed value: the normalising scale is this floor percentile of the centre distances, rescaled to a half.
SCALE_PERCENTILE = 0.33

M = "mesh_id"


def corners(faces: DataFrame) -> DataFrame:
    """``(mesh_id, face, slot, v)``: one row per face corner."""
    pts = F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "v")
    return faces.select(M, "face", pts)


def face_points(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners (``ax .. cz``): one join, one regrouping."""
    p = corners(faces).join(dealt(vertices.select(M, "v", "x", "y", "z")), [M, "v"])
    picks = [
        F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{corner}{c}")
        for i, corner in enumerate("abc")
        for c in ("v", "x", "y", "z")
    ]
    out = p.groupBy(M, "face").agg(*picks)
    return out.withColumnsRenamed({"av": "v0", "bv": "v1", "cv": "v2"})


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds area, centre (``gx, gy, gz``) and the raw normal (``rx, ry, rz``, length twice the area)."""
    f = face_points(faces, vertices)
    a, b, c = vec3("a"), vec3("b"), vec3("c")
    n = cross3(sub3(a, b), sub3(b, c))
    f = f.withColumns({"rx": n[0], "ry": n[1], "rz": n[2]})
    centre = {f"g{k}": (a[i] + b[i] + c[i]) / 3 for i, k in enumerate("xyz")}
    return f.withColumns({"area": 0.5 * len3(vec3("r")), **centre})


def _unit(v: Vec3, names: list[str]) -> dict[str, Column]:
    length = len3(v)
    return {n: F.when(length > 0, c / length).otherwise(0.0) for n, c in zip(names, v)}


def vertex_normals(geometry: DataFrame) -> DataFrame:
    """Unit normals per vertex; a face counts by the inverse product of its two squared edge lengths."""
    a, b, c = vec3("a"), vec3("b"), vec3("c")
    la, lb, lc = (dot3(d, d) for d in (sub3(a, b), sub3(b, c), sub3(c, a)))
    weights = [la * lc, lb * la, lc * lb]
    rows = F.array(
        *[F.struct(F.col(f"v{i}").alias("v"), (1.0 / (w + 1e-27)).alias("w")) for i, w in enumerate(weights)]
    )
    spread = geometry.select(M, "rx", "ry", "rz", F.inline(rows))
    sums = spread.groupBy(M, "v").agg(*[F.sum(F.col(f"r{k}") * F.col("w")).alias(f"s{k}") for k in "xyz"])
    return sums.select(M, "v", *[c.alias(n) for n, c in _unit(vec3("s"), ["nx", "ny", "nz"]).items()])


def smooth_face_normals(faces: DataFrame, normals: DataFrame) -> DataFrame:
    """Unit face normals: normalised sum of the three vertex normals."""
    p = corners(faces).join(dealt(normals), [M, "v"])
    sums = p.groupBy(M, "face").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in "xyz"])
    return sums.select(M, "face", *[c.alias(n) for n, c in _unit(vec3("s"), ["nx", "ny", "nz"]).items()])


def vertex_areas(geometry: DataFrame) -> DataFrame:
    """Sum of the areas of the incident faces."""
    spread = geometry.select(M, "area", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    return spread.groupBy(M, "v").agg(F.sum("area").alias("area"))


def corner_areas(geometry: DataFrame) -> list[Column]:
    """Area of each triangle nearest to each of its corners.

    Perpendicular bisectors cut an acute triangle at its circumcentre: each side of length ``l`` gives both of
    its corners a right triangle of area ``l^2 cot(opposite angle) / 8``.  In a triangle that is obtuse at
    one corner, another corner keeps the right triangle between half of the side towards the obtuse
    corner and its bisector, ``l^2 tan(own angle) / 8``; the obtuse corner has the rest.
    """
    point = [vec3(p) for p in "abc"]
    following = lambda i, k: (i + k) % 3
    side2 = {}
    for i in range(3):
        j = following(i, 1)
        d = sub3(point[j], point[i])
        side2[i, j] = side2[j, i] = dot3(d, d)
    # cosine and sine of each angle, both times the product of its two sides
    inner = [
        dot3(sub3(point[following(i, 1)], point[i]), sub3(point[following(i, 2)], point[i])) for i in range(3)
    ]
    area, outer = F.col("area"), 2 * F.col("area")
    out = []
    for i in range(3):
        others = (following(i, 1), following(i, 2))
        acute = sum(side2[i, others[k]] * inner[others[1 - k]] for k in (0, 1)) / (8 * outer)
        own = area - sum(side2[i, o] * outer / (8 * inner[o]) for o in others)
        expr = F.when(area <= 0, 0.0).when(inner[i] <= 0, own)
        for o in others:
            expr = expr.when(inner[o] <= 0, side2[i, o] * outer / (8 * inner[i]))
        out.append(expr.otherwise(acute))
    return out


def voronoi_areas(geometry: DataFrame) -> DataFrame:
    """Sum of the corner areas at every vertex."""
    rows = F.array(*[F.struct(F.col(f"v{j}").alias("v"), a.alias("a")) for j, a in enumerate(corner_areas(geometry))])
    return geometry.select(M, F.inline(rows)).groupBy(M, "v").agg(F.sum("a").alias("area"))


# ------------------------------------------------------------------ connectivity


def directed_edges(faces: DataFrame) -> DataFrame:
    """Edge ``slot`` of a face runs opposite its corner ``slot``: ``(mesh_id, face, slot, p, q)``."""
    rows = F.array(
        *[
            F.struct(F.lit(j).alias("slot"), F.col(f"v{(j + 1) % 3}").alias("p"), F.col(f"v{(j + 2) % 3}").alias("q"))
            for j in range(3)
        ]
    )
    return faces.select(M, "face", F.inline(rows))


def across_edges(faces: DataFrame) -> DataFrame:
    """Neighbour face across every edge: ``(mesh_id, face, slot, p, q, nbr)``, NULL on the boundary.

    The neighbour has the same edge in the opposite direction.  Faces are first reduced to the lowest two
    per directed edge, so an edge shared by very many faces yields one match per face, not pairs; the second
    one serves a degenerate face that holds the edge in both directions and is not its own neighbour.
    """
    e = directed_edges(faces)
    lowest = e.groupBy(M, F.col("q").alias("p"), F.col("p").alias("q")).agg(F.min("face").alias("_one"))
    rest = e.select(M, "face", F.col("q").alias("p"), F.col("p").alias("q")).join(dealt(lowest), [M, "p", "q"])
    second = rest.filter(F.col("face") != F.col("_one")).groupBy(M, "p", "q").agg(F.min("face").alias("_two"))
    found = e.join(dealt(lowest), [M, "p", "q"], "left").join(dealt(second), [M, "p", "q"], "left")
    nbr = F.when(F.col("_one") != F.col("face"), F.col("_one")).otherwise(F.col("_two"))
    return found.select(M, "face", "slot", "p", "q", nbr.alias("nbr"))


def face_graph(across: DataFrame, geometry: DataFrame, vertices: DataFrame) -> DataFrame:
    """Directed face edges ``(mesh_id, i, slot, j, w)`` weighted by the path over the edge midpoint."""
    g = geometry.select(M, F.col("face"), "gx", "gy", "gz")
    v = vertices.select(M, "v", "x", "y", "z")
    inner = across.filter(F.col("nbr").isNotNull())
    ends = (
        inner.join(dealt(v.selectExpr(M, "v as p", "x as px", "y as py", "z as pz")), [M, "p"])
        .join(dealt(v.selectExpr(M, "v as q", "x as qx", "y as qy", "z as qz")), [M, "q"])
        .join(dealt(g), [M, "face"])
        .join(dealt(g.selectExpr(M, "face as nbr", "gx as hx", "gy as hy", "gz as hz")), [M, "nbr"])
    )
    mid = tuple((p + q) * 0.5 for p, q in zip(vec3("p"), vec3("q")))
    w = len3(sub3(vec3("g"), mid)) + len3(sub3(vec3("h"), mid))
    return ends.select(M, F.col("face").alias("i"), "slot", F.col("nbr").alias("j"), w.alias("w"))


def adjacency_rows(across: DataFrame) -> DataFrame:
    """``face n0 n1 n2`` rows for export; a boundary edge names the face itself."""
    nbr = F.coalesce("nbr", "face")
    return across.groupBy(M, "face").agg(
        *[F.max(F.when(F.col("slot") == i, nbr)).alias(f"n{i}") for i in range(3)]
    )


def vertex_neighbours(faces: DataFrame) -> DataFrame:
    """Distinct directed vertex pairs ``(mesh_id, i, j)`` that share an edge."""
    e = directed_edges(faces).select(M, F.col("p").alias("i"), F.col("q").alias("j"))
    both = e.unionByName(e.select(M, F.col("j").alias("i"), F.col("i").alias("j")))
    return both.distinct()


def vertex_faces(faces: DataFrame) -> DataFrame:
    return corners(faces).select(M, "v", "face")


def dihedral_angles(across: DataFrame, geometry: DataFrame, vertices: DataFrame) -> DataFrame:
    """Signed angle between the two face normals at an edge, mapped to ``(pi + angle) / pi``.

    The sign follows the turn from the face to its neighbour around the edge ``p -> q``.
    """
    g = geometry.select(M, "face", "rx", "ry", "rz")
    h = g.selectExpr(M, "face as nbr", "rx as hx", "ry as hy", "rz as hz")
    v = vertices.select(M, "v", "x", "y", "z")
    both = (
        across.filter(F.col("nbr").isNotNull())
        .join(dealt(g), [M, "face"])
        .join(dealt(h), [M, "nbr"])
        .join(dealt(v.selectExpr(M, "v as p", "x as px", "y as py", "z as pz")), [M, "p"])
        .join(dealt(v.selectExpr(M, "v as q", "x as qx", "y as qy", "z as qz")), [M, "q"])
    )
    turn = cross3(vec3("r"), vec3("h"))
    size = F.atan2(len3(turn), dot3(vec3("r"), vec3("h")))
    signed = size * sgn(dot3(turn, sub3(vec3("q"), vec3("p"))))
    return both.select(M, "face", "slot", "nbr", ((math.pi + signed) / math.pi).alias("angle"))


# ------------------------------------------------------------------ whole-mesh statistics


def bounding_box(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(M).agg(
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    )


def mass_centre(geometry: DataFrame) -> DataFrame:
    return geometry.groupBy(M).agg(
        *[weighted_mean(F.col(f"g{k}"), F.col("area")).alias(f"m{k}") for k in "xyz"],
        F.sum("area").alias("total_area"),
    )


def covariance(geometry: DataFrame) -> DataFrame:
    """Area-weighted covariance of the face centres around the centre of mass."""
    rows = geometry.join(mass_centre(geometry), M)
    d = sub3(vec3("g"), vec3("m"))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return rows.groupBy(M).agg(
        *[weighted_mean(d[i] * d[j], F.col("area")).alias(f"c{'xyz'[i]}{'xyz'[j]}") for i, j in pairs]
    )


def mesh_scale(geometry: DataFrame, **kw) -> DataFrame:
    """Per mesh: centre of mass and the scale used to normalise it."""
    centre = mass_centre(geometry)
    d = geometry.join(centre, M).withColumn("_d", len3(sub3(vec3("g"), vec3("m"))))
    pct = floor_percentiles(d, [M], "_d", {"_p": SCALE_PERCENTILE}, **kw)
    scale = F.col("_p") * (0.5 / SCALE_PERCENTILE)
    return centre.join(pct, M).withColumn("scale", scale).drop("_p")


def normalise(vertices: DataFrame, scale: DataFrame) -> DataFrame:
    """Move the centre of mass to the origin and divide by the scale (one row per mesh)."""
    v = vertices.join(scale.select(M, "mx", "my", "mz", "scale"), M)
    return v.select(M, "v", *[(F.when(F.col("scale") > 0, (F.col(k) - F.col(f"m{k}")) / F.col("scale")).otherwise(0.0)).alias(k) for k in "xyz"])


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select(M, "v", "x", "y", "z")
    e = directed_edges(faces)
    ends = e.join(dealt(v.selectExpr(M, "v as p", "x as px", "y as py", "z as pz")), [M, "p"]).join(
        dealt(v.selectExpr(M, "v as q", "x as qx", "y as qy", "z as qz")), [M, "q"]
    )
    return ends.select(M, "face", "slot", "p", "q", len3(sub3(vec3("p"), vec3("q"))).alias("length"))


# ------------------------------------------------------------------ editing


def keep_vertices(vertices: DataFrame, faces: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Drop vertices failing ``keep`` and the faces using them; ids become dense again."""
    kept = running(vertices.filter(keep), [M], "v", "v", pos="new_v")
    ids = kept.select(M, "v", "new_v")
    c = corners(faces).join(dealt(ids), [M, "v"])
    f = c.groupBy(M, "face").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col("slot") == i, F.col("new_v"))).alias(f"v{i}") for i in range(3)],
    )
    f = running(f.filter("_n = 3").drop("_n"), [M], "face", "face", pos="new_face")
    new_v = kept.select(M, F.col("new_v").alias("v"), "x", "y", "z")
    return new_v, f.select(M, F.col("new_face").alias("face"), "v0", "v1", "v2")


def drop_unused_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    used = corners(faces).select(M, "v").distinct()
    return keep_vertices(vertices.join(dealt(used), [M, "v"], "left_semi"), faces, F.lit(True))


def sliver_faces(faces: DataFrame, vertices: DataFrame, feature_size: float) -> DataFrame:
    """Faces that are long and skinny: the longest edge is large and its opposite corner almost flat."""
    f = face_points(faces, vertices)
    a, b, c = vec3("a"), vec3("b"), vec3("c")
    sides = [(a, b, c), (b, c, a), (c, a, b)]
    bad = F.lit(False)
    for apex, left, right in sides:
        e1, e2 = sub3(left, apex), sub3(right, apex)
        cos2 = dot3(e1, e2) * dot3(e1, e2) / (dot3(e1, e1) * dot3(e2, e2))
        long = F.greatest(dot3(e1, e1), dot3(e2, e2)) >= (4 * feature_size) ** 2
        bad = bad | (long & (cos2 >= 0.85))
    return f.filter(bad).select(M, "face")


def flip_faces(faces: DataFrame) -> DataFrame:
    return faces.select(M, "face", F.col("v2").alias("v0"), "v1", F.col("v0").alias("v2"))


def erode(faces: DataFrame) -> DataFrame:
    """Remove every face that touches the boundary."""
    rim = across_edges(faces).filter(F.col("nbr").isNull())
    pts = rim.select(M, F.explode(F.array("p", "q")).alias("v")).distinct()
    touched = corners(faces).join(dealt(pts), [M, "v"], "left_semi").select(M, "face").distinct()
    return faces.join(dealt(touched), [M, "face"], "left_anti")


def transform(vertices: DataFrame, matrix: list[list[float]]) -> DataFrame:
    from facetry.functions.vectors import transform3

    p = transform3((F.col("x"), F.col("y"), F.col("z")), matrix)
    return vertices.select(M, "v", *[c.alias(k) for c, k in zip(p, "xyz")])


def inflate(vertices: DataFrame, normals: DataFrame, amount: float) -> DataFrame:
    """Move every vertex along its normal."""
    moved = [(F.col(k) + F.col(f"n{k}") * amount).alias(k) for k in "xyz"]
    return vertices.join(dealt(normals), [M, "v"]).select(M, "v", *moved)


def noisify(vertices: DataFrame, normals: DataFrame, amount: float, seed: int) -> DataFrame:
    """Reproducible pseudo-random displacement along the normal."""
    r = F.pmod(F.xxhash64(M, "v", F.lit(seed)), F.lit(2_000_001)) / 1e6 - 1.0
    moved = [(F.col(k) + F.col(f"n{k}") * r * amount).alias(k) for k in "xyz"]
    return vertices.join(dealt(normals), [M, "v"]).select(M, "v", *moved)


def smooth(vertices: DataFrame, faces: DataFrame, step: float = 0.5, rounds: int = 1, boundary_fixed: bool = True) -> DataFrame:
    """Umbrella smoothing: move each vertex towards the mean of its neighbours, all at once per round."""
    from facetry.session import cut

    nb = vertex_neighbours(faces)
    rim = across_edges(faces).filter(F.col("nbr").isNull())
    fixed = rim.select(M, F.explode(F.array("p", "q")).alias("v")).distinct().withColumn("_fixed", F.lit(True))
    if rounds > 1:
        nb, fixed = cut(nb), cut(fixed)
    out = vertices
    for k in range(rounds):
        pos = out.select(M, F.col("v").alias("j"), "x", "y", "z")
        mean = nb.join(dealt(pos), [M, "j"]).groupBy(M, F.col("i").alias("v")).agg(
            *[F.avg(c).alias(f"_{c}") for c in "xyz"]
        )
        rows = out.join(dealt(mean), [M, "v"], "left").join(dealt(fixed), [M, "v"], "left")
        still = F.col("_x").isNull()
        if boundary_fixed:
            still = still | F.coalesce("_fixed", F.lit(False))
        out = rows.select(
            M,
            "v",
            *[F.when(still, F.col(c)).otherwise(F.col(c) + step * (F.col(f"_{c}") - F.col(c))).alias(c) for c in "xyz"],
        )
        if (k + 1) % 4 == 0:
            out = cut(out)
    return out


def taubin(vertices: DataFrame, faces: DataFrame, shrink: float = 0.5, grow: float = -0.53, rounds: int = 1) -> DataFrame:
    """Alternating shrink and inflate steps."""
    out = vertices
    for _ in range(rounds):
        out = smooth(smooth(out, faces, shrink), faces, grow)
    return out


def subdivide(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planar subdivision: every face becomes four; a shared edge gets one midpoint vertex."""
    n = vertices.groupBy(M).agg((F.max("v") + 1).alias("_n"))
    e = directed_edges(faces).select(
        M, "face", "slot", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")
    )
    first = e.groupBy(M, "lo", "hi").agg(F.min(F.col("face") * 3 + F.col("slot")).alias("_first"))
    mids = running(first, [M], "_first", "_first", pos="_m").join(n, M)
    mids = mids.select(M, "lo", "hi", (F.col("_m") + F.col("_n")).alias("m"))
    p = vertices.select(M, "v", "x", "y", "z")
    a = p.selectExpr(M, "v as lo", "x as ax", "y as ay", "z as az")
    b = p.selectExpr(M, "v as hi", "x as bx", "y as by", "z as bz")
    new = mids.join(dealt(a), [M, "lo"]).join(dealt(b), [M, "hi"])
    new = new.select(M, F.col("m").alias("v"), *[((F.col(f"a{k}") + F.col(f"b{k}")) / 2).alias(k) for k in "xyz"])
    per_face = e.join(dealt(mids), [M, "lo", "hi"]).groupBy(M, "face").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("m"))).alias(f"m{i}") for i in range(3)]
    )
    f = faces.join(dealt(per_face), [M, "face"])
    parts = [("v0", "m2", "m1"), ("m2", "v1", "m0"), ("m1", "m0", "v2"), ("m0", "m1", "m2")]
    rows = F.array(
        *[
            F.struct(
                (F.col("face") * 4 + k).alias("face"),
                *[F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate(part)],
            )
            for k, part in enumerate(parts)
        ]
    )
    return p.withColumn("v", F.col("v").cast("long")).unionByName(new), f.select(M, F.inline(rows))


def reorder_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Old-to-new vertex ids in the order of first reference by the faces."""
    seen = corners(faces).groupBy(M, "v").agg(F.min(F.col("face") * 3 + F.col("slot")).alias("_first"))
    return running(seen, [M], "_first", "_first", pos="new_v").select(M, "v", "new_v")


def orient(faces: DataFrame) -> DataFrame:
    """Flip faces so that all faces of a connected piece wind like its lowest face.

    Each face stands for two nodes, as it is and flipped; a shared edge links the states that agree.
    The connected component that holds the lowest face unflipped names every face's state, in a
    logarithmic number of rounds.  Pieces that cannot be oriented are left alone.
    """
    from facetry.operators.hops import components

    e = directed_edges(faces).select(
        M, "face", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") < F.col("q")).alias("up")
    )
    # every face is linked to the lowest face of an edge, so crowded edges make stars, not pairs
    lead = e.groupBy(M, "lo", "hi").agg(F.min("face").alias("lead"), F.min_by("up", "face").alias("lead_up"))
    link = e.join(dealt(lead), [M, "lo", "hi"]).filter(F.col("face") != F.col("lead"))
    clash = (F.col("up") == F.col("lead_up")).cast("long")
    two = F.array(
        *[F.struct((F.col("face") * 2 + s).alias("i"), (F.col("lead") * 2 + (clash if s == 0 else 1 - clash)).alias("j")) for s in (0, 1)]
    )
    states = faces.select(M, F.explode(F.array(F.col("face") * 2, F.col("face") * 2 + 1)).alias("node"))
    root = components(link.select(M, F.inline(two)), states, [M])
    kept = root.filter(F.col("node") % 2 == 0).select(M, (F.col("node") / 2).cast("long").alias("face"), F.col("root").alias("_a"))
    other = root.filter(F.col("node") % 2 == 1).select(M, F.floor(F.col("node") / 2).alias("face"), F.col("root").alias("_b"))
    flip = (F.col("_a") != F.col("_b")) & (F.col("_a") % 2 == 1)
    rows = faces.join(dealt(kept), [M, "face"]).join(dealt(other), [M, "face"])
    return rows.select(
        M, "face", F.when(flip, F.col("v2")).otherwise(F.col("v0")).alias("v0"), "v1",
        F.when(flip, F.col("v0")).otherwise(F.col("v2")).alias("v2"),
    )


def _solve_tensor(frame_edges, frame_changes) -> tuple[Column, Column, Column]:
    """Symmetric 2x2 ``W`` with least squared error of ``W e = d`` over the edges of a triangle.

    With ``A = sum(e e')`` and ``C = sum(d e' + e d')`` the normal equations are ``W A + A W = C``; for 2x2 matrices
    their solution is ``(det(A) C + adj(A) C adj(A)) / (2 tr(A) det(A))``.
    """
    total = lambda terms: sum(terms, F.lit(0.0))
    a, b, d = (total(e[i] * e[j] for e in frame_edges) for i, j in ((0, 0), (0, 1), (1, 1)))
    both = list(zip(frame_edges, frame_changes))
    c = 2 * total(x[0] * e[0] for e, x in both)
    f = total(x[0] * e[1] + x[1] * e[0] for e, x in both)
    g = 2 * total(x[1] * e[1] for e, x in both)
    det = a * d - b * b
    scale = 2 * (a + d) * det
    entries = (
        det * c + d * d * c - 2 * b * d * f + b * b * g,
        det * f - b * d * c + (a * d + b * b) * f - a * b * g,
        det * g + b * b * c - 2 * a * b * f + a * a * g,
    )
    return tuple(F.when(F.abs(scale) > 1e-30, x / scale).otherwise(0.0) for x in entries)


def _tangents(n: Vec3) -> tuple[Vec3, Vec3]:
    """Two unit vectors at right angles to ``n`` and to each other, from the axis ``n`` is farthest from."""
    size = [F.abs(c) for c in n]
    along_x, along_y = (size[0] <= size[1]) & (size[0] <= size[2]), size[1] <= size[2]
    axis = tuple(
        F.when(along_x, F.lit(float(k == 0))).when(along_y, F.lit(float(k == 1))).otherwise(F.lit(float(k == 2)))
        for k in range(3)
    )
    p = cross3(n, axis)
    length = len3(p)
    p = tuple(F.when(length > 0, c / length).otherwise(0.0) for c in p)
    return p, cross3(n, p)


def principal_curvatures(geometry: DataFrame, normals: DataFrame) -> DataFrame:
    """``(mesh_id, v, k1, k2, d1x.., d2x..)``: signed vertex curvatures with ``k1 >= k2`` and their directions.

    Every face gets the tensor that explains best how the vertex normals change along its edges, as one
    symmetric 3x3 matrix in world axes.  At a corner, the vertex's tangent plane is turned into the plane of the
    face by Rodrigues' rotation about the cross product of the two normals, and the tensor is read off along
    the turned tangents.  A vertex averages its corners by their nearest area.
    """
    axes = "xyz"
    g = geometry
    for i, c in enumerate("abc"):
        mine = normals.select(M, F.col("v").alias(f"v{i}"), *[F.col(f"n{k}").alias(f"{c}n{k}") for k in axes])
        g = g.join(dealt(mine), [M, f"v{i}"])

    def put(df, **vectors):
        return df.withColumns({f"{n}{k}": c for n, v in vectors.items() for k, c in zip(axes, v)})

    point = [vec3(c) for c in "abc"]
    normal = [tuple(F.col(f"{c}n{k}") for k in axes) for c in "abc"]
    face_normal = tuple(_unit(vec3("r"), ["x", "y", "z"]).values())
    g = put(g, f_=face_normal)
    t, b = _tangents(vec3("f_"))
    g = put(g, t_=t, b_=b)
    flat = lambda v: (dot3(v, vec3("t_")), dot3(v, vec3("b_")))
    sides = [(0, 1), (1, 2), (2, 0)]
    w = _solve_tensor(
        [flat(sub3(point[j], point[i])) for i, j in sides], [flat(sub3(normal[j], normal[i])) for i, j in sides]
    )
    g = g.withColumns({"_w0": w[0], "_w1": w[1], "_w2": w[2]})
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    tv, bv = vec3("t_"), vec3("b_")
    world = {
        f"_s{i}{j}": F.col("_w0") * tv[i] * tv[j]
        + F.col("_w1") * (tv[i] * bv[j] + bv[i] * tv[j])
        + F.col("_w2") * bv[i] * bv[j]
        for i, j in pairs
    }
    g = g.withColumns(world)
    share = corner_areas(g)
    corner = F.array(*[F.struct(F.col(f"v{i}").alias("v"), share[i].alias("w")) for i in range(3)])
    c = g.select(M, *[f"f_{k}" for k in axes], *world, F.inline(corner))
    frame = normals.select(M, "v", "nx", "ny", "nz")
    p, q = _tangents(vec3("n"))
    frame = put(frame, p_=p, q_=q)
    c = c.join(dealt(frame), [M, "v"])
    turn, cosine = cross3(vec3("n"), vec3("f_")), dot3(vec3("n"), vec3("f_"))

    def turned(x: Vec3) -> Vec3:
        swept, along = cross3(turn, x), dot3(turn, x)
        # opposite normals leave the axis open: half a turn about the other tangent reverses the vector
        return tuple(
            F.when(cosine <= -1 + 1e-12, -x[k]).otherwise(x[k] * cosine + swept[k] + turn[k] * along / (1 + cosine))
            for k in range(3)
        )

    c = put(c, u_=turned(vec3("p_")), v_=turned(vec3("q_")))
    tensor = [[F.col(f"_s{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    times = lambda x: tuple(dot3(tuple(row), x) for row in tensor)
    u, v = vec3("u_"), vec3("v_")
    s = c.groupBy(M, "v").agg(
        weighted_mean(dot3(u, times(u)), F.col("w")).alias("_a"),
        weighted_mean(dot3(u, times(v)), F.col("w")).alias("_b"),
        weighted_mean(dot3(v, times(v)), F.col("w")).alias("_c"),
    )
    # eigenvalues and half-angle of the averaged 2x2 tensor
    a, off, d = F.col("_a"), F.col("_b"), F.col("_c")
    mean, spread = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + off * off)
    angle = F.atan2(2 * off, a - d) / 2
    s = s.withColumns({"k1": mean + spread, "k2": mean - spread, "_angle": angle}).join(dealt(frame), [M, "v"])
    s = put(s, d1=tuple(F.cos("_angle") * x + F.sin("_angle") * y for x, y in zip(vec3("p_"), vec3("q_"))))
    s = put(s, d2=cross3(vec3("n"), vec3("d1")))
    return s.select(M, "v", "k1", "k2", *[f"d{i}{k}" for i in (1, 2) for k in axes])
