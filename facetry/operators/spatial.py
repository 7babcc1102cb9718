"""Spatial operators on points and meshes: overlap, rays, point normals, part axes, diffusion."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import log_rescale, sgn
from facetry.functions.vectors import cross3, dot3, sub3, vec3
from facetry.operators import mesh
from facetry.operators.cells import PER_CELL, ray_hits
from facetry.operators.derivatives import carried
from facetry.operators.neighbours import knn
from facetry.operators.ordered import at_position, cumulate
from facetry.operators.stats import (
    power_mean_columns,
    scale_to_max,
    symmetric3_eigenvalues,
    symmetric3_eigenvector,
    weighted_mean,
    winsorise_signed,
)
from facetry.session import cut, dealt, forget

M = "mesh_id"

# Grid cells per side of the overlap test; cone angles, rotation steps and log bases of the ray descriptors.
GRID_CELLS = 16
CONES = [15.0, 30.0, 45.0]
CONE_STEP = 15.0
TURN_STEP = 45.0
VISIBLE_STEP = 45.0
LOG_BASES = [2, 4, 8]
OUTLIER_PERCENTILE = 0.95
MIN_PART_POINTS = 10
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def overlap(points: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``points(x, y, z)`` that fall in an occupied cell of the other cloud's grid.

    Only the set of occupied cells (at most 16^3) takes part, never pairs of points.
    """
    box = other.agg(
        F.struct(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")
    ).scalar()
    side = F.greatest(*[F.col("_b")[f"hi{c}"] - F.col("_b")[f"lo{c}"] for c in "xyz"])

    def cell(c):
        at = F.floor(GRID_CELLS / side * (F.col(c) - F.col("_b")[f"lo{c}"]))
        return F.least(at, F.lit(GRID_CELLS - 1)).alias(f"_c{c}")

    cells = [cell(c) for c in "xyz"]
    names = [f"_c{c}" for c in "xyz"]
    taken = other.withColumn("_b", box).select(*cells).distinct()
    rows = points.withColumn("_b", box)
    for c in "xyz":
        rows = rows.filter((F.col(c) > F.col("_b")[f"lo{c}"]) & (F.col(c) < F.col("_b")[f"hi{c}"]))
    rows = rows.select("*", *cells)
    return rows.join(taken, names, "left_semi").drop("_b", *names)


# Fixed value: below so many neighbours a point has no normal of its own.
MIN_NORMAL_POINTS = 3


def point_normals(points: DataFrame, key: str, vector: str, k: int = 12) -> DataFrame:
    """Normals of a point cloud: direction of least spread of the ``k`` nearest neighbours around the point itself.

    Normals look towards +z; a point with fewer than three neighbours gets +z itself.
    """
    near = knn(points, key, vector, k)
    v = F.col(vector).cast("array<double>")
    place = points.select(F.col(key).cast("long").alias("id"), *[v[i].alias(c) for i, c in enumerate("xyz")])
    rows = near.join(place.withColumnRenamed("id", "dst"), "dst").join(
        place.select(F.col("id").alias("src"), *[F.col(c).alias(f"o{c}") for c in "xyz"]), "src"
    )
    d = sub3(vec3(""), vec3("o"))
    m = rows.groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(d[i] * d[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    )
    entries = [F.col(f"c{i}{j}") for i, j in PAIRS]
    m = m.withColumn("_low", symmetric3_eigenvalues(*entries)[0])
    normal = symmetric3_eigenvector(*entries, F.col("_low"))
    m = m.withColumns({f"_n{c}": e for c, e in zip("xyz", normal)})
    enough = F.coalesce(F.col("n") >= MIN_NORMAL_POINTS, F.lit(False))
    up = {"x": 0.0, "y": 0.0, "z": 1.0}
    sign = F.when(F.col("_nz") < 0, -1.0).otherwise(1.0)
    out = place.select("id").join(m, place["id"] == m["src"], "left")
    return out.select(
        F.col("id").alias(key),
        *[F.when(enough, F.col(f"_n{c}") * sign).otherwise(up[c]).alias(f"n{c}") for c in "xyz"],
    )


# ------------------------------------------------------------------ rays


def ray_distances(rays: DataFrame, triangles: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """Distance from every ray to the first triangle it meets: ``(mesh_id, ray, d)``; no row without a hit.

    ``rays(mesh_id, ray, skip, ox.., lx..)`` with unit directions; the face ``skip`` is ignored.
    ``triangles(mesh_id, face, ax .. cz)``.  Rays walk a grid of cells and meet only the triangles listed there.
    """
    tri = triangles.select(M, "face", *[f"{p}{c}" for p in "abc" for c in "xyz"])
    return ray_hits(rays, tri, [M], per_cell).select(M, "ray", "d")


def cone_rays(origins: DataFrame, angles: list[float], turn: float) -> DataFrame:
    """Rays on cones around an axis: ``origins(mesh_id, face, ox.., vx.., ux..)``, unit ``v`` and ``u`` with ``u`` orthogonal to ``v``.

    Ids count faces, cones and turns: ``ray = (face * len(angles) + cone) * turns + turn``.
    """
    turns = int(round(360 / turn))
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("cone"), F.lit(j).alias("turn"), F.lit(math.radians(a)).alias("tilt"), F.lit(math.radians(j * turn)).alias("spin"))
            for i, a in enumerate(angles)
            for j in range(turns)
        ]
    )
    rows = origins.select("*", F.inline(steps))
    v, u = vec3("v"), vec3("u")
    w = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    tilt, spin = F.col("tilt"), F.col("spin")
    # tilt the axis about u, then turn the result about the axis
    w2 = (v[1] * w[2] - v[2] * w[1], v[2] * w[0] - v[0] * w[2], v[0] * w[1] - v[1] * w[0])
    line = [F.cos(tilt) * v[i] + F.sin(tilt) * (F.cos(spin) * w[i] + F.sin(spin) * w2[i]) for i in range(3)]
    ray = (F.col("face") * len(angles) + F.col("cone")) * turns + F.col("turn")
    return rows.select(
        M, ray.cast("long").alias("ray"), "face", "cone", "turn", "ox", "oy", "oz", *[c.alias(f"l{k}") for c, k in zip(line, "xyz")]
    )


def _ray_statistics(hits: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Mean, mean square, mean 4th power, mean root, mean 4th root and median per key."""
    p = power_mean_columns(F.col("d"))
    means = hits.groupBy(*keys).agg(F.avg("d").alias("mean"), *[c.alias(n) for n, c in p.items()])
    cum = cumulate(hits, keys, "d", {"n": F.lit(1)}, **kw)
    total = F.col("total_n")
    mid = at_position(cum, keys, "d", "n", {"_lo": F.floor((total - 1) / 2), "_hi": F.floor(total / 2)})
    return means.join(dealt(mid), keys).withColumn("median", (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")


STATS = ["mean", "mean2", "mean4", "meansqrt", "meansqrtsqrt", "median"]


def _finish(stats: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Clip outliers, divide by the maximum, add the logarithmic versions."""
    long = stats.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("raw")) for n in STATS])))
    by = [M, *[k for k in keys if k not in (M, "face")], "stat"]
    clipped = winsorise_signed(long, by, "raw", OUTLIER_PERCENTILE, "_c")
    scaled = scale_to_max(clipped, by, "_c", out)
    return scaled.select(*keys, "stat", out, *[log_rescale(F.col(out), b).alias(f"{out}_log{b}") for b in LOG_BASES])


def _frames(geometry: DataFrame, normals: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """Origin at the face centre, axis against the normal, and a side direction orthogonal to it.

    With ``directions`` (vertex curvatures) the side follows the corners' main curvature directions,
    each turned to agree with those before it; otherwise it follows the face's first edge.
    """
    g = geometry.join(dealt(normals), [M, "face"])
    axis = tuple(-c for c in vec3("n"))
    if directions is None:
        e = sub3(vec3("b"), vec3("a"))
        along = dot3(e, vec3("n"))
        side = tuple(c - along * n for c, n in zip(e, vec3("n")))
    else:
        names = [f"d1{k}" for k in "xyz"]
        for i in range(3):
            at = directions.select(M, F.col("v").alias(f"v{i}"), *[F.col(n).alias(f"_p{i}{k}") for n, k in zip(names, "xyz")])
            g = g.join(dealt(at), [M, f"v{i}"])
        main = vec3("_p0")
        for i, against in ((1, vec3("_p0")), (2, None)):
            p = vec3(f"_p{i}")
            turn = sgn(dot3(main if against is None else against, p))
            main = tuple(m + turn * c for m, c in zip(main, p))
        side = cross3(main, axis)
    g = g.withColumns({f"u{k}": c for k, c in zip("xyz", side)})
    size = F.sqrt(dot3(vec3("u"), vec3("u")))
    return g.select(
        M, "face", *[F.col(f"g{k}").alias(f"o{k}") for k in "xyz"], *[c.alias(f"v{k}") for c, k in zip(axis, "xyz")],
        *[F.when(size > 0, F.col(f"u{k}") / size).otherwise(0.0).alias(f"u{k}") for k in "xyz"],
    )


def _cast(rays: DataFrame, geometry: DataFrame, vertices: DataFrame, skip: Column) -> DataFrame:
    """Ray lengths; a ray that meets nothing gets the diagonal of the bounding box."""
    box = mesh.bounding_box(vertices)
    gap2 = sum(((F.col(f"max_{k}") - F.col(f"min_{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    diagonal = box.select(M, F.sqrt(gap2).alias("_diag"))
    hits = ray_distances(rays.withColumn("skip", skip), geometry)
    out = rays.select(M, "ray", "face", "cone").join(dealt(hits), [M, "ray"], "left").join(diagonal, M)
    return out.select(M, "face", "cone", F.least(F.coalesce("d", "_diag"), F.col("_diag")).alias("d"))


def shape_diameter(geometry, normals, vertices, directions: DataFrame | None = None) -> DataFrame:
    """Inside distances over nested cones: ``(mesh_id, face, cone, stat, sdf, sdf_log..)``.

    Cone ``c`` uses all rays up to its angle.  The nearest hit is exact.
    """
    step_count = int(CONES[-1] / CONE_STEP) + 1
    rays = cut(cone_rays(_frames(geometry, normals, directions), [i * CONE_STEP for i in range(step_count)], TURN_STEP))
    hits = cut(_cast(rays, geometry, vertices, F.col("face")))
    reach = [int(c / CONE_STEP) for c in CONES]
    nested = F.filter(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(r).alias("r")) for i, r in enumerate(reach)]), lambda s: s["r"] >= F.col("cone"))
    long = hits.select(M, "face", "d", F.explode(nested).alias("s")).select(M, "face", F.col("s.c").alias("cone"), "d")
    return _finish(cut(_ray_statistics(long, [M, "face", "cone"])), [M, "face", "cone"], "sdf")


def visible_shape(geometry, normals, vertices, directions: DataFrame | None = None) -> DataFrame:
    """Distances seen from the middle of the local thickness: ``(mesh_id, face, stat, vsi, vsi_log..)``."""
    frames = cut(_frames(geometry, normals, directions))
    step_count = int(CONES[-1] / CONE_STEP) + 1
    inside = cut(cone_rays(frames, [i * CONE_STEP for i in range(step_count)], TURN_STEP))
    half = _cast(inside, geometry, vertices, F.col("face")).groupBy(M, "face").agg((F.min("d") / 2).alias("_half"))
    half = cut(half)
    moved = frames.join(dealt(half), [M, "face"]).select(
        M, "face", *[(F.col(f"o{k}") + F.col("_half") * F.col(f"v{k}")).alias(f"o{k}") for k in "xyz"],
        "vx", "vy", "vz", "ux", "uy", "uz",
    )
    angles = [a * VISIBLE_STEP for a in range(1, int(180 / VISIBLE_STEP))]
    rays = cut(cone_rays(moved, angles, VISIBLE_STEP))
    hits = _cast(rays, geometry, vertices, F.lit(-1).cast("long")).select(M, "face", "d")
    own = half.select(M, "face", F.col("_half").alias("d"))
    return _finish(cut(_ray_statistics(hits.unionByName(own), [M, "face"])), [M, "face"], "vsi")


# ------------------------------------------------------------------ parts and diffusion


def part_axes(points: DataFrame, group: list[str], weight: str = "w", whole: list[str] | None = None, **kw) -> DataFrame:
    """Principal axes of every part: ``(group, axis, ax, ay, az, spread, extent)``.

    ``points(group, x, y, z, w)``.  Axes are ranked by the weighted median of the absolute projection,
    narrowest first (axis 0); ``extent`` is the length, along the axis, of the whole the part belongs to: all
    points with the same ``whole`` columns (a subset of ``group``; by default all but the last).  Parts with
    fewer than ten points have none.
    """
    whole = group[:-1] if whole is None else whole
    if not whole:
        raise ValueError("parts need a whole to belong to: name the columns that parts of one mesh share")
    w = F.col(weight)
    g = [F.col(c) for c in "xyz"]
    m = points.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"), *[F.sum(c * w).alias(f"_s{i}") for i, c in enumerate(g)],
        *[F.sum(g[i] * g[j] * w).alias(f"_q{i}{j}") for i, j in PAIRS],
    ).filter(F.col("_n") >= MIN_PART_POINTS)
    mean = [F.col(f"_s{i}") / F.col("_w") for i in range(3)]
    m = m.select(
        *group, *[c.alias(f"m{k}") for c, k in zip(mean, "xyz")],
        *[(F.col(f"_q{i}{j}") / F.col("_w") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    entries = [F.col(f"c{i}{j}") for i, j in PAIRS]
    m = m.withColumns({f"_e{i}": e for i, e in enumerate(symmetric3_eigenvalues(*entries))})
    vectors = [symmetric3_eigenvector(*entries, F.col(f"_e{i}")) for i in range(3)]
    axes = m.select(
        *group, "mx", "my", "mz",
        F.inline(F.array(*[F.struct(F.lit(i).alias("_k"), *[c.alias(f"a{k}") for c, k in zip(v, "xyz")]) for i, v in enumerate(vectors)])),
    )
    axes = cut(axes)
    p = dot3(sub3(tuple(g), vec3("m")), vec3("a"))
    rows = points.join(axes, group).withColumn("_p", p).withColumn("_mag", F.abs("_p"))
    everything = points.select(*whole, *"xyz")
    extent = everything.join(axes, whole).groupBy(*group, "_k").agg((F.max(p) - F.min(p)).alias("extent"))
    cum = cumulate(rows, [*group, "_k"], "_mag", {"w": w}, **kw)
    spread = cum.filter(F.col("cum_w") / F.col("total_w") >= 0.5).groupBy(*group, "_k").agg(F.min("_mag").alias("spread"))
    ranked = axes.join(dealt(spread), [*group, "_k"]).join(dealt(extent), [*group, "_k"])
    # three axes per part
    order = F.array_sort(F.collect_list(F.struct("spread", "_k", "ax", "ay", "az", "extent")))
    flat = ranked.groupBy(*group).agg(order.alias("_o")).select(*group, F.posexplode("_o").alias("axis", "_a"))
    return flat.select(*group, "axis", *[F.col(f"_a.{c}").alias(c) for c in ("ax", "ay", "az", "spread", "extent")])


def _gated_walk(
    start: DataFrame, steps: DataFrame, left: DataFrame, right: DataFrame, gate: Column,
    carry: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
) -> DataFrame:
    """``(mesh_id, src, node)``: nodes met from each source along ``steps(mesh_id, i, j)`` through nodes that pass ``gate``.

    ``left(mesh_id, src, ..)`` and ``right(mesh_id, node, ..)`` give the columns that the gate reads, and ``carry`` further columns of
    the result.  With ``sums`` the result is ``(mesh_id, src, nodes, ..)``, one row per source and round with those sums over its nodes.
    Rounds are tables of their own.  If every step has its way back, a node next to those of a round belongs to that round, the
    one before or the next, and no others are looked up; else all are.
    """
    pair = [M, "src", "node"]
    steps = steps.select(M, "i", "j")

    def met(df):
        df = df.join(dealt(right), [M, "node"]).join(dealt(left), [M, "src"]).filter(gate)
        if sums is None:
            return cut(df.select(*pair, *[c.alias(n) for n, c in (carry or {}).items()]))
        # dealt by source already: nothing moves
        return cut(df.groupBy(M, "src").agg(F.collect_list("node").alias("nodes"), *[F.sum(c).alias(n) for n, c in sums.items()]))

    def pairs(df):
        return df.select(pair) if sums is None else df.select(M, "src", F.explode("nodes").alias("node"))

    back = steps.select(M, F.col("j").alias("i"), F.col("i").alias("j"))
    reach = 2 if steps.join(dealt(back), [M, "i", "j"], "left_anti").isEmpty() else 0
    rounds = [met(start)]
    while not rounds[-1].isEmpty():
        step = pairs(rounds[-1]).withColumnRenamed("node", "i").join(dealt(steps), [M, "i"])
        step = step.select(M, "src", F.col("j").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, [pairs(r) for r in rounds[-reach:]])
        rounds.append(met(step.join(dealt(seen), pair, "left_anti")))
    return reduce(DataFrame.unionByName, rounds)


_PLACE = ["x", "y", "z", "nx", "ny", "nz"]


def diffusion_weights(vertices, normals, areas, neighbours, sigma: float) -> DataFrame:
    """``(mesh_id, src, node, w)``: Gaussian in distance, times normal agreement and area; ``src`` itself counts by its area.

    ``neighbours(mesh_id, i, j)`` are the mesh edges.  A vertex takes part if its normal agrees with the
    centre's, it is within three ``sigma``, and a path of such vertices leads to it.
    """
    facts = cut(vertices.join(dealt(normals), [M, "v"]).join(dealt(areas.withColumnRenamed("area", "_area")), [M, "v"]))
    src = facts.select(M, F.col("v").alias("src"), *[F.col(c).alias(f"c{c}") for c in _PLACE])
    node = facts.select(M, F.col("v").alias("node"), *_PLACE, "_area")
    gap = sub3(vec3(""), vec3("c"))
    d2, facing = dot3(gap, gap), dot3(vec3("n"), vec3("cn"))
    own = facts.select(M, F.col("v").alias("src"), F.col("v").alias("node"))
    gate = (F.col("src") == F.col("node")) | ((facing > 0) & (d2 < 9.0 * sigma * sigma))
    kernel = F.exp(-0.5 * d2 / (sigma * sigma)) * facing * F.col("_area")
    w = F.when(F.col("src") == F.col("node"), F.col("_area")).otherwise(kernel)
    return _gated_walk(own, neighbours, src, node, gate, {"w": w})


def _averaged(weights: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """Weighted means of vertex columns, ``(mesh_id, v, names)``."""
    values = fields.select(M, F.col("v").alias("node"), *[F.col(f).alias(f"_f_{f}") for f in names])
    rows = weights.join(dealt(values), [M, "node"])
    return rows.groupBy(M, F.col("src").alias("v")).agg(*[weighted_mean(F.col(f"_f_{f}"), F.col("w")).alias(f) for f in names])


def diffuse(vertices, normals, areas, neighbours, field: list[str], sigma: float) -> DataFrame:
    """Smooth vertex values over the surface; a vertex without neighbours or area keeps its own."""
    new = _averaged(diffusion_weights(vertices, normals, areas, neighbours, sigma), vertices, field)
    new = new.select(M, "v", *[F.col(f).alias(f"_n_{f}") for f in field])
    return vertices.join(dealt(new), [M, "v"], "left").select(M, "v", *[F.coalesce(f"_n_{f}", f).alias(f) for f in field])


def diffuse_normals(vertices, normals, areas, neighbours, sigma: float) -> DataFrame:
    """Unit means of the normals; a mean without length keeps the vertex's own."""
    names = ["nx", "ny", "nz"]
    new = _averaged(diffusion_weights(vertices, normals, areas, neighbours, sigma), normals, names)
    new = new.select(M, "v", *[F.col(n).alias(f"_{n}") for n in names])
    size = F.sqrt(dot3(vec3("_n"), vec3("_n")))
    rows = normals.join(dealt(new), [M, "v"], "left")
    return rows.select(M, "v", *[F.when(size > 0, F.try_divide(f"_{n}", size)).otherwise(F.col(n)).alias(n) for n in names])


def diffuse_curvatures(vertices, normals, areas, neighbours, curvatures, sigma: float) -> DataFrame:
    """Smooth curvature tensors; the columns of ``principal_curvatures``.

    Each vertex's tensor is turned into the tangent plane of the vertex that receives it, along with its normal, and read
    along that vertex's own directions there.
    """
    weights = diffusion_weights(vertices, normals, areas, neighbours, sigma)
    frame = normals.join(dealt(curvatures), [M, "v"])
    columns = [f"{n}{k}" for n in ("n", "d1", "d2") for k in "xyz"]
    given = frame.select(M, F.col("v").alias("node"), "k1", "k2", *columns)
    taken = cut(frame.select(M, F.col("v").alias("src"), *[F.col(c).alias(f"c{c}") for c in columns]))
    rows = weights.join(dealt(given), [M, "node"]).join(dealt(taken), [M, "src"])
    turned = [carried(vec3(f"d{j}"), vec3("n"), vec3("cn")) for j in (1, 2)]
    rows = rows.withColumns({f"_p{i}{j}": dot3(turned[i], vec3(f"cd{j + 1}")) for i in range(2) for j in range(2)})
    part = lambda i, j: sum((F.col(f"k{m + 1}") * F.col(f"_p{m}{i}") * F.col(f"_p{m}{j}") for m in range(2)), F.lit(0.0))
    mean = {n: weighted_mean(part(i, j), F.col("w")).alias(n) for n, (i, j) in (("_a", (0, 0)), ("_b", (0, 1)), ("_c", (1, 1)))}
    s = rows.groupBy(M, "src").agg(*mean.values()).join(dealt(taken), [M, "src"])
    a, off, c = F.col("_a"), F.col("_b"), F.col("_c")
    middle, spread, angle = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + off * off), F.atan2(2 * off, a - c) / 2
    s = s.withColumn("_angle", angle)
    first = [F.cos("_angle") * x + F.sin("_angle") * y for x, y in zip(vec3("cd1"), vec3("cd2"))]
    second = [F.cos("_angle") * y - F.sin("_angle") * x for x, y in zip(vec3("cd1"), vec3("cd2"))]
    return s.select(
        M, F.col("src").alias("v"), (middle + spread).alias("k1"), (middle - spread).alias("k2"),
        *[e.alias(f"d{j}{k}") for j, vec in ((1, first), (2, second)) for e, k in zip(vec, "xyz")],
    )


def _face_pass(places: DataFrame, faces: DataFrame, corners: DataFrame, across: DataFrame, sigma: float, planes: DataFrame | None, width: float) -> DataFrame:
    """One pass of the bilateral filter: faces near a vertex give it their centre, or its foot on their plane."""
    at = {n: corners.select(M, F.col("v").alias(f"v{i}"), *[F.col(k).alias(f"{n}{k}") for k in "xyz"]) for i, n in enumerate("abc")}
    g = faces
    for i, n in enumerate("abc"):
        g = g.join(dealt(at[n]), [M, f"v{i}"])
    normal = cross3(sub3(vec3("b"), vec3("a")), sub3(vec3("c"), vec3("a")))
    centre = [((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(f"g{k}") for k in "xyz"]
    g = g.select(M, F.col("face").alias("node"), *centre, (F.sqrt(dot3(normal, normal)) / 2).alias("area"))
    if planes is not None:
        g = g.join(dealt(planes), [M, "node"])
    g = cut(g)
    src = places.select(M, F.col("v").alias("src"), *[F.col(k).alias(f"o{k}") for k in "xyz"])
    gap = sub3(vec3("o"), vec3("g"))
    d2 = dot3(gap, gap)
    start = faces.select(M, F.explode(F.array("v0", "v1", "v2")).alias("src"), F.col("face").alias("node")).distinct()
    steps = across.select(M, F.col("face").alias("i"), F.col("nbr").alias("j")).filter(F.col("j").isNotNull())
    w = F.exp(-0.5 * d2 / (sigma * sigma)) * F.col("area")
    target = list(vec3("g"))
    if planes is not None:
        height = dot3(gap, vec3("f"))
        w = w * F.when(height * height < 9.0 * width * width, F.exp(-0.5 * height * height / (width * width))).otherwise(0.0)
        target = [o - height * n for o, n in zip(vec3("o"), vec3("f"))]
    sums = {"_w": w} | {f"_t{k}": w * t for t, k in zip(target, "xyz")}
    rows = _gated_walk(start, steps, src, g, d2 < 9.0 * sigma * sigma, sums=sums)
    new = rows.groupBy(M, "src").agg(*[F.try_divide(F.sum(f"_t{k}"), F.sum("_w")).alias(f"_{k}") for k in "xyz"])
    kept = places.join(dealt(new.withColumnRenamed("src", "v")), [M, "v"], "left")
    return kept.select(M, "v", *[F.coalesce(f"_{k}", k).alias(k) for k in "xyz"])


def bilateral_smooth(vertices: DataFrame, faces: DataFrame, across: DataFrame, sigma: float, width: float) -> DataFrame:
    """``(mesh_id, v, x, y, z)`` smoothed while edges stay.

    First every vertex moves to the mean of near face centres, by a Gaussian of ``sigma / 2`` and area; this only
    steadies the planes of the faces.  Then it moves to the mean of its feet on those planes, by a Gaussian of ``sigma`` in the
    distance to the original face and one of ``width`` in the distance to the plane.  ``across(mesh_id, face, nbr)`` are face
    neighbours.  Both passes read unmoved vertices; a vertex without any near face stays.
    """
    base = vertices.select(M, "v", "x", "y", "z")
    steady = cut(_face_pass(base, faces, base, across, sigma / 2, None, width))
    g = faces
    for i, n in enumerate("abc"):
        g = g.join(dealt(steady.select(M, F.col("v").alias(f"v{i}"), *[F.col(k).alias(f"{n}{k}") for k in "xyz"])), [M, f"v{i}"])
    normal = cross3(sub3(vec3("b"), vec3("a")), sub3(vec3("c"), vec3("a")))
    size = F.sqrt(dot3(normal, normal))
    planes = g.select(M, F.col("face").alias("node"), *[F.coalesce(F.try_divide(c, size), F.lit(0.0)).alias(f"f{k}") for c, k in zip(normal, "xyz")])
    return _face_pass(steady, faces, base, across, sigma, cut(planes), width)
