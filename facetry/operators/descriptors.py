"""Per-face shape descriptors: curvature, local PCA, shape context, geodesic statistics, spin images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import EPSILON
from facetry.functions.vectors import cross3, dot3, len3, sub3, vec3
from facetry.operators import hist, hops
from facetry.operators.ordered import cumulate
from facetry.operators.stats import (
    symmetric3_eigenvalues,
    winsorise_signed,
)
from facetry.operators.tiles import TILE_ROWS, tile_product
from facetry.session import dealt

M = "mesh_id"

# The four patch scales and the quantile shares of the geodesic statistics.
SCALES = [1 / 50, 1 / 25, 1 / 10, 1 / 5]
SHARES = [0.1, 0.2, 0.3, 0.4, 0.5]
OUTLIER_PERCENTILE = 0.95


def patches(face_edges: DataFrame, normals: DataFrame, radius: float, at_least: int, min_cosine: float) -> DataFrame:
    """``(mesh_id, src, node, d)``: the surface patch around every face."""
    nodes = normals.select(M, F.col("face").alias("node"), "nx", "ny", "nz")
    edges = face_edges.select(M, "i", "j", "w")
    return hops.gated_distances(edges, nodes, radius, at_least, min_cosine, [M])


def _facts(geometry: DataFrame, prefix: str, key: str, extra: list[str]) -> DataFrame:
    cols = ["gx", "gy", "gz", *extra]
    return geometry.select(M, F.col("face").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def local_pca(patch: DataFrame, geometry: DataFrame) -> DataFrame:
    """Roots of the eigenvalues of the area-weighted scatter of every patch, and their sums and ratios.

    Both the mean and the scatter are divided by the area of the whole mesh.
    """
    total = geometry.groupBy(M).agg(F.sum("area").alias("_total"))
    rows = patch.join(dealt(_facts(geometry, "", "node", ["area"])), [M, "node"])
    g, w = vec3("g"), F.col("area")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = rows.groupBy(M, "src").agg(
        F.sum("area").alias("_a"),
        *[F.sum(g[i] * w).alias(f"_s{i}") for i in range(3)],
        *[F.sum(g[i] * g[j] * w).alias(f"_q{i}{j}") for i, j in pairs],
    ).join(total, M)
    t = F.col("_total")
    mean = [F.col(f"_s{i}") / t for i in range(3)]

    def entry(i, j):
        cross = F.col(f"_q{i}{j}") - mean[i] * F.col(f"_s{j}") - mean[j] * F.col(f"_s{i}") + mean[i] * mean[j] * F.col("_a")
        return cross / t

    sums = sums.select(M, "src", *[entry(i, j).alias(f"c{i}{j}") for i, j in pairs])
    eig = symmetric3_eigenvalues(*[F.col(f"c{i}{j}") for i, j in pairs])
    e = sums.select(M, F.col("src").alias("face"), *[F.sqrt(F.greatest(c, F.lit(0.0))).alias(f"e{i}") for i, c in enumerate(eig)])
    e0, e1, e2 = F.col("e0"), F.col("e1"), F.col("e2")
    r01, r02, r12 = e0 / (e1 + EPSILON), e0 / (e2 + EPSILON), e1 / (e2 + EPSILON)
    values = [e0, e1, e2, e0 + e1, e0 + e2, e1 + e2, r01, r02, r12, r01 + r02, r01 + r12, r02 + r12]
    return e.select(M, "face", *[v.alias(f"f{i}") for i, v in enumerate(values)])


def _clip_columns(df: DataFrame, names: list[str], **kw) -> DataFrame:
    """Clamp magnitudes at the floor percentile of every (mesh, column), all columns in one pass."""
    long = df.select(
        M, "face", F.inline(F.array(*[F.struct(F.lit(n).alias("fid"), F.col(n).alias("val")) for n in names]))
    )
    clipped = winsorise_signed(long, [M, "fid"], "val", OUTLIER_PERCENTILE, "val2", **kw)
    return clipped.groupBy(M, "face").agg(*[F.max(F.when(F.col("fid") == n, F.col("val2"))).alias(n) for n in names])


def pca_descriptor(face_edges, normals, geometry, scales=SCALES, **kw) -> DataFrame:
    """Twelve values per scale; patches reach three times the scale and hold at least ten faces."""
    out = None
    for s, scale in enumerate(scales):
        patch = patches(face_edges, normals, scale * 3.0, 9, -2.0)
        one = _clip_columns(local_pca(patch, geometry), [f"f{i}" for i in range(12)], **kw)
        one = one.withColumnsRenamed({f"f{i}": f"pca{s}_{i}" for i in range(12)})
        out = one if out is None else out.join(dealt(one), [M, "face"])
    return out


def local_curvature(patch: DataFrame, geometry: DataFrame, normals: DataFrame) -> DataFrame:
    """Principal curvatures ``k1 >= k2`` of a quadric fitted to heights and slopes around every face.

    The least-squares system has three unknowns, so each patch is summed to its normal equations and
    solved with Cramer's rule in column arithmetic.
    """
    base = geometry.join(dealt(normals), [M, "face"])
    src = base.select(
        M,
        F.col("face").alias("src"),
        *[F.col(f"g{k}").alias(f"o{k}") for k in "xyz"],
        *[F.col(f"n{k}") for k in "xyz"],
        *[(F.col(f"a{k}") - F.col(f"b{k}")).alias(f"e{k}") for k in "xyz"],
    )
    t = cross3(vec3("e"), vec3("n"))
    size = len3(t)
    src = src.withColumns({f"t{k}": F.when(size > 0, c / size).otherwise(0.0) for k, c in zip("xyz", t)})
    src = src.withColumns({f"s{k}": c for k, c in zip("xyz", cross3(vec3("t"), vec3("n")))}).drop("ex", "ey", "ez")
    other = base.select(
        M, F.col("face").alias("node"), "gx", "gy", "gz", "area", *[F.col(f"n{k}").alias(f"m{k}") for k in "xyz"]
    )
    rows = patch.filter(F.col("src") != F.col("node")).join(dealt(other), [M, "node"]).join(dealt(src), [M, "src"])
    diff, m = sub3(vec3("o"), vec3("g")), vec3("m")
    axes = [vec3("t"), vec3("s"), vec3("n")]
    rows = rows.select(
        M, "src", (F.col("area") * F.col("area")).alias("w"),
        *[dot3(a, diff).alias(c) for a, c in zip(axes, "xyz")],
        *[dot3(a, m).alias(f"m{c}") for a, c in zip(axes, "xyz")],
    )
    x, y, z, w = (F.col(c) for c in "xyzw")
    u, v = -F.col("mx") / (F.col("mz") + EPSILON), -F.col("my") / (F.col("mz") + EPSILON)
    # three equations per neighbour: height, slope along x, slope along y
    design = [((0.5 * x * x, x * y, 0.5 * y * y), z), ((x, y, F.lit(0.0)), u), ((F.lit(0.0), x, y), v)]
    normal = {}
    for i in range(3):
        for j in range(i, 3):
            normal[f"a{i}{j}"] = F.sum(sum((row[i] * row[j] for row, _ in design), F.lit(0.0)) * w)
        normal[f"r{i}"] = F.sum(sum((row[i] * rhs for row, rhs in design), F.lit(0.0)) * w)
    q = rows.groupBy(M, "src").agg(*[c.alias(n) for n, c in normal.items()])
    a = {(i, j): F.col(f"a{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    r = [F.col(f"r{i}") for i in range(3)]
    columns = [tuple(a[i, j] for i in range(3)) for j in range(3)]

    def det(c0, c1, c2):
        return dot3(c0, cross3(c1, c2))

    d = det(*columns)
    q = q.withColumn("_det", d)
    solved = []
    for j in range(3):
        swapped = [tuple(r) if i == j else columns[i] for i in range(3)]
        solved.append(F.when(F.abs("_det") > EPSILON, det(*swapped) / F.col("_det")).otherwise(0.0).alias(f"b{j}"))
    q = q.select(M, F.col("src").alias("face"), *solved)
    trace, bend = F.col("b0") + F.col("b2"), F.col("b0") - F.col("b2")
    root = F.sqrt(bend * bend + 4 * F.col("b1") * F.col("b1"))
    return q.select(M, "face", (0.5 * (trace + root)).alias("k1"), (0.5 * (trace - root)).alias("k2"))


def curvature_values(k: DataFrame) -> DataFrame:
    """Eight combinations of the two curvatures and their absolute values."""
    k1, k2 = F.col("k1"), F.col("k2")
    big = F.when(F.abs(k1) < F.abs(k2), k2).otherwise(k1)
    small = F.when(F.abs(k1) < F.abs(k2), k1).otherwise(k2)
    signed = [k1, k2, k1 - k2, big, small, big - small, (k1 + k2) / 2, k1 * k2]
    both = [*signed, *[F.abs(c) for c in signed]]
    return k.select(M, "face", *[c.alias(f"f{i}") for i, c in enumerate(both)])


def curvature_descriptor(face_edges, across, normals, geometry, scales=SCALES, **kw) -> DataFrame:
    """Sixteen values per scale, clipped, then averaged over the face and its three neighbours."""
    names = [f"f{i}" for i in range(16)]
    three = across.select(M, F.col("face"), F.explode(F.array(F.coalesce("nbr", "face"))).alias("nbr"))
    own = three.select(M, "face").distinct().withColumn("nbr", F.col("face"))
    around = three.unionByName(own)
    out = None
    for s, scale in enumerate(scales):
        patch = patches(face_edges, normals, scale / 2.0, 3, 0.0)
        one = _clip_columns(curvature_values(local_curvature(patch, geometry, normals)), names, **kw)
        held = one.withColumnRenamed("face", "nbr")
        mean = around.join(dealt(held), [M, "nbr"]).groupBy(M, "face").agg(*[F.avg(n).alias(f"cur{s}_{n[1:]}") for n in names])
        out = mean if out is None else out.join(dealt(mean), [M, "face"])
    return out


def geodesic_statistics(paths: DataFrame, areas: DataFrame, **kw) -> DataFrame:
    """Area-weighted power means, central moments and quantile distances of every face's distances.

    ``paths(mesh_id, src, node, d)`` holds the distances that take part, ``areas(mesh_id, face, area)``.
    Values are re-based to the mesh minimum.
    """
    total = areas.groupBy(M).agg(F.sum("area").alias("_total"))
    w = areas.join(total, M).select(M, F.col("face").alias("node"), F.coalesce(F.try_divide("area", "_total"), F.lit(0.0)).alias("w"))
    rows = paths.join(dealt(w), [M, "node"])
    d, w = F.col("d"), F.col("w")
    powers = {"g0": 1.0, "g1": 2.0, "g2": 4.0, "g3": 8.0, "g4": 0.5, "g5": 0.25}
    means = rows.groupBy(M, "src").agg(*[F.sum(F.pow(d, F.lit(p)) * w).alias(n) for n, p in powers.items()])
    gap = d - F.col("g0")
    m = rows.join(dealt(means.select(M, "src", "g0")), [M, "src"]).groupBy(M, "src").agg(
        *[F.sum(F.pow(gap, F.lit(float(p))) * w).alias(f"_m{p}") for p in (2, 3, 4)]
    )
    m2 = F.col("_m2")
    shape = m.select(
        M,
        "src",
        m2.alias("g6"),
        (F.col("_m3") / F.sqrt(m2 * m2 * m2 + EPSILON)).alias("g7"),
        (F.col("_m4") / (m2 * m2 + EPSILON)).alias("g8"),
    )
    cum = cumulate(rows, [M, "src"], "d", {"w": w}, **kw)
    cross = cum.groupBy(M, "src").agg(
        *[F.min(F.when(F.col("cum_w") >= s, F.col("d"))).alias(f"g{9 + i}") for i, s in enumerate(SHARES)]
    )
    out = means.join(dealt(shape), [M, "src"]).join(dealt(cross), [M, "src"]).withColumnRenamed("src", "face")
    out = out.withColumn("g14", F.lit(0.0))
    low = out.groupBy(M).agg(*[F.min(f"g{i}").alias(f"_lo{i}") for i in range(15)])
    return out.join(low, M).select(M, "face", *[(F.col(f"g{i}") - F.col(f"_lo{i}")).alias(f"g{i}") for i in range(15)])


def shape_context(paths: DataFrame, geometry: DataFrame, normals: DataFrame, reach: float = 1.0, layouts=None) -> DataFrame:
    """Distance-by-angle histogram of the other faces seen from every face, in several binnings.

    The angle is between the direction to a face and that face's reversed normal, minus 90 degrees;
    mass is the area share over ``distance / reach + 0.1``.
    """
    layouts = layouts or list(zip(hist.DISTANCE_BINS, hist.ANGLE_BINS))
    total = geometry.groupBy(M).agg(F.sum("area").alias("_total"))
    o = geometry.select(M, F.col("face").alias("src"), *[F.col(f"g{k}").alias(f"o{k}") for k in "xyz"])
    other = geometry.join(dealt(normals), [M, "face"]).join(total, M)
    other = other.select(M, F.col("face").alias("node"), "gx", "gy", "gz", "nx", "ny", "nz", F.coalesce(F.try_divide("area", "_total"), F.lit(0.0)).alias("share"))
    # what lies beyond the last bin is in none
    last = max(hist.log_edges(nx, hist.REACH * reach)[-1] for nx, _ in layouts)
    counted = paths.filter((F.col("src") != F.col("node")) & (F.col("d") <= last))
    rows = counted.join(dealt(other), [M, "node"]).join(dealt(o), [M, "src"])
    look = sub3(vec3("g"), vec3("o"))
    back = tuple(-c for c in vec3("n"))
    angle = F.degrees(F.atan2(len3(cross3(look, back)), dot3(look, back))) - 90.0
    rows = rows.select(
        M, F.col("src").alias("face"), "d", angle.alias("angle"), (F.col("share") / (F.col("d") / reach + 0.1)).alias("mass")
    )
    # one pass over the distances for all layouts: each row explodes to the bins that contain it
    d, a = F.col("d"), F.col("angle")
    cells = []
    for k, (nx, ny) in enumerate(layouts):
        xs = hist.closed_bins(d, hist.log_edges(nx, hist.REACH * reach))
        ys = hist.closed_bins(a, hist.equal_edges(ny, *hist.ANGLE_RANGE))
        cells.append(F.struct(F.lit(k).alias("layout"), xs.alias("xs"), ys.alias("ys")))
    hits = rows.select(M, "face", "mass", F.inline(F.array(*cells)))
    hits = hits.select(M, "face", "mass", "layout", F.explode("xs").alias("xb"), "ys")
    hits = hits.select(M, "face", "mass", "layout", "xb", F.explode("ys").alias("yb"))
    return hits.groupBy(M, "face", "layout", "xb", "yb").agg(F.sum("mass").alias("mass"))


def spin_images(geometry, face_normals, vertices, vertex_normals, vertex_areas, support=hist.SPIN_SUPPORT, tile_rows=TILE_ROWS) -> DataFrame:
    """Soft histogram of the mesh's vertices in the cylinder coordinates of every face.

    Each vertex that does not face away adds its area share, splatted over the cells near it.
    """
    cells, size = hist.SPIN_CELLS, support / hist.SPIN_CELLS
    total = vertex_areas.groupBy(M).agg(F.sum("area").alias("_total"))
    v = vertices.join(dealt(vertex_normals), [M, "v"]).join(dealt(vertex_areas), [M, "v"]).join(total, M)
    v = v.select(M, "v", "x", "y", "z", "nx", "ny", "nz", (F.col("area") / (F.col("_total") + EPSILON)).alias("share"))
    f = geometry.select(M, "face", "gx", "gy", "gz").join(dealt(face_normals), [M, "face"])
    centre = np.arange(cells) + 0.5
    schema = f"{M} long, face long, cell int, mass double"

    def kernel(faces: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        if not len(faces) or not len(pts):
            return pd.DataFrame({M: [], "face": [], "cell": [], "mass": []})
        p, pn = pts[["x", "y", "z"]].to_numpy(), pts[["nx", "ny", "nz"]].to_numpy()
        share = pts["share"].to_numpy()
        g, gn = faces[["gx", "gy", "gz"]].to_numpy(), faces[["nx", "ny", "nz"]].to_numpy()
        out = np.zeros((len(faces), cells * cells))
        for k in range(len(faces)):
            seen = pn @ gn[k] >= 0.0
            diff = p[seen] - g[k]
            beta = diff @ gn[k]
            alpha = np.sqrt(np.maximum((diff**2).sum(1) - beta * beta, 0.0))
            row, column = (support / 2 - beta / 2) / size, alpha / size
            dx, dy = row[:, None] - centre, column[:, None] - centre
            near = (np.abs(dx) <= hist.SPLAT_REACH)[:, :, None] & (np.abs(dy) <= hist.SPLAT_REACH)[:, None, :]
            w = np.exp(-(dx**2)[:, :, None] / hist.SPLAT_VARIANCE) * np.exp(-(dy**2)[:, None, :] / hist.SPLAT_VARIANCE)
            w = np.where(near & (w >= hist.SPLAT_FLOOR), w, 0.0).reshape(len(w), -1)
            out[k] = (share[seen] / (w.sum(1) + EPSILON)) @ w
        fi, ci = np.nonzero(out)
        return pd.DataFrame(
            {M: faces[M].to_numpy()[fi], "face": faces["face"].to_numpy()[fi], "cell": ci.astype("int32"), "mass": out[fi, ci]}
        )

    parts = tile_product(f, v, [M], "face", "v", kernel, schema, tile_rows)
    return parts.groupBy(M, "face", "cell").agg(F.sum("mass").alias("mass"))


def distance_moments(points: DataFrame, group: list[str], key: str, vector: str, weight: Column, tile_rows=TILE_ROWS) -> DataFrame:
    """Weighted mean, mean square and mean root of the distances from every point to all of its group."""
    pts = points.select(*group, F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), weight.alias("w"))
    kinds = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "id long", "sw double", "s1 double", "s2 double", "sh double"])

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in [*group, "id", "sw", "s1", "s2", "sh"]})
        y, w = np.stack(b["v"].to_numpy()), b["w"].to_numpy()
        sums = []
        for x in a["v"]:
            d = np.sqrt(((y - x) ** 2).sum(1))
            sums.append((w.sum(), d @ w, (d * d) @ w, np.sqrt(d) @ w))
        out = a[[*group, "id"]].reset_index(drop=True)
        return out.join(pd.DataFrame(sums, columns=["sw", "s1", "s2", "sh"]))

    parts = tile_product(pts, pts, group, "id", "id", kernel, schema, tile_rows)
    sums = parts.groupBy(*group, "id").agg(*[F.sum(c).alias(c) for c in ("sw", "s1", "s2", "sh")])
    return sums.select(
        *group, "id", *[F.try_divide(c, "sw").alias(n) for c, n in (("s1", "mean"), ("s2", "mean2"), ("sh", "meansqrt"))]
    )


def class_context(paths: DataFrame, probabilities: DataFrame, areas: DataFrame, reach: float, bins: int = 5) -> DataFrame:
    """Class probability mass around every face by distance: ``(mesh_id, face, xb, label, mass)``.

    ``probabilities(mesh_id, face, label, p)``.  A face adds its area share times the probability over
    ``distance / reach + 0.1``.
    """
    total = areas.groupBy(M).agg(F.sum("area").alias("_total"))
    share = areas.join(total, M).select(M, F.col("face").alias("node"), F.coalesce(F.try_divide("area", "_total"), F.lit(0.0)).alias("share"))
    p = probabilities.select(M, F.col("face").alias("node"), "label", "p")
    ends = hist.log_edges(bins, hist.REACH * reach)
    xs = hist.closed_bins(F.col("d"), ends)
    # what lies beyond the last bin is in none
    rows = paths.filter(F.col("d") <= ends[-1]).join(dealt(share), [M, "node"]).select(
        M, F.col("src").alias("face"), "node", (F.col("share") / (F.col("d") / reach + 0.1)).alias("_w"), F.explode(xs).alias("xb")
    )
    rows = rows.join(dealt(p), [M, "node"])
    return rows.groupBy(M, "face", "xb", "label").agg(F.sum(F.col("_w") * F.col("p")).alias("mass"))


def axis_context(
    geometry: DataFrame, probabilities: DataFrame, axes: DataFrame, classes: int, bins: int = 5, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Class probability mass by distance along the axes of a mesh: ``(mesh_id, face, axis, xb, label, mass)``.

    ``probabilities(mesh_id, face, p)`` with one array of ``classes`` values, ``axes(mesh_id, axis, ax, ay,
    az, extent)``, three per mesh.  Bins are closed at both ends and reach 1.2 times the extent.
    """
    total = geometry.groupBy(M).agg(F.sum("area").alias("_total"))
    frame = axes.groupBy(M).agg(F.array_sort(F.collect_list(F.struct("axis", "ax", "ay", "az", "extent"))).alias("_x"))
    flat = F.flatten(F.transform("_x", lambda a: F.array(a["ax"], a["ay"], a["az"], a["extent"])))
    faces = geometry.join(dealt(probabilities), [M, "face"]).join(total, M).join(frame, M)
    faces = faces.select(M, "face", "gx", "gy", "gz", F.coalesce(F.try_divide("area", "_total"), F.lit(0.0)).alias("share"), "p", flat.alias("frame"))
    unit = np.array(hist.log_edges(bins, hist.REACH))
    schema = f"{M} long, face long, axis int, xb int, label int, mass double"
    names = [M, "face", "axis", "xb", "label", "mass"]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        x, y = a[["gx", "gy", "gz"]].to_numpy(), b[["gx", "gy", "gz"]].to_numpy()
        mass = np.stack(b["p"].to_numpy()) * b["share"].to_numpy()[:, None]
        out = np.zeros((len(a), 3, bins, classes))
        for k, row in enumerate(np.reshape(a["frame"].iloc[0], (-1, 4))):
            reach = row[3]
            gap = np.abs((y @ row[:3])[None, :] - (x @ row[:3])[:, None])
            fade = 1.0 / (gap / reach + 0.1)
            for i in range(bins):
                inside = (gap >= unit[i] * reach) & (gap <= unit[i + 1] * reach)
                out[:, k, i] = np.where(inside, fade, 0.0) @ mass
        f, k, i, c = np.nonzero(out)
        return pd.DataFrame(dict(zip(names, (a[M].to_numpy()[f], a["face"].to_numpy()[f], k, i, c, out[f, k, i, c]))))

    parts = tile_product(faces, faces, [M], "face", "face", kernel, schema, tile_rows)
    return parts.groupBy(M, "face", "axis", "xb", "label").agg(F.sum("mass").alias("mass"))
