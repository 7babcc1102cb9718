"""Descriptors of mesh edges: dihedral angles around an edge, differences across it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import powers
from facetry.functions.vectors import cross3, dot3, len3, vec3
from facetry.operators.hist import log_edges
from facetry.operators.ordered import cumulate
from facetry.session import cut, dealt

M = "mesh_id"

# Exponents of the polynomial expansion, the neighbourhood radii and the distance offset of the weights.
EXPONENTS = [1, 2, 3, 5, 10]
RADII = [0.005, 0.0125, 0.03125, 0.078125]
OFFSET = 0.01


def edge_ids(across: DataFrame) -> DataFrame:
    """Inner edges with their id ``3 * face + slot`` and both end points."""
    inner = across.filter(F.col("nbr").isNotNull())
    return inner.select(M, (F.col("face") * 3 + F.col("slot")).alias("edge"), "face", "slot", "nbr", "p", "q")


def vertex_edges(edges: DataFrame) -> DataFrame:
    """``(mesh_id, v, edge)``: the edges that meet at a vertex."""
    return edges.select(M, "edge", F.explode(F.array("p", "q")).alias("v"))


def edge_weights(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Share of the mesh area covered by the two faces of an edge."""
    total = areas.groupBy(M).agg(F.sum("area").alias("_total"))
    a = areas.select(M, "face", F.col("area").alias("_a"))
    b = areas.select(M, F.col("face").alias("nbr"), F.col("area").alias("_b"))
    rows = edges.join(dealt(a), [M, "face"]).join(dealt(b), [M, "nbr"]).join(total, M)
    return rows.select(M, "edge", ((F.col("_a") + F.col("_b")) / F.col("_total")).alias("weight"))


def neighbourhood_angles(edges: DataFrame, angles: DataFrame, weights: DataFrame, paths: DataFrame, **kw) -> DataFrame:
    """Weighted mean and median of the dihedral angles near both ends of every edge.

    ``angles(mesh_id, face, slot, angle)``, ``paths(mesh_id, src, node, d)`` between vertices.  An edge near
    an end counts by its weight over ``distance + 0.01``, once per end it is reached from.  Angles are
    summed per (vertex, angle) before they meet the edges.
    """
    known = edges.select(M, "edge", "face", "slot").join(dealt(angles.select(M, "face", "slot", "angle")), [M, "face", "slot"])
    known = known.join(dealt(weights), [M, "edge"]).select(M, "edge", F.round("angle", 12).alias("angle"), "weight")
    at = vertex_edges(edges).join(dealt(known), [M, "edge"]).withColumnRenamed("v", "node")
    near = paths.join(dealt(at), [M, "node"]).groupBy(M, F.col("src").alias("v"), "angle").agg(
        F.sum(F.col("weight") / (F.col("d") + OFFSET)).alias("w")
    )
    rows = vertex_edges(edges).join(dealt(cut(near)), [M, "v"])
    cum = cut(cumulate(rows, [M, "edge"], "angle", {"w": F.col("w")}, **kw))
    return cum.groupBy(M, "edge").agg(
        (F.sum(F.col("angle") * F.col("w")) / F.sum("w")).alias("mean_angle"),
        F.min(F.when(F.col("cum_w") / F.col("total_w") >= 0.5, F.col("angle"))).alias("median_angle"),
    )


def expand(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its polynomial expansion ``<column>_p<exponent>``."""
    keep = [c for c in df.columns if c not in columns]
    parts = [v.alias(f"{c}_p{e}") for c in columns for e, v in zip(EXPONENTS, powers(F.col(c), EXPONENTS))]
    return df.select(*keep, *parts)


def differences(edges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Absolute differences of face values across every edge."""
    a = values.select(M, "face", *[F.col(n).alias(f"_a_{n}") for n in names])
    b = values.select(M, F.col("face").alias("nbr"), *[F.col(n).alias(f"_b_{n}") for n in names])
    rows = edges.join(dealt(a), [M, "face"]).join(dealt(b), [M, "nbr"])
    return rows.select(M, "edge", *[F.abs(F.col(f"_a_{n}") - F.col(f"_b_{n}")).alias(f"d_{n}") for n in names])


# Bins, reach and probability floor of the edge context.
CONTEXT_BINS = 4
CONTEXT_LOG_EXPONENT = 1.0
CONTEXT_REACH = 0.08
CONTEXT_FLOOR = 0.5


def _edge_facts(edges: DataFrame, geometry: DataFrame, normals: DataFrame, vertices: DataFrame) -> DataFrame:
    """Midpoint (``cx..``) and area-weighted unit normal (``ex..``) of every edge."""
    v = vertices.select(M, "v", "x", "y", "z")
    f = geometry.select(M, "face", "area").join(dealt(normals), [M, "face"])
    f = f.select(M, "face", *[(F.col(f"n{k}") * F.col("area")).alias(f"f{k}") for k in "xyz"])
    rows = (
        edges.join(dealt(v.selectExpr(M, "v as p", "x as px", "y as py", "z as pz")), [M, "p"])
        .join(dealt(v.selectExpr(M, "v as q", "x as qx", "y as qy", "z as qz")), [M, "q"])
        .join(dealt(f), [M, "face"])
        .join(dealt(f.selectExpr(M, "face as nbr", "fx as hx", "fy as hy", "fz as hz")), [M, "nbr"])
    )
    n = tuple(F.col(f"f{k}") + F.col(f"h{k}") for k in "xyz")
    size = len3(n)
    return rows.select(
        M, "edge", *[((F.col(f"p{k}") + F.col(f"q{k}")) / 2).alias(f"c{k}") for k in "xyz"],
        *[F.when(size > 0, c / size).otherwise(0.0).alias(f"e{k}") for c, k in zip(n, "xyz")],
    )


def edge_context(
    edges: DataFrame,
    probabilities: DataFrame,
    weights: DataFrame,
    geometry: DataFrame,
    normals: DataFrame,
    vertices: DataFrame,
    paths: DataFrame,
    reach: float = CONTEXT_REACH,
) -> DataFrame:
    """Boundary probability around every edge: ``(mesh_id, edge, xb, mass, coplanar)``.

    ``probabilities(mesh_id, edge, p)``; edges with ``p`` below one half do not count.  Bin ``xb`` holds
    everything up to its outer distance.  ``mass`` divides by distance, ``coplanar`` weights by how far
    the other edge lies in the plane of this one.  An edge counts once per end it is reached from.
    """
    facts = cut(_edge_facts(edges, geometry, normals, vertices))
    likely = probabilities.filter((F.col("p") >= CONTEXT_FLOOR) & (F.col("p") <= 1)).join(dealt(weights), [M, "edge"])
    likely = likely.join(dealt(facts), [M, "edge"]).join(dealt(vertex_edges(edges).withColumnRenamed("v", "node")), [M, "edge"])
    other = likely.select(
        M, "node", (F.col("p") * F.col("weight")).alias("_pw"), *[F.col(f"{p}{k}").alias(f"o{p}{k}") for p in "ce" for k in "xyz"]
    )
    own = vertex_edges(edges).withColumnRenamed("v", "src").join(dealt(facts), [M, "edge"])
    rows = own.join(dealt(paths.filter(F.col("d") <= reach)), [M, "src"]).join(dealt(other), [M, "node"])
    gap = tuple(F.col(f"oc{k}") - F.col(f"c{k}") for k in "xyz")
    turn = cross3(gap, vec3("e"))
    size = len3(turn)
    rows = rows.withColumn("_side", F.when(size > 0, F.abs(dot3(turn, vec3("oe"))) / size).otherwise(0.0))
    flat = 1.0 - F.col("_side")
    outer = log_edges(CONTEXT_BINS, reach, CONTEXT_LOG_EXPONENT)[1:]
    bins = F.array(*[F.struct(F.lit(i).alias("xb"), F.lit(e).alias("end")) for i, e in enumerate(outer)])
    rows = rows.select(
        M, "edge", (F.col("_pw") / (F.col("d") + OFFSET)).alias("_near"), (F.col("_pw") * flat * flat).alias("_flat"),
        F.explode(F.filter(bins, lambda b: F.col("d") <= b["end"])).alias("_b"),
    )
    return rows.groupBy(M, "edge", F.col("_b.xb").alias("xb")).agg(F.sum("_near").alias("mass"), F.sum("_flat").alias("coplanar"))
