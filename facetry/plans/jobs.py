"""End-to-end jobs: descriptors from meshes, graphs for training, scores from predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import mask_bit
from facetry.operators import coarsen, descriptors, energy, graph, hops, mesh, spatial, votes
from facetry.session import cut

M = "mesh_id"

# Coarsening steps, neighbours per node and the levels that feed the five resolutions.
LEVELS = 10
NEIGHBOURS = 9
RESOLUTIONS = [0, 2, 4, 6, 8]


def extract_descriptors(vertices: DataFrame, faces: DataFrame, radius: float | None = None, families=None) -> dict[str, DataFrame]:
    """All descriptor families of normalised meshes, one table per family.

    ``radius`` bounds the surface distances used by the distance-based families.  ``None`` follows
    every path, which yields a row per pair of faces of a mesh; set a bound for large meshes.
    """
    families = families or ["cur", "pca", "sc", "geo", "sdf", "vsi", "si"]
    raw = mesh.face_geometry(faces, vertices)
    v = cut(mesh.normalise(vertices, mesh.mesh_scale(raw)))
    g = cut(mesh.face_geometry(faces, v))
    vn = cut(mesh.vertex_normals(g))
    n = cut(mesh.smooth_face_normals(faces, vn))
    across = cut(mesh.across_edges(faces))
    edges = cut(mesh.face_graph(across, g, v).select(M, "i", "j", "w"))
    out = {}
    if "cur" in families:
        out["cur"] = descriptors.curvature_descriptor(edges, across, n, g)
    if "pca" in families:
        out["pca"] = descriptors.pca_descriptor(edges, n, g)
    if {"sc", "geo"} & set(families):
        paths = hops.bounded_distances(edges, g.select(M, F.col("face").alias("src")), radius, [M])
        if "sc" in families:
            out["sc"] = descriptors.shape_context(paths, g, n)
        if "geo" in families:
            out["geo"] = descriptors.geodesic_statistics(paths, g.select(M, "face", "area"))
    if {"sdf", "vsi"} & set(families):
        main = cut(mesh.principal_curvatures(g, vn))
        if "sdf" in families:
            out["sdf"] = spatial.shape_diameter(g, n, v, main)
        if "vsi" in families:
            out["vsi"] = spatial.visible_shape(g, n, v, main)
    if "si" in families:
        out["si"] = descriptors.spin_images(g, n, v, vn, mesh.vertex_areas(g))
    return out


def prepare_graphs(
    features: DataFrame,
    adjacency: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    levels: int = LEVELS,
    k: int = NEIGHBOURS,
    resolutions=None,
    seed: int = 0,
) -> dict[str, DataFrame | list[DataFrame]]:
    """Training tables of all meshes: tree-ordered rows and neighbour lists per resolution.

    ``features(mesh_id, face, f)``, ``adjacency(mesh_id, src, slot, dst)`` (no neighbour: NULL),
    ``labels(mesh_id, face, label)``, ``areas(mesh_id, face, area)``.
    """
    resolutions = [r for r in (resolutions or RESOLUTIONS) if r < levels]
    near = adjacency.filter(F.col("dst").isNotNull())
    dist = graph.feature_distances(near, features, "face", "f", [M])
    weights = cut(graph.symmetrise_max(graph.gaussian_kernel(dist, [M]), [M]))
    nodes = features.select(M, F.col("face").alias("node"))
    graphs, parents = coarsen.coarsen(weights, nodes, levels, [M], seed=seed)
    orders = coarsen.tree_orders(parents, [M])
    rows = features.join(labels, [M, "face"]).join(areas, [M, "face"])
    fill = {"label": 0, "area": 0.0}
    padded = coarsen.pad_rows(orders[0], rows, "face", fill, [M])
    lists = []
    for level in resolutions:
        at = nodes if level == 0 else parents[level - 1].select(M, F.col("cluster").alias("node")).distinct()
        found = hops.hop_neighbours(graphs[level], k, [M])
        lists.append(coarsen.permuted_neighbours(found.select(M, "src", "slot", "dst"), orders[level], at, k, [M]))
    return {"rows": padded, "neighbours": lists, "orders": orders, "graphs": graphs}


def recover_predictions(scores: DataFrame, order: DataFrame, n_faces: DataFrame) -> DataFrame:
    """Class scores by tree position become one class per face: ``(mesh_id, face, pred)``.

    Class 0 (padding) is never chosen; fake rows disappear.
    """
    best = votes.argmax_skip_zero(scores, [M, "pos"], "score", "label")
    back = coarsen.unpad_rows(best, order.join(n_faces, M).withColumn("is_fake", F.col("node") >= F.col("n")), group=[M])
    return back.select(M, F.col("node").alias("face"), "pred")


def vote_and_score(
    predictions: DataFrame,
    truth: DataFrame,
    areas: DataFrame,
    masks: list[str],
    edges: DataFrame | None = None,
    labels: list[int] | None = None,
    normalise: bool = False,
) -> DataFrame:
    """Majority vote per model mask, optional smoothing, accuracy averaged mesh -> fold -> mask.

    ``predictions(fold, mesh_id, face, model, label)`` with models 1..7.  Result: ``(mask, fold, accuracy)``
    per fold and one row per mask with NULL fold for the average of its folds.
    """
    on = F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")
    ballots = predictions.select("*", on).filter(mask_bit(F.col("mask"), F.col("model")))
    site = ["mask", "fold", M, "face"]
    vote = votes.majority(ballots, site, "label").select(*site, "vote")
    if edges is not None:
        shares = votes.vote_shares(ballots, site, "label", labels).select(*site, "label", "share")
        group = ["mask", "fold", M]
        runs = cut(shares.select(*group).distinct())
        cost = shares.withColumnRenamed("face", "site")
        area = runs.join(areas.withColumnRenamed("face", "site"), M)
        smooth = energy.smooth_votes(cost, area, runs.join(edges, M), labels, group)
        vote = smooth.select(*group, F.col("site").alias("face"), F.col("label").alias("vote"))
    scored = vote.join(truth, [M, "face"]).join(areas, [M, "face"])
    accuracy: Column = votes.weighted_accuracy(F.col("vote"), F.col("label"), F.col("area"), normalise)
    per_mesh = scored.groupBy("mask", "fold", M).agg(accuracy.alias("accuracy"))
    per_fold = cut(per_mesh.groupBy("mask", "fold").agg(F.avg("accuracy").alias("accuracy")))
    per_mask = per_fold.groupBy("mask").agg(F.avg("accuracy").alias("accuracy"))
    return per_fold.unionByName(per_mask.withColumn("fold", F.lit(None).cast(per_fold.schema["fold"].dataType)))
