"""Sizes of meshes: the scales a mesh may be divided by, one row per mesh and kind.

Path lengths are taken from sampled sources, every ``ceil(vertices / samples)``-th vertex, in batches: a batch's path table is
reduced to a few numbers per source and deleted before the next one is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.vectors import len3, sub3, vec3
from facetry.operators import hops
from facetry.operators.mesh import M, SCALE_PERCENTILE, bounding_box, mass_centre
from facetry.operators.spheres import bounding_spheres
from facetry.operators.stats import floor_percentiles, medians
from facetry.session import cut, forget

#: Sources per mesh, and how many of each mesh are worked on at once.
SAMPLES, BATCH = 5000, 64


def path_statistics(
    edges: DataFrame, vertices: DataFrame, areas: DataFrame, samples: int = SAMPLES, batch: int = BATCH, share: float = SCALE_PERCENTILE
) -> DataFrame:
    """Per sampled source ``(mesh_id, src, far, mean, middle, low)`` of its path lengths to the vertices it reaches.

    ``far`` is the largest, ``mean`` the mean over the other sampled vertices by ``areas(mesh_id, v, area)``, ``middle`` and
    ``low`` stand at the places ``floor(n/2)`` and ``floor(share*n)`` in ascending order, the source itself first.
    """
    step = vertices.groupBy(M).agg(F.ceil(F.count("*") / samples).cast("long").alias("_step"))
    sampled = cut(vertices.join(step, M).filter(F.col("v") % F.col("_step") == 0).select(M, F.col("v").alias("src"), (F.col("v") / F.col("_step")).cast("long").alias("_no")))
    weights = sampled.join(areas.select(M, F.col("v").alias("src"), "area"), [M, "src"]).select(M, F.col("src").alias("node"), "area")
    weights = cut(weights)
    edges = cut(edges.select(M, "i", "j", "w"))
    last = sampled.agg(F.max("_no")).first()[0]
    found = []
    for begin in range(0, 0 if last is None else last + 1, batch):
        some = sampled.filter((F.col("_no") >= begin) & (F.col("_no") < begin + batch)).select(M, "src")
        paths = hops.bounded_distances(edges, some, None, [M])
        others = paths.filter(F.col("src") != F.col("node")).join(weights, [M, "node"]).groupBy(M, "src")
        mean = others.agg(F.try_divide(F.sum(F.col("d") * F.col("area")), F.sum("area")).alias("mean"))
        far = paths.groupBy(M, "src").agg(F.max("d").alias("far"))
        places = floor_percentiles(paths, [M, "src"], "d", {"middle": 0.5, "low": share})
        found.append(cut(far.join(mean, [M, "src"], "left").join(places, [M, "src"])))
        forget(paths)
    forget(sampled, weights, edges)
    if not found:
        return areas.select(M, F.col("v").alias("src"), *[F.lit(None).cast("double").alias(c) for c in ("far", "mean", "middle", "low")]).filter(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mesh_scales(
    geometry: DataFrame, vertices: DataFrame, edges: DataFrame, areas: DataFrame, samples: int = SAMPLES, batch: int = BATCH,
    share: float = SCALE_PERCENTILE,
) -> DataFrame:
    """``(mesh_id, kind, scale)`` of all kinds.

    Of path lengths: ``half_max_path`` and ``half_mean_max_path`` (half the largest, and half the mean, of the sources' largest),
    ``mean_path``, ``median_path`` (median of the sources' middle ones), ``low_path`` (the ``share`` percentile of the sources'
    ``share`` percentiles, times 0.5 / share).  Of the shape: ``sphere_radius``, ``box_diagonal``, and of the distances of the
    face centres from the centre of mass ``median_distance`` and ``low_distance`` (as for paths).
    """
    per = cut(path_statistics(edges, vertices, areas, samples, batch, share))
    sums = per.groupBy(M).agg(
        (F.max("far") / 2).alias("half_max_path"), (F.avg("far") / 2).alias("half_mean_max_path"), F.avg("mean").alias("mean_path")
    )
    paths = sums.join(medians(per, [M], "middle").withColumnRenamed("median", "median_path"), M)
    low = floor_percentiles(per, [M], "low", {"low_path": share})
    paths = paths.join(low.withColumn("low_path", F.col("low_path") * (0.5 / share)), M)
    ball = bounding_spheres(vertices, [M]).select(M, F.col("r").alias("sphere_radius"))
    gap = sum(((F.col(f"max_{k}") - F.col(f"min_{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    box = bounding_box(vertices).select(M, F.sqrt(gap).alias("box_diagonal"))
    d = geometry.join(mass_centre(geometry), M).withColumn("_d", len3(sub3(vec3("g"), vec3("m"))))
    near = floor_percentiles(d, [M], "_d", {"median_distance": 0.5, "low_distance": share})
    near = near.withColumn("low_distance", F.col("low_distance") * (0.5 / share))
    wide = box.join(ball, M, "left").join(near, M, "left").join(paths, M, "left")
    kinds: list[Column] = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("scale")) for c in wide.columns if c != M]
    return wide.select(M, F.inline(F.array(*kinds)))
