"""Tables of faces, vertices and paths meet by key, also those that are scanned back from files."""

from pyspark.sql import functions as F

from facetry.operators import descriptors, edges, hops, mesh
from facetry.session import cut

M = "mesh_id"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scanned_tables_are_not_broadcast(spark):
    ids = spark.range(40).withColumn(M, F.lit(1).cast("long"))
    across = cut(ids.select(M, (F.col("id") * 3).alias("edge"), F.col("id").alias("face"), F.pmod(F.col("id") + 1, 40).alias("nbr")))
    areas = cut(ids.select(M, F.col("id").alias("face"), F.lit(1.0).alias("area")))
    known = cut(ids.select(M, F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")))
    links = cut(ids.select(M, F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w")))
    corners = cut(ids.select(M, F.col("id").alias("face"), *[(F.col("id") + k).alias(f"v{k}") for k in range(3)]))
    plans = [
        _plan(edges.differences(across, areas, ["area"])),
        _plan(hops._relax(known, links, [M], F.lit(True), [])),
        _plan(mesh.across_edges(corners)),
    ]
    assert all("Join" in p and "Broadcast" not in p for p in plans)
    # one row per mesh may be broadcast, one row per face may not
    statistics = _plan(descriptors.geodesic_statistics(known, areas))
    assert "SortMergeJoin" in statistics
