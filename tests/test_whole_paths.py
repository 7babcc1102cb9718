"""Paths without a bound: the descriptors over whole meshes, and graphs walked by one task or by rounds of joins."""

import heapq

import check_oracle
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from facetry.operators import hops


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("parts")
    rows = spark.range(100).select(F.col("id").alias("p_partkey"), (1 + F.pmod(F.xxhash64("id"), F.lit(997))).cast("int").alias("p_size"))
    rows.write.parquet(f"{at}/part.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["geodesic_statistics", "shape_context", "class_context"])
def test_descriptors_take_paths_of_any_length(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    ok, note = check_oracle.compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_statistics_reach_the_far_end_of_a_mesh(spark, folder):
    """The mesh is 24 wide: a corner's mean path is many times what a bound of 1.2 leaves."""
    got = entry.queries()["geodesic_statistics"](spark, folder).agg(F.max("g0")).first()[0]
    assert got > 3.0


def dijkstra(arcs, src):
    best, heap = {src: 0.0}, [(0.0, src)]
    while heap:
        d, i = heapq.heappop(heap)
        for a, b, w in arcs:
            if a == i and d + w < best.get(b, float("inf")):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize("most", [hops.LOCAL_ARCS, 6, 0])
def test_one_task_and_rounds_find_the_same_paths(spark, monkeypatch, most):
    monkeypatch.setattr(hops, "LOCAL_ARCS", most)
    monkeypatch.setattr(hops, "LOCAL_PAIRS", 4)
    arcs = {1: [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 0.5), (0, 2, 2.5), (3, 0, 9.0), (4, 4, 1.0), (2, 5, 0.25)], 2: [(0, 1, 3.0), (1, 0, 1.0)]}
    rows = [(g, *a) for g, some in arcs.items() for a in some] + [(1, 3, 7, None), (None, 0, 1, 1.0)]
    e = spark.createDataFrame(rows, "g long, i long, j long, w double")
    s = spark.createDataFrame([(1, 0), (1, 0), (1, 4), (1, 9), (2, 0), (3, 5), (None, 2)], "g long, src long")
    got = {tuple(r) for r in hops.bounded_distances(e, s, None, ["g"]).collect()}
    want = {(g, v, n, d) for g, v in [(1, 0), (1, 4), (1, 9), (2, 0), (3, 5)] for n, d in dijkstra(arcs.get(g, []), v).items()}
    assert got == want | {(1, 0, 7, None), (None, 2, 2, 0.0)}
