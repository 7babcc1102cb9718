import math

import pytest
from pyspark.sql import functions as F

from facetry.operators import boost, graph, hops, mesh, project
from facetry.sources import text


def sphere(spark, rings=14, around=18, radius=2.0):
    pts, tri = [(0.0, 0.0, 1.0)], []
    for r in range(1, rings):
        for k in range(around):
            a, b = math.pi * r / rings, 2 * math.pi * (k + r / 2) / around
            pts.append((math.sin(a) * math.cos(b), math.sin(a) * math.sin(b), math.cos(a)))
    pts.append((0.0, 0.0, -1.0))
    at = lambda r, k: 1 + (r - 1) * around + k % around
    for k in range(around):
        tri.append((0, at(1, k), at(1, k + 1)))
        tri.append((len(pts) - 1, at(rings - 1, k + 1), at(rings - 1, k)))
        for r in range(1, rings - 1):
            tri.append((at(r, k), at(r + 1, k), at(r, k + 1)))
            tri.append((at(r + 1, k), at(r + 1, k + 1), at(r, k + 1)))
    v = [(0, i, *[radius * c for c in p]) for i, p in enumerate(pts)]
    f = [(0, i, *t) for i, t in enumerate(tri)]
    return (
        spark.createDataFrame(v, "mesh_id long, v long, x double, y double, z double"),
        spark.createDataFrame(f, "mesh_id long, face long, v0 long, v1 long, v2 long"),
    )


def test_curvature_of_a_sphere(spark):
    v, f = sphere(spark)
    g = mesh.face_geometry(f, v)
    k = mesh.principal_curvatures(g, mesh.vertex_normals(g)).collect()
    assert all(abs(r.k1) == pytest.approx(0.5, abs=0.03) and abs(r.k2) == pytest.approx(0.5, abs=0.03) for r in k)
    for r in k:
        assert r.d1x**2 + r.d1y**2 + r.d1z**2 == pytest.approx(1.0, abs=1e-6)
        assert r.d1x * r.d2x + r.d1y * r.d2y + r.d1z * r.d2z == pytest.approx(0.0, abs=1e-6)
    areas = mesh.voronoi_areas(g).agg(F.sum("area")).first()[0]
    assert areas == pytest.approx(g.agg(F.sum("area")).first()[0])


def test_orientation_is_repaired(spark):
    v, f = sphere(spark, rings=5, around=6)
    odd = f.select(
        "mesh_id", "face", F.when(F.col("face") % 3 == 1, F.col("v2")).otherwise(F.col("v0")).alias("v0"), "v1",
        F.when(F.col("face") % 3 == 1, F.col("v0")).otherwise(F.col("v2")).alias("v2"),
    )
    assert mesh.across_edges(odd).filter("nbr is null").count() > 0
    fixed = mesh.orient(odd)
    assert mesh.across_edges(fixed).filter("nbr is null").count() == 0
    same = fixed.exceptAll(f).count()
    assert same == 0


def test_smoothing_variants_and_noise(spark):
    v, f = sphere(spark, rings=5, around=6)
    n = mesh.vertex_normals(mesh.face_geometry(f, v))
    assert mesh.noisify(v, n, 0.1, 3).exceptAll(mesh.noisify(v, n, 0.1, 3)).count() == 0
    assert mesh.taubin(v, f).count() == v.count()
    big = mesh.inflate(v, n, 1.0).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"))
    assert big.agg(F.avg("r")).first()[0] == pytest.approx(3.0, abs=0.05)


def test_grid_and_rewiring(spark):
    e = graph.grid_edges(3, 4, spark)
    assert e.count() == 2 * (3 * 3 + 2 * 4)
    assert e.exceptAll(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).count() == 0
    w = e.withColumn("w", F.lit(1.0))
    nodes = spark.range(12).select(F.col("id").alias("node"), F.col("id").alias("pos"))
    out = graph.rewire(w, nodes, 0.4, 1)
    assert out.exceptAll(out.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).count() == 0
    assert hops.is_connected(e, nodes)
    top = graph.largest_eigenvalue(graph.laplacian(w))
    assert top == pytest.approx(2.0, abs=1e-4)  # bipartite graph


def test_distance_summary_of_a_path(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double")
    d = hops.bounded_distances(e, spark.range(3).select(F.col("id").alias("src")), None)
    s = hops.distance_summary(d).first()
    assert (s.half_max, s.half_mean_max, s.mean) == (1.0, pytest.approx(5 / 6), pytest.approx(8 / 9))


def test_gather_rows_in_slot_order(spark):
    n = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (1, 1, 0)], "src long, slot int, dst long")
    f = spark.createDataFrame([(0, 5.0), (1, 6.0), (2, 7.0)], "k long, f double")
    rows = {r.node: r["values"] for r in graph.gather_rows(graph.gather(n, f, "k", "f")).collect()}
    assert rows == {0: [5.0, 7.0, 6.0], 1: [6.0, 5.0], 2: [7.0]}


def test_validation_stops_boosting_and_cascade_adds_context(spark):
    rows = [(i, 1 + i % 2, [float(i % 2), float(i % 5)], 0.05) for i in range(20)]
    data = spark.createDataFrame(rows, "id long, y int, x array<double>, weight double")
    model = boost.train(data, 2, rounds=4, validation=data, patience=0)
    assert len(model) == 1
    stages = boost.cascade(data, 2, lambda p: p.select("id", F.col("p").alias("extra")), stages=2, rounds=1)
    assert len(stages) == 2
    scored = boost.predict(data, boost.model_frame(spark, model))
    nlog = boost.neg_log_probabilities(scored, ["id"]).first().nlog
    assert len(nlog) == 2 and all(x >= 0 for x in nlog)


def test_combinations_and_templates(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "i int")
    assert project.column_combinations(items, "i", 3).count() == 35
    assert [r.text for r in text.expand_template(spark, "net_{i}", 2).orderBy("i").collect()] == ["net_0", "net_1"]
