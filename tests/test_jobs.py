import math

import pytest
from pyspark.sql import functions as F

from facetry.plans import jobs


@pytest.fixture(scope="module")
def sphere(spark):
    """Two low-resolution spheres of different size."""
    rings, around = 5, 6
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
    v = [(m, i, *[s * c for c in p]) for m, s in ((0, 1.0), (1, 3.0)) for i, p in enumerate(pts)]
    f = [(m, i, *t) for m in (0, 1) for i, t in enumerate(tri)]
    return (
        spark.createDataFrame(v, "mesh_id long, v long, x double, y double, z double"),
        spark.createDataFrame(f, "mesh_id long, face long, v0 long, v1 long, v2 long"),
        len(tri),
    )


def test_descriptors_ignore_the_size_of_a_mesh(spark, sphere):
    v, f, n = sphere
    out = jobs.extract_descriptors(v, f, radius=0.8, families=["geo", "si", "sdf"])
    geo = out["geo"].collect()
    assert len(geo) == 2 * n
    a = {r.face: r.g0 for r in geo if r.mesh_id == 0}
    b = {r.face: r.g0 for r in geo if r.mesh_id == 1}
    assert a == pytest.approx(b, abs=1e-9)
    mass = {(r.mesh_id, r.face): r.m for r in out["si"].groupBy("mesh_id", "face").agg(F.sum("mass").alias("m")).collect()}
    assert len(mass) == 2 * n and all(0 < m <= 1 + 1e-9 for m in mass.values())
    sdf = out["sdf"].groupBy("mesh_id", "cone", "stat").agg(F.max("sdf").alias("m")).collect()
    assert len(sdf) == 2 * 3 * 6 and all(r.m == pytest.approx(1.0) for r in sdf)


def test_graph_preparation_and_recovery(spark, sphere):
    from facetry.operators import mesh

    v, f, n = sphere
    g = mesh.face_geometry(f, v)
    near = mesh.across_edges(f).select("mesh_id", F.col("face").alias("src"), "slot", F.col("nbr").alias("dst"))
    features = g.select("mesh_id", "face", F.array("gx", "gy", "gz").alias("f"))
    labels = g.select("mesh_id", "face", (1 + F.col("face") % 3).alias("label"))
    out = jobs.prepare_graphs(features, near, labels, g.select("mesh_id", "face", "area"), levels=1, k=3)
    rows = out["rows"].collect()
    for m in (0, 1):
        mine = [r for r in rows if r.mesh_id == m]
        assert sorted(r.pos for r in mine) == list(range(len(mine))) and len(mine) % 2 == 0
        assert sum(not r.is_fake for r in mine) == n
        assert all(r.label == 0 and r.area == 0 for r in mine if r.is_fake)
    lists = out["neighbours"][0].groupBy("mesh_id", "pos").count().collect()
    assert len(lists) == len(rows) and all(r["count"] == 3 for r in lists)
    # scores that name the true label at every position come back as that label per face
    one_hot = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.when(F.col("truth") == c, 1.0).otherwise(0.0).alias("score")) for c in range(4)]))
    scores = out["rows"].select("mesh_id", "pos", F.col("label").alias("truth")).select("mesh_id", "pos", one_hot.alias("s")).select("mesh_id", "pos", "s.*")
    count = f.groupBy("mesh_id").agg(F.count("*").alias("n"))
    back = jobs.recover_predictions(scores, out["orders"][0], count).join(labels, ["mesh_id", "face"])
    assert back.count() == 2 * n and back.filter("pred <> label").count() == 0


def test_vote_and_score(spark):
    rows = []
    for model in range(1, 8):
        for face in range(4):
            wrong = (model + face) % 4 == 0
            rows.append((1, "m", face, model, 2 if wrong else 1))
    preds = spark.createDataFrame(rows, "fold int, mesh_id string, face int, model int, label int")
    truth = spark.createDataFrame([("m", k, 1) for k in range(4)], "mesh_id string, face int, label int")
    areas = spark.createDataFrame([("m", k, 0.25) for k in range(4)], "mesh_id string, face int, area double")
    got = {(r["mask"], r.fold): r.accuracy for r in jobs.vote_and_score(preds, truth, areas, ["1111111", "0001000"]).collect()}
    assert got == {("1111111", 1): 1.0, ("1111111", None): 1.0, ("0001000", 1): 0.75, ("0001000", None): 0.75}
    chain = spark.createDataFrame([("m", k, k + 1, 1.0) for k in range(3)], "mesh_id string, i int, j int, w double")
    smooth = jobs.vote_and_score(preds, truth, areas, ["0001000"], chain, [1, 2])
    assert {r.accuracy for r in smooth.collect()} <= {0.75, 1.0}
