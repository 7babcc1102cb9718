import struct

import pytest
from pyspark.sql import functions as F

from facetry.operators import mesh, project
from facetry.sources import meshes, text

TETRA = "OFF\n# comment\n4 4 6\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 2 1\n3 0 1 3\n3 0 3 2\n3 1 2 3\n"
QUAD = "OFF\n4 1 4\n0 0 0\n2 0 0\n2 1 0\n0 1 0\n4 0 1 2 3\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "tetra.off").write_text(TETRA)
    (tmp_path / "quad.off").write_text(QUAD)
    return tmp_path


def triangles(faces):
    return sorted((r.mesh_id, r.face, r.v0, r.v1, r.v2) for r in faces.collect())


@pytest.mark.parametrize("kw", [{}, {"rows_per_cell": 3}])
def test_off_and_geometry(spark, folder, kw):
    v, f = meshes.read_mesh(spark, f"{folder}/*.off", **kw)
    assert triangles(f) == [
        ("quad", 0, 0, 1, 2), ("quad", 1, 0, 2, 3),
        ("tetra", 0, 0, 2, 1), ("tetra", 1, 0, 1, 3), ("tetra", 2, 0, 3, 2), ("tetra", 3, 1, 2, 3),
    ]
    g = mesh.face_geometry(f, v)
    total = {r.mesh_id: r.a for r in g.groupBy("mesh_id").agg(F.sum("area").alias("a")).collect()}
    assert total["quad"] == pytest.approx(2.0) and total["tetra"] == pytest.approx(1.5 + 3**0.5 / 2)
    across = mesh.across_edges(f)
    assert across.filter("mesh_id = 'tetra' and nbr is null").count() == 0
    assert across.filter("mesh_id = 'quad' and nbr is null").count() == 4
    n = {(r.v): (r.nx, r.ny, r.nz) for r in mesh.vertex_normals(g).filter("mesh_id = 'quad'").collect()}
    assert all(abs(z) == pytest.approx(1.0) for _, _, z in n.values())


def test_off_round_trip(spark, folder):
    v, f = meshes.read_mesh(spark, f"{folder}/*.off")
    meshes.write_off(v, f, f"{folder}/out")
    for name in ("tetra", "quad"):
        parts = sorted((folder / "out" / f"mesh_id={name}").glob("part-*"))
        (folder / f"again_{name}.off").write_text("".join(p.read_text() for p in parts))
    v2, f2 = meshes.read_mesh(spark, f"{folder}/again_*.off")
    strip = lambda rows: [(r[0].replace("again_", ""), *r[1:]) for r in rows]
    assert strip(triangles(f2)) == triangles(f)
    assert v2.count() == v.count()


def test_obj_with_negative_and_slashed_corners(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nvn 0 0 1\nv 0 1 0\nf 1//1 2//1 3//1\nv 1 1 0\nf -3/1 -1/1 -2/1\n")
    v, f = meshes.read_mesh(spark, f"{tmp_path}/*.obj")
    assert triangles(f) == [("m", 0, 0, 1, 2), ("m", 1, 1, 3, 2)]
    assert sorted((r.v, r.x, r.y) for r in v.collect()) == [(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)]


def test_ply_ascii_and_binary(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    for name, order, mark in (("b", "binary_little_endian", "<"), ("c", "binary_big_endian", ">")):
        body = struct.pack(f"{mark}9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack(f"{mark}B3i", 3, 0, 1, 2)
        (tmp_path / f"{name}.ply").write_bytes(head.format(order).encode() + body)
    v, f = meshes.read_mesh(spark, f"{tmp_path}/*.ply")
    assert triangles(f) == [(m, 0, 0, 1, 2) for m in "abc"]
    assert v.filter("x = 1").count() == 3


def test_line_addressed_tables(spark, tmp_path):
    (tmp_path / "56_adj.txt").write_text("0 1 0 2\n1 0 2 1\n2 0 1 2\n")
    (tmp_path / "56_w.txt").write_text("1 2 3\n4 5 6\n7 8 9\n")
    (tmp_path / "56.seg").write_text("2\n3\n2\n9\n\n")
    adj = text.read_adjacency(spark, f"{tmp_path}/56_adj.txt")
    assert {(r.src, r.slot): r.dst for r in adj.collect()}[(0, 1)] is None
    w = text.read_slot_values(spark, f"{tmp_path}/56_w.txt")
    assert {(r.src, r.slot): r.w for r in w.collect()}[(2, 0)] == 7.0
    limit = spark.createDataFrame([("56", 3)], "mesh_id string, n int")
    seg = text.read_labels(spark, f"{tmp_path}/56.seg", limit)
    assert [(r.face, r.label) for r in seg.orderBy("face").collect()] == [(0, 2), (1, 3), (2, 2)]
    (tmp_path / "list.txt").write_text("a.off a.seg\nb.off\n-\nc.off c.seg\n")
    got = text.read_mesh_list(spark, f"{tmp_path}/list.txt").orderBy("line").collect()
    assert [(r.mesh_path, r.label_path, r.is_valid) for r in got] == [
        ("a.off", "a.seg", False), ("b.off", None, False), ("c.off", "c.seg", True)
    ]
    (tmp_path / "t1.txt").write_text("1 2 3\n")
    (tmp_path / "v1.txt").write_text("4 5\n")
    ids = text.read_ids(spark, f"{tmp_path}/[tv]1.txt")
    assert sorted((r.fold, r.role, r.mesh_id) for r in ids.collect()) == [
        (1, "test", "4"), (1, "test", "5"), (1, "train", "1"), (1, "train", "2"), (1, "train", "3")
    ]
    (tmp_path / "faces.txt").write_text("10 20\n30\n")
    assert sorted((r.mesh_id, r.n) for r in text.read_counts(spark, f"{tmp_path}/faces.txt").collect()) == [(1, 10), (2, 20), (3, 30)]
    seen = text.manifest(spark, f"{tmp_path}/*.seg")
    ms = spark.createDataFrame([("56",), ("57",)], "mesh_id string")
    assert [r.mesh_id for r in text.with_all_inputs(ms, [seen]).collect()] == ["56"]


def test_descriptor_projection(spark):
    rows = spark.range(2).select(F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: i.cast("double")).alias("f"))
    got = project.project_blocks(rows, "0001001").first().f
    assert len(got) == project.mask_width("0001001") == 115 and got[0] == 382.0 and got[15] == 493.0
    short = spark.createDataFrame([([1.0],)], "f array<double>")
    with pytest.raises(Exception, match="too short"):
        project.project_blocks(short, "1000000").collect()
    assert project.project_blocks(short, "1000000", strict=False).count() == 0


def test_record_codec(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>")
    rec = df.select(project.encode_record(F.col("v"), 2, 3, 1, F.lit(7)).alias("r"))
    assert rec.select(project.decode_record(F.col("r"))).first()[0] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
