import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import edges, mesh, neighbours, spatial


def cube(spark, size=2.0):
    pts = [(0, 4 * x + 2 * y + z, size * x, size * y, size * z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tri = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    v = spark.createDataFrame([(0, k, *map(float, p)) for _, k, *p in pts], "mesh_id int, v long, x double, y double, z double")
    f = spark.createDataFrame([(0, k, *t) for k, t in enumerate(tri)], "mesh_id int, face long, v0 long, v1 long, v2 long")
    return v, f


@pytest.mark.parametrize("tile", [2048, 5])
def test_rays_cross_a_cube(spark, tile):
    v, f = cube(spark)
    g = mesh.face_geometry(f, v)
    total = g.agg(F.sum("area")).first()[0]
    assert total == pytest.approx(24.0)
    centre = (1.1, 0.9, 1.05)
    lines = {0: (1, 0, 0), 1: (-1, 0, 0), 2: (0, 1, 0), 3: (0, 0, -1), 4: (0.6, 0.8, 0)}
    rows = [(0, k, -1, *centre, *map(float, d)) for k, d in lines.items()]
    names = "mesh_id int, ray long, skip long, ox double, oy double, oz double, lx double, ly double, lz double"
    got = {r.ray: r.d for r in spatial.ray_distances(spark.createDataFrame(rows, names), g, per_cell=tile).collect()}
    assert got == pytest.approx({0: 0.9, 1: 1.1, 2: 1.1, 3: 1.05, 4: min(0.9 / 0.6, 1.1 / 0.8)})


def test_cone_rays_keep_their_angle(spark):
    o = spark.createDataFrame([(0, 3, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "mesh_id int, face long, ox double, oy double, oz double, vx double, vy double, vz double, ux double, uy double, uz double")
    rays = spatial.cone_rays(o, [0.0, 30.0], 45.0).collect()
    assert len({r.ray for r in rays}) == 16
    for r in rays:
        assert r.lx**2 + r.ly**2 + r.lz**2 == pytest.approx(1.0)
        assert r.lz == pytest.approx(np.cos(np.radians(30.0 * r.cone)))


@pytest.mark.parametrize("tile", [4096, 8])
def test_nearest_between_two_clouds(spark, tile):
    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=(40, 3)), rnd.normal(size=(55, 3))
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "id long, v array<double>")
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "id long, v array<double>")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    got = {}
    for r in neighbours.nearest(q, p, "id", "v", 2, 1.0, tile_rows=tile).orderBy("src", "slot").collect():
        got.setdefault(r.src, []).append(r.dst)
    want = {}
    for i in range(len(a)):
        near = [j for j in np.argsort(d[i])[:2] if d[i, j] <= 1.0]
        if near:
            want[i] = near
    assert got == want


def test_point_normals_of_a_plane(spark):
    rnd = np.random.default_rng(2)
    pts = [(i, [float(x), float(y), 0.5 * float(x)]) for i, (x, y) in enumerate(rnd.uniform(size=(60, 2)))]
    n = spatial.point_normals(spark.createDataFrame(pts, "id long, v array<double>"), "id", "v").collect()
    want = np.array([-0.5, 0.0, 1.0]) / np.sqrt(1.25)
    assert all(np.dot([r.nx, r.ny, r.nz], want) == pytest.approx(1.0) for r in n)


def test_point_normals_are_taken_around_the_point_itself(spark):
    """A point above a flat sheet: its neighbours spread least across the line to their middle's side."""
    sheet = [(i, [float(i % 4) - 1.5, float(i // 4) - 1.5, 0.0]) for i in range(16)] + [(99, [0.1, 0.2, 3.0])]
    got = {r.id: r for r in spatial.point_normals(spark.createDataFrame(sheet, "id long, v array<double>"), "id", "v").collect()}
    x = np.array([p for i, p in sheet if i != 99]) - np.array(sheet[-1][1])
    near = x[np.lexsort((np.arange(16), np.linalg.norm(x, axis=1)))[:12]]
    want = np.linalg.eigh(near.T @ near)[1][:, 0]
    want = want * (-1 if want[2] < 0 else 1)
    assert np.allclose([got[99].nx, got[99].ny, got[99].nz], want, atol=1e-6)
    few = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id long, v array<double>")
    assert [(r.nx, r.ny, r.nz) for r in spatial.point_normals(few, "id", "v").collect()] == [(0.0, 0.0, 1.0)] * 2


def test_part_axes_follow_the_spread(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 3)) * [5.0, 2.0, 0.5]
    rows = [(7, 1, *map(float, p), 1.0) for p in x] + [(7, 2, 0.0, 0.0, 40.0, 1.0), (8, 2, 0.0, 0.0, 90.0, 1.0)]
    df = spark.createDataFrame(rows, "mesh_id int, label int, x double, y double, z double, w double")
    got = spatial.part_axes(df, ["mesh_id", "label"]).collect()
    assert {(r.mesh_id, r.label) for r in got} == {(7, 1)}
    # the extent is that of the whole mesh, the other part included
    assert max(r.extent for r in got) > 35
    by = {r.axis: r for r in got}
    assert abs(by[0].az) > 0.95 and abs(by[1].ay) > 0.95 and abs(by[2].ax) > 0.95
    assert by[0].spread < by[1].spread < by[2].spread


def test_dihedral_angles_of_a_cube(spark):
    v, f = cube(spark)
    across = mesh.across_edges(f)
    a = mesh.dihedral_angles(across, mesh.face_geometry(f, v), v)
    values = {round(abs(r.angle - 1.0), 6) for r in a.collect()}
    assert values == {0.0, 0.5}
    ids = edges.edge_ids(across)
    assert ids.count() == 36 and ids.select("edge").distinct().count() == 36


def test_subdivision_keeps_area_and_closes(spark):
    v, f = cube(spark)
    v2, f2 = mesh.subdivide(v, f)
    assert f2.count() == 48 and v2.count() == 8 + 18
    assert mesh.face_geometry(f2, v2).agg(F.sum("area")).first()[0] == pytest.approx(24.0)
    assert mesh.across_edges(f2).filter("nbr is null").count() == 0


def test_edge_context_matches_a_plain_loop(spark):
    from facetry.operators import hops

    v, f = cube(spark)
    g = mesh.face_geometry(f, v)
    n = mesh.smooth_face_normals(f, mesh.vertex_normals(g))
    e = edges.edge_ids(mesh.across_edges(f))
    w = edges.edge_weights(e, g.select("mesh_id", "face", "area"))
    p = e.select("mesh_id", "edge", ((F.col("edge") % 5) / 4.0).alias("p"))
    nb = mesh.vertex_neighbours(f)
    pos = {r.v: np.array([r.x, r.y, r.z]) for r in v.collect()}
    length = spark.createDataFrame(
        [(0, r.i, r.j, float(np.linalg.norm(pos[r.i] - pos[r.j]))) for r in nb.collect()], "mesh_id int, i long, j long, w double"
    )
    src = v.select("mesh_id", F.col("v").alias("src"))
    paths = hops.bounded_distances(length, src, 2.1, ["mesh_id"])
    got = {(r.edge, r.xb): (r.mass, r.coplanar) for r in edges.edge_context(e, p, w, g, n, v, paths, reach=2.5).collect()}
    E = {r.edge: r for r in e.collect()}
    weight, prob = ({r.edge: r[c] for r in df.collect()} for df, c in ((w, "weight"), (p, "p")))
    area = {r.face: r.area for r in g.collect()}
    normal = {r.face: np.array([r.nx, r.ny, r.nz]) for r in n.collect()}
    mid = {k: (pos[r.p] + pos[r.q]) / 2 for k, r in E.items()}
    up = {k: normal[r.face] * area[r.face] + normal[r.nbr] * area[r.nbr] for k, r in E.items()}
    up = {k: x / np.linalg.norm(x) for k, x in up.items()}
    ends = [2.5 * (-np.log((5 - x - 1) / 5)) / np.log(5) for x in range(4)]
    want = {}
    dist = [(r.src, r.node, r.d) for r in paths.collect()]
    for k, r in E.items():
        for end in (r.p, r.q):
            for s, node, d in dist:
                if s != end:
                    continue
                for o, ro in E.items():
                    if node not in (ro.p, ro.q) or prob[o] < 0.5:
                        continue
                    t = np.cross(mid[o] - mid[k], up[k])
                    side = abs(t @ up[o]) / np.linalg.norm(t) if np.linalg.norm(t) > 1e-12 else 0.0
                    for x, far in enumerate(ends):
                        if d <= far:
                            m = want.setdefault((k, x), [0.0, 0.0])
                            m[0] += weight[o] * prob[o] / (d + 0.01)
                            m[1] += weight[o] * prob[o] * (1 - side) ** 2
    assert set(got) == set(want)
    for key, (m, c) in want.items():
        assert got[key] == (pytest.approx(m), pytest.approx(c))


@pytest.mark.parametrize("tile", [2048, 5])
def test_axis_context_matches_a_plain_loop(spark, tile):
    from facetry.operators import descriptors, hist

    v, f = cube(spark)
    g = mesh.face_geometry(f, v)
    p = g.select("mesh_id", "face", F.array((F.col("face") % 3) / 2.0, F.lit(0.25)).alias("p"))
    ax = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 2.0), (0, 1, 0.0, 1.0, 0.0, 1.0), (0, 2, 0.0, 0.6, 0.8, 3.0)], "mesh_id int, axis int, ax double, ay double, az double, extent double")
    got = {(r.face, r.axis, r.xb, r.label): r.mass for r in descriptors.axis_context(g, p, ax, 2, tile_rows=tile).collect()}
    rows = g.collect()
    total = sum(r.area for r in rows)
    want = {}
    for a in rows:
        for b in rows:
            for axis, (d, reach) in enumerate([((1, 0, 0), 2.0), ((0, 1, 0), 1.0), ((0, 0.6, 0.8), 3.0)]):
                gap = abs((b.gx - a.gx) * d[0] + (b.gy - a.gy) * d[1] + (b.gz - a.gz) * d[2])
                ends = hist.log_edges(5, 1.2 * reach)
                for i in range(5):
                    if ends[i] <= gap <= ends[i + 1]:
                        for c, prob in enumerate(((b.face % 3) / 2.0, 0.25)):
                            if prob:
                                key = (a.face, axis, i, c)
                                want[key] = want.get(key, 0.0) + b.area / total * prob / (gap / reach + 0.1)
    assert got == pytest.approx(want)
