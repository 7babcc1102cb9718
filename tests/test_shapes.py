"""Bounding balls, path statistics, curvature derivatives and matrices against numpy."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import matrices as X
from facetry.operators import derivatives, mesh, scales, spheres


def smallest(points):
    """Least radius over all support sets."""
    best = np.inf
    for size in (1, 2, 3, 4):
        for rows in combinations(range(len(points)), size):
            ball = spheres.circumsphere(points[list(rows)])
            if ball and ((points - ball[0]) ** 2).sum(1).max() <= ball[1] * (1 + 1e-9) + 1e-12:
                best = min(best, ball[1])
    return np.sqrt(best)


def test_bounding_spheres(spark, monkeypatch):
    monkeypatch.setattr(spheres, "CHUNK", 5)
    rng = np.random.default_rng(0)
    clouds = {
        1: rng.normal(0, 1, (14, 3)), 2: np.outer(np.arange(9.0), [1, 2, 3]), 3: rng.normal(0, 1, (1, 3)), 4: np.repeat(rng.normal(0, 1, (2, 3)), 6, axis=0),
        5: np.c_[rng.normal(0, 1, (12, 2)), np.zeros(12)], None: rng.uniform(-1, 1, (10, 3)), 7: np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1.0)]),
    }
    rows = [(g, *map(float, p)) for g, pts in clouds.items() for p in pts] + [(1, None, 0.0, 0.0), (1, float("nan"), 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(5)
    got = {r.g: r for r in spheres.bounding_spheres(df, ["g"]).collect()}
    assert got.keys() == clouds.keys()
    for g, pts in clouds.items():
        assert got[g].r == pytest.approx(smallest(pts), rel=1e-6, abs=1e-9)
        assert np.linalg.norm(pts - [got[g].cx, got[g].cy, got[g].cz], axis=1).max() <= got[g].r * (1 + 1e-6) + 1e-9
    assert spheres.bounding_spheres(df.filter("g > 100"), ["g"]).collect() == []


def sheet(spark, n=6):
    """A bumpy square of ``2 (n-1)^2`` triangles."""
    rng = np.random.default_rng(1)
    place = np.array([[x, y, 0.2 * np.sin(x) * y + 0.05 * rng.normal()] for y in range(n) for x in range(n)], float)
    tri = [t for y in range(n - 1) for x in range(n - 1) for a in [y * n + x] for t in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))]
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(place)], "mesh_id int, v long, x double, y double, z double")
    f = spark.createDataFrame([(0, i, *t) for i, t in enumerate(tri)], "mesh_id int, face long, v0 long, v1 long, v2 long")
    return place, tri, v, f


@pytest.mark.parametrize("samples, batch", [(5, 64), (40, 7)])
def test_path_statistics(spark, samples, batch):
    place, tri, v, _ = sheet(spark)
    n = len(place)
    pairs = {(a, b) for t in tri for a in t for b in t if a != b}
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b in pairs:
        d[a, b] = np.linalg.norm(place[a] - place[b])
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    edges = spark.createDataFrame([(0, a, b, float(np.linalg.norm(place[a] - place[b]))) for a, b in pairs], "mesh_id int, i long, j long, w double")
    areas = spark.createDataFrame([(0, i, 1.0 + i % 3) for i in range(n)], "mesh_id int, v long, area double")
    step = -(-n // samples)
    picked = list(range(0, n, step))
    got = {r.src: r for r in scales.path_statistics(edges, v, areas, samples, batch).collect()}
    assert sorted(got) == picked
    for s in picked:
        row, w = np.sort(d[s]), np.array([1.0 + i % 3 for i in picked if i != s])
        assert got[s].far == pytest.approx(row[-1])
        assert (got[s].middle, got[s].low) == (pytest.approx(row[n // 2]), pytest.approx(row[int(0.33 * n)]))
        assert got[s].mean == pytest.approx((d[s, [i for i in picked if i != s]] * w).sum() / w.sum())


def rodrigues(n, f):
    turn, c = np.cross(n, f), n @ f
    k = np.array([[0, -turn[2], turn[1]], [turn[2], 0, -turn[0]], [-turn[1], turn[0], 0]])
    return c * np.eye(3) + k + np.outer(turn, turn) / (1 + c)


def test_curvature_derivatives(spark):
    place, tri, v, f = sheet(spark, 4)
    g = mesh.face_geometry(f, v)
    vn = mesh.vertex_normals(g)
    k = mesh.principal_curvatures(g, vn)
    at = {r.v: r for r in vn.join(k, ["mesh_id", "v"]).collect()}
    share = {(r.face, i): r[f"w{i}"] for r in g.select("face", *[w.alias(f"w{i}") for i, w in enumerate(mesh.corner_areas(g))]).collect() for i in range(3)}
    vec = lambda r, n: np.array([r[f"{n}{c}"] for c in "xyz"])
    total, weight = {i: np.zeros((3, 3, 3)) for i in at}, dict.fromkeys(at, 0.0)
    for face, t in enumerate(tri):
        p = place[list(t)]
        normal = np.cross(p[1] - p[0], p[2] - p[0])
        normal /= np.linalg.norm(normal)
        u = (p[1] - p[0]) / np.linalg.norm(p[1] - p[0])
        axes = np.array([u, np.cross(normal, u)])
        flat = []
        for i in t:
            r = at[i]
            world = r.k1 * np.outer(vec(r, "d1"), vec(r, "d1")) + r.k2 * np.outer(vec(r, "d2"), vec(r, "d2"))
            turn = rodrigues(vec(r, "n"), normal)
            flat.append(axes @ turn @ world @ turn.T @ axes.T)
        left, right = [], []  # unknowns D000, D001, D011, D111; both mixed entries count
        for a, b in ((0, 1), (1, 2), (2, 0)):
            x, y = axes @ (p[b] - p[a])
            change = flat[b] - flat[a]
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                row = np.zeros(4)
                row[i + j] += x
                row[i + j + 1] += y
                left.append(row)
                right.append(change[i, j])
        solved = np.linalg.lstsq(np.array(left), np.array(right), rcond=None)[0]
        form = np.einsum("ijk,ia,jb,kc->abc", np.array([[[solved[i + j + m] for m in range(2)] for j in range(2)] for i in range(2)]), axes, axes, axes)
        for corner, i in enumerate(t):
            back = rodrigues(vec(at[i], "n"), normal).T
            total[i] += share[face, corner] * np.einsum("ijk,ai,bj,ck->abc", form, back, back, back)
            weight[i] += share[face, corner]
    got = {r.v: r for r in derivatives.curvature_derivatives(g, vn, k).collect()}
    assert got.keys() == at.keys()
    for i, r in got.items():
        form = total[i] / weight[i]
        d1, d2 = vec(at[i], "d1"), vec(at[i], "d2")
        want = [np.einsum("abc,a,b,c", form, *which) for which in ((d1, d1, d1), (d1, d1, d2), (d1, d2, d2), (d2, d2, d2))]
        assert [r.c111, r.c112, r.c122, r.c222] == pytest.approx(want, abs=1e-8)
        assert r.norm2 == pytest.approx((form**2).sum(), abs=1e-8)


def test_matrices(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 2, 3, 5):
        a = rng.normal(0, 1, (n, n))
        a[0, 0] = 0.0  # needs a pivot from below
        rows += [(a.tolist(), rng.normal(0, 1, n).tolist()) for _ in range(2)]
    rows += [([[1.0, 2.0], [2.0, 4.0]], [1.0, 2.0]), ([[0.0] * 3] * 3, [1.0] * 3), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<array<double>>, b array<double>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", X.solve(a, b).alias("x"), X.inverse(a).alias("inv"), X.determinant(a).alias("det"), X.multiply(a, a).alias("sq")).collect():
        if r.a is None:
            assert r.x is None and r.inv is None and r.det is None
            continue
        m = np.array(r.a)
        assert np.array(r.sq) == pytest.approx(m @ m)
        if abs(np.linalg.det(m)) < 1e-12:
            assert r.x is None and r.inv is None and r.det == 0
        else:
            assert r.x == pytest.approx(np.linalg.solve(m, r.b))
            assert np.array(r.inv) == pytest.approx(np.linalg.inv(m))
            assert r.det == pytest.approx(np.linalg.det(m))


def test_transforms(spark):
    one = spark.range(1)
    turn = X.rotation(F.lit(0.7), F.lit(1.0), F.lit(2.0), F.lit(-0.5))
    still = X.rotation(F.lit(0.7), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    r = one.select(turn.alias("t"), still.alias("s"), X.orthogonalise(turn).alias("o"), X.translation_only(X.translation(1, 2, 3)).alias("m")).first()
    t = np.array(r.t)
    assert t[:3, :3] @ t[:3, :3].T == pytest.approx(np.eye(3)) and np.linalg.det(t) == pytest.approx(1)
    assert t[:3, :3] @ [1, 2, -0.5] == pytest.approx([1, 2, -0.5])
    assert np.array(r.o) == pytest.approx(t) and np.array(r.s) == pytest.approx(np.eye(4))
    assert [row[3] for row in r.m] == [1, 2, 3, 1]
