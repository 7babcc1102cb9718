"""Cell-based search against plain loops, and the neighbour forest against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import approximate, cells, neighbours


def sheet(rng, n, offset=0.0, size=1.0):
    """A bumpy triangle soup."""
    a = rng.uniform(-1, 1, (n, 3)) * size + offset
    return np.concatenate([a, a + rng.normal(0, 0.4, (n, 3)), a + rng.normal(0, 0.4, (n, 3))], axis=1)


def first_hits(o, line, tri, skip, allowed):
    out = {}
    for i in range(len(o)):
        best = None
        for f, t in enumerate(tri):
            if f == skip[i] or not allowed(i, f):
                continue
            a, e1, e2 = t[:3], t[3:6] - t[:3], t[6:] - t[:3]
            m = np.array([-line[i], e1, e2]).T
            if abs(np.linalg.det(m)) < 1e-14:
                continue
            d, u, v = np.linalg.solve(m, o[i] - a)
            if u >= 0 and v >= 0 and u + v <= 1 and d > 0 and (best is None or d < best[0]):
                best = (d, f)
        if best:
            out[i] = best
    return out


@pytest.mark.parametrize("predicate", [False, True])
@pytest.mark.parametrize("per_cell", [1, 8, 1000])
def test_ray_hits(spark, per_cell, predicate):
    rng = np.random.default_rng(per_cell)
    rays, tris, want = [], [], {}
    for g in (0, 1):
        tri = sheet(rng, 120, offset=5.0 * g, size=1 + g)
        o = rng.uniform(-1.5, 1.5, (60, 3)) * (1 + g) + 5.0 * g
        line = rng.standard_normal((60, 3))
        line[:6] = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1]]
        line[6:10, 2] = 0
        line /= np.linalg.norm(line, axis=1, keepdims=True)
        o[10:15] = 40.0 + 5 * g
        line[10:13] = -1 / np.sqrt(3)
        skip = [int(x) for x in rng.integers(0, 120, 60)]
        allowed = (lambda i, f: (i + f) % 3 > 0) if predicate else (lambda i, f: True)
        want |= {(g, i): v for i, v in first_hits(o, line, tri, skip, allowed).items()}
        rays += [(g, i, skip[i] if i % 2 else None, *map(float, o[i]), *map(float, line[i])) for i in range(60)]
        for i in range(0, 60, 2):
            alone = first_hits(o[i : i + 1], line[i : i + 1], tri, [-1], lambda _, f, i=i: allowed(i, f))
            want.pop((g, i), None)
            want |= {(g, i): v for v in alone.values()}
        tris += [(g, f, *map(float, t)) for f, t in enumerate(tri)]
    r = spark.createDataFrame(rays, "m int, ray int, skip int, ox double, oy double, oz double, lx double, ly double, lz double")
    t = spark.createDataFrame(tris, "m int, face int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    rule = (lambda ray, tri: (ray["ray"] + tri["face"]) % 3 > 0) if predicate else None
    got = {(x.m, x.ray): (x.d, x.face) for x in cells.ray_hits(r, t, ["m"], per_cell, rule).collect()}
    assert sorted(got.keys() ^ want.keys()) == [] and len(want) > 10
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_rays_over_nothing(spark):
    r = spark.createDataFrame([], "m int, ray int, skip int, ox double, oy double, oz double, lx double, ly double, lz double")
    t = spark.createDataFrame([], "m int, face int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    assert cells.ray_hits(r, t, ["m"]).collect() == []


@pytest.mark.parametrize("cap", [None, 0.3])
@pytest.mark.parametrize("predicate", [False, True])
def test_nearest_points_and_lines(spark, cap, predicate):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(0, 0.01, (50, 3))])
    pts[-5:] = pts[0]  # equal points
    qs = np.concatenate([rng.normal(0, 1, (40, 3)), [[30, 0, 0], [0, -9, 2], pts[0]]])
    line = rng.standard_normal((len(qs), 3))
    line[:3] = np.eye(3)
    line /= np.linalg.norm(line, axis=1, keepdims=True)
    p = spark.createDataFrame([(1, *map(float, x), i) for i, x in enumerate(pts)], "m int, x double, y double, z double, id int")
    q = spark.createDataFrame(
        [(1, i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(qs, line))],
        "m int, q int, ox double, oy double, oz double, lx double, ly double, lz double",
    )
    rule = (lambda a, b: (a["q"] + b["id"]) % 7 == 0) if predicate else None
    fits = np.array([[not predicate or (i + j) % 7 == 0 for j in range(len(pts))] for i in range(len(qs))])
    gap = qs[:, None] - pts[None]
    direct = np.linalg.norm(gap, axis=2)
    across = np.linalg.norm(np.cross(gap, line[:, None]), axis=2)
    for dist, search in ((direct, cells.nearest_point), (across, cells.nearest_to_line)):
        dist = np.where(fits, dist, np.inf)
        got = {r.q: (r.d, r.point.id) for r in search(q, p, ["m"], "q", cap, rule).collect()}
        for i in range(len(qs)):
            best = dist[i].min()
            if best < (cap or np.inf):
                assert got[i][0] == pytest.approx(best, abs=1e-12)
                assert dist[i, got[i][1]] == pytest.approx(best, abs=1e-12)
            else:
                assert i not in got


def test_prefixes():
    codes = np.sort(np.random.default_rng(0).integers(0, 1 << 10, 40))
    got = approximate.prefixes(codes, 5, bits=10)
    for i in range(40):
        runs = [j for j in range(max(0, i - 4), min(i, 35) + 1)]
        want = max(10 - int(codes[j] ^ codes[j + 4]).bit_length() for j in runs)
        assert got[i] == want


@pytest.mark.parametrize("cell_rows", [64, 8192])
def test_forest_recall(spark, cell_rows):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 24))
    x = centre[rng.integers(20, size=1500)] + 0.6 * rng.standard_normal((1500, 24))
    x[:40] = x[0]  # equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 24), (9001, None)], "id long, v array<double>")
    found = approximate.knn_cosine_forest(df, "id", "v", 8, cell_rows=cell_rows).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    assert all(r.src != r.dst and abs(r.d - d[r.src, r.dst]) < 1e-9 for r in found)
    kth = np.sort(d + 9 * np.eye(len(x)), axis=1)[:, 7]
    good = sum(r.d <= kth[r.src] + 1e-9 for r in found)
    assert good >= 0.9 * 8 * len(x)
    with pytest.raises(ValueError):
        approximate.knn_cosine_forest(df, "id", "v", 50)


def test_forest_over_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert approximate.knn_cosine_forest(df, "id", "v", 3).collect() == []
    assert approximate.knn_cosine_forest(df.filter("id > 1"), "id", "v", 3).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    found = approximate.knn_cosine_forest(two, "id", "v", 3)
    exact = neighbours.knn_cosine(two, "id", "v", 3)
    assert approximate.recall(found, exact).select(F.col("recall")).first()[0] == 1.0
