"""Work that small groups do in tasks of their own, crowded searches, and what is left on disk."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import approximate, cells, neighbours
from facetry.session import CLEANUP, cut


def test_rays_meet_the_same_triangles_in_a_task_and_on_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a = rng.uniform(-1, 1, (80, 3))
    tri = np.concatenate([a, a + rng.normal(0, 0.4, (80, 3)), a + rng.normal(0, 0.4, (80, 3))], axis=1)
    tris = [(g, f, *map(float, t)) for g in (0, 1) for f, t in enumerate([*tri, tri[3]])]  # the last is a copy of face 3
    line = rng.standard_normal((50, 3))
    line /= np.linalg.norm(line, axis=1, keepdims=True)
    rays = [(g, i, i if i % 3 else None, *map(float, rng.uniform(-1, 1, 3)), *map(float, line[i])) for g in (0, 1, 2) for i in range(50)]
    rays += [rays[0], (0, 60, 1, None, 0.0, 0.0, 0.0, 0.0, 1.0)]
    r = spark.createDataFrame(rays, "m int, ray long, skip long, ox double, oy double, oz double, lx double, ly double, lz double")
    t = spark.createDataFrame(tris, "m int, face long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    got = {}
    for most in (4096, 0):
        monkeypatch.setattr(cells, "LOCAL_TRIANGLES", most)
        got[most] = sorted(map(tuple, cells.ray_hits(r, t, ["m"]).collect()))
    assert got[4096] == got[0] and len(got[0]) > 20
    monkeypatch.setattr(cells, "LOCAL_TRIANGLES", 4096)
    monkeypatch.setattr(cells, "_walked_hits", None)  # no small group goes to the grid
    assert sorted(map(tuple, cells.ray_hits(r, t, ["m"]).collect())) == got[0]


def test_cells_shrink_where_points_crowd(spark):
    """A dense ball and a few far points: the first cells must not hold the ball."""
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 0.01, (2000, 3)), rng.uniform(-5, 5, (20, 3))])
    points = spark.createDataFrame([(1, *map(float, x)) for x in p], "c int, x double, y double, z double")
    corners = points.select("c", *[F.col(k).alias(f"{e}{k}") for e in ("lo", "hi") for k in "xyz"])
    grid = cells._grid(corners, ["c"], 8)
    wide, small = grid.first()["h"], cells._first_size(points, grid, ["c"], 8).first()["h"]
    assert wide > 1.0 and small < 0.05


@pytest.mark.parametrize("seen", [30, 59])
def test_lines_pass_points_that_do_not_count(spark, seen):
    """The nearest ``seen`` points are not compatible, which is more than a tile tells at first."""
    points = spark.createDataFrame([(1, i, 0.0, 0.1 * i, 0.0) for i in range(60)], "c int, id int, x double, y double, z double")
    lines = spark.createDataFrame([(1, 7, -3.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "c int, q int, ox double, oy double, oz double, lx double, ly double, lz double")
    got = cells.nearest_to_line(lines, points, ["c"], compatible=lambda _, p: p["id"] >= seen).collect()
    assert [(r.q, r.point.id) for r in got] == [(7, seen)] and got[0].d == pytest.approx(0.1 * seen)
    assert cells.nearest_to_line(lines, points, ["c"], max_distance=2.0, compatible=lambda _, p: p["id"] >= seen).count() == 0


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1e3, 1.0), (1e6, 1e-3), (0.0, 1e-20), (0.0, 1e20)])
def test_pieces_of_candidates_find_the_nearest(monkeypatch, offset, scale):
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)) * scale + offset
    x[5] = np.nan  # finds nothing and hides nothing
    ids = rng.permutation(700)
    got = neighbours._blocks(ids[:90], x[:90], ids, x, 4, np.full(90, np.inf))
    d = np.sqrt(((x[:90, None] - x[None]) ** 2).sum(2))
    want = {}
    for i in range(90):
        order = np.lexsort((ids, np.where(np.isnan(d[i]), np.inf, d[i])))
        want[ids[i]] = [ids[j] for j in order if j != i and np.isfinite(d[i, j])][:4]
    assert got.groupby("src")["dst"].agg(list).to_dict() == {k: v for k, v in want.items() if v}


def test_trees_in_batches_find_what_they_find_at_once(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((400, 6))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    find = lambda **kw: approximate.knn_cosine_forest(points, "id", "v", 3, candidates=8, **kw)
    whole = sorted((r.src, r.slot, r.dst) for r in find(trees=5).collect())
    monkeypatch.setattr(approximate, "TREE_BATCH", 2)
    assert sorted((r.src, r.slot, r.dst) for r in find(trees=5).collect()) == whole
    assert sorted((r.src, r.slot, r.dst) for r in find(trees=5, first=3, known=find(trees=3)).collect()) == whole


def test_a_written_table_leaves_no_shuffle_files(spark):
    def kept():
        return set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())

    before = spark.conf.get(CLEANUP, None)
    old = {f for f in kept() if "shuffle" in f}
    out = cut(spark.range(100000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        if not {f for f in kept() if "shuffle" in f} - old:
            break
        time.sleep(0.5)
    assert not {f for f in kept() if "shuffle" in f} - old
    assert out.count() == 7 and spark.conf.get(CLEANUP, None) == before
