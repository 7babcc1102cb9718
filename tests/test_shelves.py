"""Rows of the neighbour search travel once per shelf, not once per tile."""

import numpy as np
from pyspark.sql import functions as F

from facetry.operators import neighbours


def _points(n, size, seed):
    return np.round(np.random.default_rng(seed).standard_normal((n, size)), 2)


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def _brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {(i, s + 1, int(j)) for i in range(len(x)) for s, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])}


def test_rows_meet_shelves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHELF_ROWS", 20)  # cells beyond 20 rows are dealt to parts
    x = _points(300, 8, 1)
    sent = []
    real = neighbours._routed

    def spy(queries, placed, layout, k):
        sent.append((len(layout.cell), int(layout.parts.sum())))
        return real(queries, placed, layout, k)

    monkeypatch.setattr(neighbours, "_routed", spy)
    got = {(r.src, r.slot, r.dst) for r in neighbours.knn(_frame(spark, x), "id", "v", 3, tile_rows=4).collect()}
    assert got == _brute(x, 3)
    (cells, parts), = sent
    assert cells > 60 and parts <= 2 * 300 / 20 + 2


def test_shelves_keep_their_size():
    x, rows = _points(500, 3, 2), np.random.default_rng(3).integers(1, 30, 500)
    groups = neighbours._halves(x, rows, np.arange(500), 100)
    assert sorted(np.concatenate(groups)) == list(range(500))
    assert max(rows[g].sum() for g in groups) <= 100 and len(groups) <= 4 * rows.sum() / 100


def test_nearest_over_shelves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHELF_ROWS", 16)
    x, q = _points(200, 3, 4), _points(50, 3, 5)
    out = neighbours.nearest(_frame(spark, q), _frame(spark, x), "id", "v", 2, tile_rows=8)
    got = {(r.src, r.slot, r.dst) for r in out.select("src", F.col("slot"), "dst").collect()}
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert got == {(i, s + 1, int(j)) for i in range(50) for s, j in enumerate(np.lexsort((np.arange(200), d[i]))[:2])}
