"""The gated walk writes every pair once and equals a plain walk, also along one-way steps."""

import pytest
from pyspark.sql import functions as F

from facetry.operators import spatial

#: One strip of nodes with a blocked one, its steps both ways or with two that lead only one way.
STRIP = [(i, i + 1) for i in range(12)] + [(2, 6), (6, 9)]
BOTH = STRIP + [(j, i) for i, j in STRIP]
ONE_WAY = [*BOTH, (10, 0), (11, 3)]


def plain(steps, reach, blocked):
    met = set()
    for src in range(13):
        seen, todo = {src}, [src]
        while todo:
            i = todo.pop()
            for a, j in steps:
                if a == i and j not in seen and j != blocked and abs(j - src) <= reach:
                    seen.add(j)
                    todo.append(j)
        met |= {(0, src, n) for n in seen}
    return met


@pytest.mark.parametrize("steps", [BOTH, ONE_WAY])
@pytest.mark.parametrize("summed", [False, True])
def test_each_pair_is_written_once(spark, monkeypatch, steps, summed):
    written = []

    def counted(df, cut=spatial.cut):
        out = cut(df)
        written.append(out.select(F.explode("nodes")).count() if "nodes" in out.columns else out.count())
        return out

    monkeypatch.setattr(spatial, "cut", counted)
    nodes = spark.range(13).select(F.lit(0).alias("mesh_id"), F.col("id").alias("src"), F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, i, j) for i, j in steps], "mesh_id int, i long, j long")
    gate = (F.col("node") == F.col("src")) | ((F.abs(F.col("at") - F.col("place")) <= 7) & (F.col("at") != 4))
    left = nodes.select("mesh_id", "src", F.col("src").alias("place"))
    right = nodes.select("mesh_id", "node", F.col("node").alias("at"))
    want = plain(steps, 7, 4)
    if summed:
        got = spatial._gated_walk(nodes, edges, left, right, gate, sums={"n": F.lit(1), "t": F.col("at")})
        rows = got.groupBy("src").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
        assert {(r.src, r.n, r.t) for r in rows} == {
            (s, sum(1 for x in want if x[1] == s), sum(x[2] for x in want if x[1] == s)) for s in range(13)
        }
    else:
        got = [tuple(r) for r in spatial._gated_walk(nodes, edges, left, right, gate).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(written) == len(want)
