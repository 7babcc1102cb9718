import heapq
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import hist, hops, mesh, neighbours, tiles, votes


def graph(n, m, seed):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))): round(rnd.uniform(0.2, 2), 3) for _ in range(m)}
    return [(i, j, w) for (i, j), w in pairs.items()] + [(j, i, w) for (i, j), w in pairs.items()]


@pytest.mark.parametrize("tile", [4096, 16])
def test_knn_is_exact_for_any_tile_size(spark, tile):
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=(60, 3)), rnd.normal(size=(30, 3)) * 0.01 + 4, np.ones((12, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in neighbours.knn(df, "id", "v", 4, tile_rows=tile).collect():
        got.setdefault(r.src, {})[r.slot] = r.dst
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        best = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert [got[i][s] for s in range(1, 5)] == [j for _, j in best]


def test_bounded_distances_equal_dijkstra_with_the_outer_ring(spark):
    edges = graph(25, 45, 3)
    nbr = {}
    for i, j, w in edges:
        nbr.setdefault(i, []).append((j, w))
    radius, want = 1.5, {}
    for s in range(25):
        dist, done, heap = {s: 0.0}, set(), [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if d > radius:
                continue
            for v, w in nbr.get(u, []):
                if d + w < dist.get(v, 1e9):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        want.update({(s, v): round(d, 9) for v, d in dist.items()})
    e = spark.createDataFrame(edges, "i long, j long, w double")
    src = spark.range(25).select(F.col("id").alias("src"))
    got = hops.bounded_distances(e, src, radius)
    assert {(r.src, r.node): round(r.d, 9) for r in got.collect()} == want


def test_hop_neighbours_follow_breadth_first_order(spark):
    edges = [*graph(20, 26, 4), *[(0, k, 1.0) for k in range(5, 20)], *[(k, 0, 1.0) for k in range(5, 20)]]
    weight = {}
    for i, j, w in edges:
        weight[i, j] = w
    adj = {}
    for i, j in sorted(weight):
        adj.setdefault(i, []).append(j)
    k, want = 4, {}
    for root in adj:
        seen, queue, order = {root}, deque([root]), []
        while queue and len(order) + 1 < k + 2:
            u = queue.popleft()
            for v in adj[u]:
                if v not in seen:
                    seen.add(v)
                    queue.append(v)
                    order.append(v)
        first = order[:k]
        ranked = sorted(range(len(first)), key=lambda p: (-weight.get((root, first[p]), 0.0), p))
        want[root] = [first[p] for p in ranked]
    e = spark.createDataFrame([(i, j, w) for (i, j), w in weight.items()], "i long, j long, w double")
    got = {}
    for r in hops.hop_neighbours(e, k).orderBy("src", "slot").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == want


def test_components_of_a_long_chain_and_isolated_nodes(spark):
    chain = [(i, i + 1, 1.0) for i in range(40)]
    e = spark.createDataFrame([*chain, (50, 51, 1.0)], "i long, j long, w double")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 50, 51, 60]], "node long")
    got = {r.node: r.root for r in hops.components(e, nodes).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 60: 60}


def test_gated_patch_matches_a_priority_walk(spark):
    rnd = random.Random(8)
    edges = graph(24, 34, 8)
    normal = {n: rnd.choice([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0)]) for n in range(24)}
    nbr = {}
    for i, j, w in edges:
        nbr.setdefault(i, []).append((j, w))
    radius, least, gate, want = 1.2, 3, 0.0, {}
    for s in range(24):
        dist, done, heap, patch = {s: 0.0}, set(), [(0.0, s)], []
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if sum(a * b for a, b in zip(normal[u], normal[s])) > gate or len(patch) <= least:
                patch.append(u)
            else:
                continue
            if d > radius and len(patch) > least:
                continue
            for v, w in nbr.get(u, []):
                if v not in done and d + w < dist.get(v, 1e9):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        want[s] = sorted(patch)
    e = spark.createDataFrame(edges, "i long, j long, w double")
    n = spark.createDataFrame([(k, *v) for k, v in normal.items()], "node long, nx double, ny double, nz double")
    got = {}
    for r in hops.gated_distances(e, n, radius, least, gate).collect():
        got.setdefault(r.src, []).append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_tile_pairs_cover_every_pair_once(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), "id", F.lit(1.0).alias("w"))

    def kernel(a, b):
        out = a[["g", "id"]].reset_index(drop=True)
        out["n"] = float(len(b))
        return out

    parts = tiles.tile_product(df, df, ["g"], "id", "id", kernel, "g long, id long, n double", tile_rows=7)
    got = {(r.g, r.id): r.n for r in parts.groupBy("g", "id").agg(F.sum("n").alias("n")).collect()}
    sizes = {0: 17, 1: 17, 2: 16}
    assert got == {(i % 3, i): float(sizes[i % 3]) for i in range(50)}


def test_values_on_a_bin_edge_count_twice_and_soft_mass_is_kept(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (0, 0.5, 0.5)], "g int, x double, y double")
    out = hist.hard(df, ["g"], F.col("x"), F.col("y"), F.lit(1.0), [0.0, 1.0, 2.0], [0.0, 1.0])
    assert {(r.xb, r.yb): r.mass for r in out.collect()} == {(0, 0): 2.0, (1, 0): 1.0}
    soft = hist.soft(df, ["g"], F.col("x") * 5, F.col("y") * 5, F.lit(0.5))
    assert soft.agg(F.sum("mass")).first()[0] == pytest.approx(1.0)


def test_three_tie_rules(spark):
    v = spark.createDataFrame([(1, 2), (1, 5), (2, 4)], "s int, l int")
    assert {r.s: r.vote for r in votes.majority(v, ["s"], "l").collect()} == {1: 2, 2: 4}
    sc = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.5)], "s int, c int, p double")
    assert votes.argmax_skip_zero(sc, ["s"], "p", "c").first().pred == 1
    best = votes.ranked_scores(sc, ["s"], "p", "c", 3)
    assert [b.label for b in best.first().best] == [0, 2, 1]
    # class 0 on top passes its place to the next best class, which is the higher one of the tie
    counts = [best.select(*votes.top_k_counts(F.col("best"), F.lit(t), 1)).first() for t in (0, 1, 2)]
    assert [tuple(c) for c in counts] == [(True, 1), (False, 0), (False, 1)]
    # among the top two the hit and the handed place both count
    counts = [best.select(*votes.top_k_counts(F.col("best"), F.lit(t), 2)).first() for t in (0, 1, 2)]
    assert [tuple(c) for c in counts] == [(True, 1), (False, 0), (True, 2)]


def test_smoothing_keeps_the_boundary_and_flattens_a_spike(spark):
    pts = [(0, k, float(k % 3), float(k // 3), 1.0 if k == 4 else 0.0) for k in range(9)]
    tri = []
    for y in range(2):
        for x in range(2):
            v = y * 3 + x
            tri += [(v, v + 1, v + 3), (v + 1, v + 4, v + 3)]
    v = spark.createDataFrame(pts, "mesh_id int, v int, x double, y double, z double")
    f = spark.createDataFrame([(0, k, *t) for k, t in enumerate(tri)], "mesh_id int, face int, v0 int, v1 int, v2 int")
    out = {r.v: (r.x, r.y, r.z) for r in mesh.smooth(v, f, 0.5, rounds=2).collect()}
    assert out[4][2] == pytest.approx(0.25)
    assert all(out[k] == (float(k % 3), float(k // 3), 0.0) for k in range(9) if k != 4)
