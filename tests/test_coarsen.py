import random

from pyspark.sql import functions as F

from facetry.operators import coarsen


def greedy(nodes, edges, rank):
    """Sequential matching, the definition the parallel rounds must reproduce."""
    nbrs = {n: {} for n in nodes}
    for i, j, w in edges:
        nbrs[i][j] = w
    deg = {n: sum(nbrs[n].values()) for n in nodes}
    cluster, count = {}, 0
    for n in sorted(nodes, key=rank.get):
        if n in cluster:
            continue
        best, gain = None, 0.0
        for m in sorted(nbrs[n]):
            if m not in cluster and m != n:
                g = round(nbrs[n][m] * (1 / deg[n] + 1 / deg[m]), 12)
                if g > gain:
                    best, gain = m, g
        cluster[n] = count
        if best is not None:
            cluster[best] = count
        count += 1
    return cluster


def random_graph(n, m, seed):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    w = {p: round(rnd.uniform(0.1, 2), 3) for p in pairs}
    return [(i, j, x) for (i, j), x in w.items()] + [(j, i, x) for (i, j), x in w.items()]


def test_matching_equals_sequential_greedy(spark):
    rnd = random.Random(5)
    rows, ranks, expected = [], [], {}
    for g, (n, m) in enumerate([(12, 14), (40, 70), (30, 29)]):
        edges = random_graph(n, m, g)
        order = list(range(n))
        rnd.shuffle(order)
        rank = {node: r for r, node in enumerate(order)}
        rows += [(g, i, j, w) for i, j, w in edges]
        ranks += [(g, node, r) for node, r in rank.items()]
        expected.update({(g, k): v for k, v in greedy(range(n), edges, rank).items()})
    e = spark.createDataFrame(rows, "g int, i long, j long, w double")
    o = spark.createDataFrame(ranks, "g int, node long, rank long")
    deg = o.select("g", "node").join(
        e.groupBy("g", F.col("i").alias("node")).agg(F.sum("w").alias("degree")), ["g", "node"], "left"
    ).fillna(0.0)
    got = coarsen.matching(e, deg, o, ["g"])
    assert {(r.g, r.node): r.cluster for r in got.collect()} == expected


def test_star_with_one_hot_hub(spark):
    edges = [(0, k, 1.0) for k in range(1, 60)] + [(k, 0, 1.0) for k in range(1, 60)]
    e = spark.createDataFrame(edges, "i long, j long, w double")
    nodes = spark.range(60).select(F.col("id").alias("node"))
    _, parents = coarsen.coarsen(e, nodes, 1)
    sizes = [r["count"] for r in parents[0].groupBy("cluster").count().collect()]
    assert sorted(sizes) == [1] * 58 + [2]


def test_tree_orders_golden(spark):
    # fixed values: a known pair of parent lists and their orders
    p0, p1 = [4, 1, 1, 2, 2, 3, 0, 0, 3], [2, 1, 0, 1, 0]
    parents = [
        spark.createDataFrame(list(enumerate(p)), "node long, cluster long") for p in (p0, p1)
    ]
    orders = coarsen.tree_orders(parents)
    got = [[r.node for r in o.orderBy("pos").collect()] for o in orders]
    assert got == [[3, 4, 0, 9, 1, 2, 5, 8, 6, 7, 10, 11], [2, 4, 1, 3, 0, 5], [0, 1, 2]]


def test_two_levels_give_a_bijection(spark):
    edges = random_graph(30, 45, 9)
    e = spark.createDataFrame(edges, "i long, j long, w double")
    nodes = spark.range(30).select(F.col("id").alias("node"))
    graphs, parents = coarsen.coarsen(e, nodes, 2)
    orders = coarsen.tree_orders(parents)
    n_top = parents[1].select("cluster").distinct().count()
    finest = [r.node for r in orders[0].orderBy("pos").collect()]
    assert sorted(finest) == list(range(4 * n_top))
    total = [g.agg(F.sum("w")).first()[0] for g in graphs]
    assert all(abs(t - total[0]) < 1e-9 for t in total)
    rows = nodes.withColumn("x", F.col("node") * 1.0)
    padded = coarsen.pad_rows(orders[0], rows, "node", {"x": 0.0})
    back = coarsen.unpad_rows(padded.select("pos", "x"), orders[0], 30)
    assert {r.node: r.x for r in back.collect()} == {i: float(i) for i in range(30)}
    nbrs = e.select(F.col("i").alias("src"), F.lit(1).alias("slot"), F.col("j").alias("dst"))
    moved = coarsen.permuted_neighbours(nbrs, orders[0], nodes, 2)
    first_fake = finest.index(30)
    fakes = moved.filter(~F.col("pos").isin([p for p, n in enumerate(finest) if n < 30])).collect()
    assert {r.nbr for r in fakes} == {first_fake} and len(fakes) == 2 * (4 * n_top - 30)
