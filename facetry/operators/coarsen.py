"""Graph coarsening: greedy heavy-edge matching in parallel rounds, and balanced-tree orderings.

The matching equals the sequential one (visit nodes by rank, pair each free node with its best free
neighbour).  A node's turn depends only on free nodes of lower rank within two hops, so every node
that is lowest in its two-hop neighbourhood takes its turn in the same round.  With a scattered
order the number of rounds grows with the logarithm of the graph, not with its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.graph import degrees
from facetry.operators.ordered import running
from facetry.session import cut

# sums arrive in varying order; degrees are compared after rounding so that equal ones stay equal
ORDER_DIGITS = 9


def scattered_order(nodes: DataFrame, group: list[str], seed: int = 0) -> DataFrame:
    """``(group, node, rank)`` in a reproducible pseudo-random order."""
    keyed = nodes.withColumn("_h", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)))
    return running(keyed, group, "_h", "node", pos="rank").select(*group, "node", "rank")


def degree_order(edges: DataFrame, group: list[str]) -> DataFrame:
    deg = degrees(edges, group).select(*group, F.col("i").alias("node"), F.round("degree", ORDER_DIGITS).alias("_d"))
    return running(deg, group, "_d", "node", pos="rank").select(*group, "node", "rank")


def matching(edges: DataFrame, weights: DataFrame, order: DataFrame, group: list[str]) -> DataFrame:
    """``(group, node, cluster)``: clusters of one or two nodes, numbered in visiting order.

    ``edges(i, j, w)`` hold both directions, ``weights(node, degree)``, ``order(node, rank)``.  The
    partner maximises ``w * (1/degree_i + 1/degree_j)``; the lowest id wins a tie.
    """
    facts = order.join(weights.select(*group, "node", "degree"), [*group, "node"])
    a = facts.select(*group, F.col("node").alias("i"), F.col("rank").alias("ri"), F.col("degree").alias("_di"))
    b = facts.select(*group, F.col("node").alias("j"), F.col("rank").alias("rj"), F.col("degree").alias("_dj"))
    gain = F.col("w") * (1 / F.col("_di") + 1 / F.col("_dj"))
    live = edges.filter((F.col("i") != F.col("j")) & (F.col("w") > 0)).join(a, [*group, "i"]).join(b, [*group, "j"])
    live = cut(live.select(*group, "i", "j", "ri", "rj", F.round(gain, 12).alias("gain")))
    taken = None
    while not live.isEmpty():
        near = live.groupBy(*group, "i", "ri").agg(F.least(F.col("ri"), F.min("rj")).alias("m1"))
        far = live.join(near.select(*group, F.col("i").alias("j"), "m1"), [*group, "j"])
        turn = far.groupBy(*group, "i", "ri").agg(
            F.min("m1").alias("m2"),
            F.max_by("j", F.struct(F.col("gain"), -F.col("j"))).alias("partner"),
        )
        pairs = cut(turn.filter(F.col("ri") <= F.col("m2")).select(*group, "i", "partner"))
        taken = pairs if taken is None else taken.unionByName(pairs)
        gone = pairs.select(*group, F.explode(F.array("i", "partner")).alias("node"))
        live = live.join(gone.withColumnRenamed("node", "i"), [*group, "i"], "left_anti")
        live = cut(live.join(gone.withColumnRenamed("node", "j"), [*group, "j"], "left_anti"))
    if taken is None:
        led = order.withColumn("leader", F.col("node"))
    else:
        follow = taken.select(*group, F.col("partner").alias("node"), F.col("i").alias("leader"))
        led = order.join(follow, [*group, "node"], "left").withColumn("leader", F.coalesce("leader", "node"))
    lead = led.filter(F.col("leader") == F.col("node")).select(*group, "leader", "rank")
    numbered = running(lead, group, "rank", "leader", pos="cluster").select(*group, "leader", "cluster")
    return led.join(numbered, [*group, "leader"]).select(*group, "node", "cluster")


def collapse_edges(edges: DataFrame, clusters: DataFrame, group: list[str]) -> DataFrame:
    """Edges of the coarser graph; parallel edges add up and inner edges become self loops."""
    a = clusters.select(*group, F.col("node").alias("i"), F.col("cluster").alias("ci"))
    b = clusters.select(*group, F.col("node").alias("j"), F.col("cluster").alias("cj"))
    out = edges.join(a, [*group, "i"]).join(b, [*group, "j"]).groupBy(*group, "ci", "cj").agg(F.sum("w").alias("w"))
    return out.withColumnsRenamed({"ci": "i", "cj": "j"})


def coarsen(
    edges: DataFrame, nodes: DataFrame, levels: int, group: list[str] | None = None, order: DataFrame | None = None, seed: int = 0
) -> tuple[list[DataFrame], list[DataFrame]]:
    """``levels`` coarsenings of all graphs of the table: (graphs, parents).

    ``graphs[l]`` is an edge table; ``parents[l](node, cluster)`` maps level ``l`` to ``l + 1``.  The
    first level visits in ``order`` (default: scattered), later ones by ascending degree.  Nodes
    without edges keep travelling as singletons.
    """
    group = group or []
    g = cut(edges.select(*group, "i", "j", "w"))
    nodes = cut(nodes.select(*group, "node"))
    order = order or scattered_order(nodes, group, seed)
    graphs, parents = [g], []
    for level in range(levels):
        plain = g.filter(F.col("i") != F.col("j")) if level == 0 else g
        deg = degrees(plain, group).withColumnRenamed("i", "node")
        deg = nodes.join(deg, [*group, "node"], "left").fillna(0.0, ["degree"])
        if level:
            rank = deg.withColumn("_d", F.round("degree", ORDER_DIGITS))
            order = running(rank, group, "_d", "node", pos="rank").select(*group, "node", "rank")
        clusters = cut(matching(g, deg, order, group))
        g = cut(collapse_edges(g, clusters, group))
        nodes = cut(clusters.select(*group, F.col("cluster").alias("node")).distinct())
        graphs.append(g)
        parents.append(clusters)
    return graphs, parents


def tree_orders(parents: list[DataFrame], group: list[str] | None = None) -> list[DataFrame]:
    """Per level, finest first: ``(group, pos, node)`` such that siblings are neighbours.

    Every node gets exactly two children on the level below: a single child gets one fake sibling, a
    fake parent two.  Fakes are numbered after the real nodes, by position.
    """
    group = group or []
    top = parents[-1].select(*group, F.col("cluster").alias("node")).distinct()
    level = top.select(*group, F.col("node").alias("pos"), "node")
    out = [level]
    for parent in reversed(parents):
        real = parent.groupBy(*group).agg(F.count(F.lit(1)).alias("_real")) if group else None
        kids = parent.groupBy(*group, F.col("cluster").alias("_p")).agg(F.min("node").alias("_c0"), F.max("node").alias("_c1"))
        slots = level.select(*group, "pos", F.col("node").alias("_p")).join(kids, [*group, "_p"], "left")
        second = F.when(F.col("_c1") != F.col("_c0"), F.col("_c1"))
        rows = F.array(
            F.struct((F.col("pos") * 2).alias("pos"), F.col("_c0").alias("node")),
            F.struct((F.col("pos") * 2 + 1).alias("pos"), second.alias("node")),
        )
        flat = slots.select(*group, F.inline(rows))
        fake = {"_fakes": F.col("node").isNull().cast("long")}
        flat = running(flat, group, "pos", "pos", fake, pos="_n")
        if group:
            flat = flat.join(real, group)
        else:
            flat = flat.withColumn("_real", parent.agg(F.count(F.lit(1))).scalar())
        number = F.coalesce(F.col("node"), F.col("_real") + F.col("_fakes") - 1)
        level = cut(flat.select(*group, "pos", number.alias("node")))
        out.append(level)
    return out[::-1]


def pad_rows(order: DataFrame, rows: DataFrame, key: str, fill: dict, group: list[str] | None = None) -> DataFrame:
    """Rows in tree order with fake rows filled in: ``(group, pos, is_fake, ...)``."""
    group = group or []
    data = rows.withColumnRenamed(key, "node").withColumn("_real", F.lit(True))
    out = order.join(data, [*group, "node"], "left").withColumn("is_fake", F.col("_real").isNull())
    for name, value in fill.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out.drop("_real")


def unpad_rows(predictions: DataFrame, order: DataFrame, n_real: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Inverse permutation: predictions by position become predictions by node, fakes dropped."""
    group = group or []
    out = predictions.join(order, [*group, "pos"])
    keep = F.col("node") < F.lit(n_real) if n_real is not None else ~F.col("is_fake")
    return out.filter(keep).drop("pos")


def permuted_neighbours(nbrs: DataFrame, order: DataFrame, nodes: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """Neighbour lists by tree position ``(group, pos, slot, nbr)``; a fake row points at the first fake.

    ``nbrs(src, slot, dst)``; a missing neighbour stays a missing row.
    """
    group = group or []
    a = order.select(*group, "pos", F.col("node").alias("src"))
    b = order.select(*group, F.col("pos").alias("nbr"), F.col("node").alias("dst"))
    real = nbrs.join(a, [*group, "src"]).join(b, [*group, "dst"]).select(*group, "pos", "slot", "nbr")
    fakes = order.join(nodes.select(*group, "node"), [*group, "node"], "left_anti")
    first = fakes.groupBy(*group).agg(F.min_by("pos", "node").alias("nbr"))
    slots = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot")
    if group:
        faked = fakes.join(first, group).select(*group, "pos", slots, "nbr")
    else:
        faked = fakes.withColumn("nbr", first.scalar()).select("pos", slots, "nbr")
    return real.unionByName(faked)


def permuted_edges(edges: DataFrame, order: DataFrame, group: list[str] | None = None) -> DataFrame:
    group = group or []
    a = order.select(*group, F.col("node").alias("i"), F.col("pos").alias("pi"))
    b = order.select(*group, F.col("node").alias("j"), F.col("pos").alias("pj"))
    out = edges.join(a, [*group, "i"]).join(b, [*group, "j"])
    return out.select(*group, F.col("pi").alias("i"), F.col("pj").alias("j"), "w")
