"""Graph traversal as rounds of joins: shortest paths, hop order, connectivity.

Edges are ``(graph, i, j, w)``: all graphs of a table advance together, and every round is one join
on the edge's start node and one map-side-combined minimum.  Rounds end when nothing improves; each
round's table is written to the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import cut, dealt, forget

#: Most arcs of a graph whose paths one task finds by itself, (source, node) pairs such a task returns, and distances it holds at once.
LOCAL_ARCS = 1 << 15
LOCAL_PAIRS = 1 << 21
LOCAL_HELD = 1 << 19


def _relax(known: DataFrame, edges: DataFrame, group: list[str], live: Column, carry: list[str]) -> DataFrame:
    """One relaxation: ``known(group, src, node, d, fresh)`` plus paths through live fresh nodes."""
    front = known.filter(F.col("fresh") & live).select(*group, "src", F.col("node").alias("i"), "d", *carry)
    reached = front.join(dealt(edges), [*group, "i"]).select(
        *group, "src", F.col("j").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("double").alias("old")
    )
    old = known.select(*group, "src", "node", "d", F.col("d").alias("old"))
    both = old.unionByName(reached)
    best = both.groupBy(*group, "src", "node").agg(F.min("d").alias("d"), F.min("old").alias("old"))
    return best.select(
        *group, "src", "node", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fresh")
    )


def bounded_distances(
    edges: DataFrame,
    sources: DataFrame,
    radius: float | None,
    group: list[str] | None = None,
) -> DataFrame:
    """Shortest distances ``(group, src, node, d)`` from every row of ``sources(group, src)``.

    Nodes within ``radius`` are expanded, so the first ring beyond the radius is part of the result;
    ``None`` means no bound.  The output, not the input, limits the cost: keep the radius local, or the graphs small.
    Graphs of up to ``LOCAL_ARCS`` edges are walked whole by tasks of their own, a block of sources in each; larger ones
    advance together by rounds of joins.
    """
    group = group or []
    by = group or ["_all"]
    edges = edges.select(*([] if group else [F.lit(0).alias("_all")]), *group, "i", "j", "w")
    sources = sources.select(*([] if group else [F.lit(0).alias("_all")]), *group, "src").distinct()
    for g in by:
        edges = edges.filter(F.col(g).isNotNull())  # such edges meet no source
    # weights that do not add up like numbers, and nodes without a name, are left to the joins
    odd = F.col("i").isNull() | F.col("j").isNull() | F.coalesce(F.isnan("w") | (F.abs("w") == float("inf")) | (F.col("w") < 0), F.lit(False))
    sizes = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_arcs"), F.max(odd).alias("_odd"))
    small = cut(sizes.filter((F.col("_arcs") <= LOCAL_ARCS) & ~F.col("_odd")).select(*by, "_arcs"))
    known = sources.filter(F.col("src").isNotNull())
    others = cut(sources.join(small, by, "left_anti").unionByName(sources.filter(F.col("src").isNull()).join(small, by, "left_semi")))
    parts = [cut(_walked(edges, known, radius, by, small))]
    if not others.isEmpty():
        parts.append(_by_rounds(edges.join(small, by, "left_anti"), others, radius, by))
    out = parts[0] if len(parts) == 1 else cut(parts[0].unionByName(parts[1]))
    forget(small, others, *(parts if len(parts) > 1 else []))
    path, out = out._cut_path, out.select(*group, "src", "node", "d")
    out._cut_path = path  # callers that are done with the distances may forget them
    return out


def _by_rounds(edges: DataFrame, sources: DataFrame, radius: float | None, group: list[str]) -> DataFrame:
    live = F.col("d").isNotNull() if radius is None else F.col("d") <= radius
    known = sources.select(*group, "src", F.col("src").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))
    while True:  # weights are not negative, so this ends
        last = known
        known = cut(_relax(known, edges, group, live, []))
        forget(last)
        if known.filter(F.col("fresh") & live).isEmpty():
            break
    out = known.select(*group, "src", "node", "d")
    out._cut_path = known._cut_path
    return out


def _walked(edges: DataFrame, sources: DataFrame, radius: float | None, group: list[str], small: DataFrame) -> DataFrame:
    """Distances within the graphs ``small(group, _arcs)``; a graph meets its sources in blocks of bounded results."""
    asked = sources.groupBy(*group).agg(F.count(F.lit(1)).alias("_asked")).join(small, group)
    blocks = cut(asked.select(*group, F.ceil(F.col("_asked") * (F.col("_arcs") + 1) / LOCAL_PAIRS).cast("long").alias("_blocks")))
    dealt_sources = sources.join(blocks, group).withColumn("_block", F.pmod(F.xxhash64("src"), F.col("_blocks"))).drop("_blocks")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    held = edges.join(blocks, group).withColumn("_block", copies)
    # fresh column identities, so that sources may come from the edges
    held = held.select(*[F.col(c).alias(c) for c in (*group, "_block", "i", "j")], F.col("w").cast("double").alias("w"))
    node = sources.select("src").unionByName(edges.select(F.col("j").alias("src"))).schema["src"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in sources.schema.fields}
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], f"src {kinds['src']}", f"node {node}", "d double"])

    def kernel(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({c: [] for c in [*group, "src", "node", "d"]})
        src, to, d = _paths(s["src"].to_numpy(), e["i"].to_numpy(), e["j"].to_numpy(), e["w"].to_numpy("float64", na_value=np.nan), radius)
        return pd.DataFrame({**{g: [s[g].iloc[0]] * len(src) for g in group}, "src": src, "node": to, "d": d})

    key = [*group, "_block"]
    return dealt_sources.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(kernel, schema)


def _paths(src: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, radius: float | None):
    """``src, node, d`` of one graph.  A node met over an edge without a weight has no distance unless another way gives one."""
    nodes, number = np.unique(np.concatenate([src, i, j]), return_inverse=True)
    at, i, j = np.split(number, [len(src), len(src) + len(i)])
    blank = np.isnan(w)
    bi, bj = i[blank], j[blank]
    # the n-th edges into all nodes are relaxed at once
    order = np.argsort(j[~blank], kind="stable")
    i, j, w = i[~blank][order], j[~blank][order], w[~blank][order]
    start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, int)
    nth = np.arange(len(j)) - np.repeat(start, np.diff(np.r_[start, len(j)]))
    slots = [np.flatnonzero(nth == k) for k in range(nth.max() + 1 if len(nth) else 0)]
    step = max(1, LOCAL_HELD // max(1, len(nodes)))
    out = []
    for first in range(0, len(src), step):
        own = at[first : first + step]
        d = np.full((len(nodes), len(own)), np.inf)
        d[own, np.arange(len(own))] = 0.0
        moved = np.zeros(len(nodes), bool)
        moved[own] = True
        while moved.any():
            turn, moved = moved, np.zeros(len(nodes), bool)
            for slot in slots:
                use = slot[turn[i[slot]] | moved[i[slot]]]
                if not len(use):
                    continue
                way = d[i[use]]
                if radius is not None:
                    way[way > radius] = np.inf
                way += w[use, None]
                old = d[j[use]]
                less = (way < old).any(1)
                if less.any():
                    d[j[use[less]]] = np.minimum(old[less], way[less])
                    moved[j[use[less]]] = True
        got = np.isfinite(d)
        if len(bi):
            open_ = got if radius is None else d <= radius
            unsure = np.zeros(d.shape, bool)
            np.logical_or.at(unsure, bj, open_[bi])
            unsure &= ~got
            d[unsure] = np.nan
            got |= unsure
        s, n = np.nonzero(got.T)
        out.append((src[first : first + step][s], nodes[n], d[n, s]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest_by_path(edges: DataFrame, sources: DataFrame, count: int, group: list[str] | None = None) -> DataFrame:
    """The ``count`` nearest nodes of every source by path length (itself included), ties by id.

    The predecessors of one of the nearest nodes are among the nearest too, so trimming every round
    to ``count`` rows per source loses nothing.  A node's outgoing edges are first reduced to its
    ``count`` cheapest: only those can lead to one of the ``count`` nearest.
    """
    group = group or []
    per_node = Window.partitionBy(*group, "i").orderBy("w", "j")
    fan = edges.filter(F.col("i") != F.col("j")).groupBy(*group, "i", "j").agg(F.min("w").alias("w"))
    fan = cut(fan.withColumn("_r", F.row_number().over(per_node)).filter(F.col("_r") <= count).drop("_r"))
    known = sources.select(*group, "src", F.col("src").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))
    per_src = Window.partitionBy(*group, "src").orderBy("d", "node")
    for _ in range(count):
        step = _relax(known, fan, group, F.lit(True), [])
        known = cut(step.withColumn("_r", F.row_number().over(per_src)).filter(F.col("_r") <= count).drop("_r"))
        if known.filter("fresh").isEmpty():
            break
    return known.select(*group, "src", "node", "d")


def gated_distances(
    edges: DataFrame,
    nodes: DataFrame,
    radius: float,
    at_least: int,
    min_cosine: float = -2.0,
    group: list[str] | None = None,
) -> DataFrame:
    """Local patch of every node ``(group, src, node, d)``: bounded walk with a normal test.

    ``nodes(group, node, nx, ny, nz)``.  The first ``at_least + 1`` nodes by distance always belong
    to the patch; later ones only if their normal agrees with the source's (cosine above
    ``min_cosine``).  A patch node is expanded while it lies within ``radius`` or is one of the first
    ``at_least``.  The ring just beyond the radius therefore belongs to the patch.
    """
    group = group or []
    sources = nodes.select(*group, F.col("node").alias("src"))
    first = nearest_by_path(edges, sources, at_least + 1, group)
    rank = F.row_number().over(Window.partitionBy(*group, "src").orderBy("d", "node"))
    first = cut(first.withColumn("_rank", rank))
    patch = first.select(
        *group,
        "src",
        "node",
        "d",
        ((F.col("d") <= radius) | (F.col("_rank") <= at_least)).alias("live"),
        F.lit(True).alias("sure"),
    )
    n = nodes.select(*group, "node", "nx", "ny", "nz")
    s = nodes.select(*group, F.col("node").alias("src"), *[F.col(f"n{k}").alias(f"s{k}") for k in "xyz"])
    cosine = sum((F.col(f"n{k}") * F.col(f"s{k}") for k in "xyz"), F.lit(0.0))
    gate = min_cosine > -1.0
    edges = edges.select(*group, "i", "j", "w")
    known = patch.withColumn("fresh", F.lit(True))
    key = [*group, "src", "node"]
    while True:
        front = known.filter("fresh and live").select(*group, "src", F.col("node").alias("i"), "d")
        step = front.join(dealt(edges), [*group, "i"]).groupBy(*group, "src", F.col("j").alias("node")).agg(
            F.min(F.col("d") + F.col("w")).alias("d")
        )
        if gate:
            sure = known.filter("sure").select(*key, "sure")
            step = step.join(sure, key, "left").join(dealt(n), [*group, "node"]).join(dealt(s), [*group, "src"])
            step = step.filter(F.coalesce("sure", F.lit(False)) | (cosine > min_cosine)).select(*key, "d")
        old = known.select(*key, "d", F.col("d").alias("old"), "sure", (F.col("live") & F.col("sure")).alias("keep"))
        new = step.select(
            *key, "d", F.lit(None).cast("double").alias("old"), F.lit(False).alias("sure"), F.lit(False).alias("keep")
        )
        best = old.unionByName(new).groupBy(*key).agg(
            F.min("d").alias("d"), F.min("old").alias("old"), F.max("sure").alias("sure"), F.max("keep").alias("keep")
        )
        known = cut(
            best.select(
                *key,
                "d",
                (F.col("keep") | (F.col("d") <= radius)).alias("live"),
                "sure",
                (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fresh"),
            )
        )
        if known.filter("fresh and live").isEmpty():
            return known.select(*key, "d")


def hop_neighbours(edges: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """The first ``k`` other nodes in breadth-first order: ``(group, src, slot, dst, w)``.

    Neighbours are visited in ascending id order.  A node's place in the order is the slot path that
    first reaches it, compared as ``(hops, path)``.  Slots then run by descending direct edge weight
    (0 without a direct edge), ties by breadth-first order.  Only the first ``2(k + 2)`` neighbours of
    a node can matter, because fewer than ``k + 2`` nodes are known before any expansion.
    """
    group = group or []
    loops = edges.filter(F.col("i") != F.col("j")).select(*group, "i", "j", "w")
    by_id = Window.partitionBy(*group, "i").orderBy("j")
    fan = loops.withColumn("_s", F.row_number().over(by_id)).filter(F.col("_s") <= 2 * (k + 2))
    fan = cut(fan.select(*group, "i", "j", "_s"))
    # isolated nodes must appear in ``edges`` as self loops to be sources
    src = edges.select(*group, F.col("i").alias("src")).distinct()
    none = F.array().cast("array<int>")
    known = src.select(*group, "src", F.col("src").alias("node"), none.alias("path"))
    order = Window.partitionBy(*group, "src").orderBy(F.size("path"), "path")
    for hop in range(k):
        front = known.filter(F.size("path") == hop).select(*group, "src", F.col("node").alias("i"), "path")
        step = front.join(dealt(fan), [*group, "i"]).select(
            *group, "src", F.col("j").alias("node"), F.array_append("path", F.col("_s")).alias("path")
        )
        first = F.min(F.struct(F.size("path").alias("n"), F.col("path").alias("p")))
        best = known.unionByName(step).groupBy(*group, "src", "node").agg(first.alias("_b"))
        ranked = best.select(*group, "src", "node", F.col("_b.p").alias("path"))
        ranked = ranked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).drop("_r")
        known = cut(ranked)
        if known.filter(F.size("path") == hop + 1).isEmpty():
            break
    got = known.filter(F.col("src") != F.col("node")).withColumn("_o", F.row_number().over(order))
    direct = loops.select(*group, F.col("i").alias("src"), F.col("j").alias("node"), "w")
    got = got.join(dealt(direct), [*group, "src", "node"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    by_weight = Window.partitionBy(*group, "src").orderBy(F.desc("w"), "_o")
    return got.select(*group, "src", F.row_number().over(by_weight).alias("slot"), F.col("node").alias("dst"), "w")


def components(edges: DataFrame, nodes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Connected components ``(group, node, root)`` with the smallest node id as root.

    Minimum labels jump along their own pointers each round, so even a long chain needs only a
    logarithmic number of rounds.  A round's table is deleted when the next one is written.
    """
    group = group or []
    sym = edges.select(*group, "i", "j").unionByName(edges.select(*group, F.col("j").alias("i"), F.col("i").alias("j")))
    sym = cut(sym.filter(F.col("i") != F.col("j")).distinct())
    label, written = nodes.select(*group, "node", F.col("node").alias("root")), None
    while True:
        near = sym.join(dealt(label.select(*group, F.col("node").alias("j"), "root")), [*group, "j"])
        low = near.groupBy(*group, F.col("i").alias("node")).agg(F.min("root").alias("low"))
        seen = label.join(dealt(low), [*group, "node"], "left").withColumn("low", F.least("root", F.coalesce("low", "root")))
        # the old root learns the lower label as well (hooking), then every pointer jumps once
        hook = seen.groupBy(*group, F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        seen = seen.join(dealt(hook), [*group, "node"], "left")
        new = seen.select(*group, "node", "root", F.least("low", F.coalesce("hook", "low")).alias("next"))
        jump = new.select(*group, F.col("node").alias("next"), F.col("next").alias("far"))
        new = cut(
            new.join(dealt(jump), [*group, "next"], "left").select(
                *group, "node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("was")
            )
        )
        if written is not None:
            forget(written)
        if new.filter(F.col("root") < F.col("was")).isEmpty():
            forget(sym)
            return new.select(*group, "node", "root")
        label, written = new.drop("was"), new


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    return components(edges, nodes).select("root").distinct().limit(2).count() <= 1


def distance_summary(distances: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per graph: half the largest and half the mean of the sources' largest distances, and the mean."""
    group = group or []
    per = distances.groupBy(*group, "src").agg(F.max("d").alias("_far"), F.sum("d").alias("_sum"), F.count("d").alias("_n"))
    return per.groupBy(*group).agg(
        (F.max("_far") / 2).alias("half_max"),
        (F.avg("_far") / 2).alias("half_mean_max"),
        (F.sum("_sum") / F.sum("_n")).alias("mean"),
    )
