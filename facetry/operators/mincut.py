"""Exact minimum cuts of very many or very large graphs, distributed by regions.

Every graph is cut into regions of bounded size (a graph smaller than the bound is one region).  In a
sweep all regions work in parallel: each pushes its excess to the sink, or over its border to nearer
regions, in order of their distance to the sink counted in border crossings.  Crossing flows are then
merged; one that would break the distance order is handed back.  Before a sweep, distances are
recomputed exactly.  Sweeps end when no excess can reach the sink, which is the optimality condition.
(Published scheme: parallel region discharge with augmenting paths.)
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.ordered import running
from facetry.session import cut, dealt

REGION_NODES = 20_000
LOAD_PER_NODE = 8
#: Nodes that a call is given on average, in as many regions as that takes.
BUNDLE_NODES = 5_000
UNCUTTABLE = 1e15
FAR = 1 << 40
EPS = 1e-9


class _Region:
    """Residual network of one region; border arcs are exits with the far side's distance."""

    def __init__(self, kind, a, b, u, v, d):
        nodes, arcs = kind == 0, kind == 1
        self.ids = a[nodes]
        index = {n: k for k, n in enumerate(self.ids.tolist())}
        self.excess, self.sink = u[nodes].tolist(), v[nodes].tolist()
        self.head, self.room = [], []
        self.out = [[] for _ in self.ids]
        self.inner, self.exits = [], [[] for _ in self.ids]
        self.border = []
        for a, b, u, v, far in zip(*(x[arcs].tolist() for x in (a, b, u, v, d))):
            if b in index:
                i, j = index[a], index[b]
                self.inner.append((a, b, len(self.head)))
                for tail, head, room in ((i, j, u), (j, i, v)):
                    self.out[tail].append(len(self.head))
                    self.head.append(head)
                    self.room.append(room)
            else:
                self.exits[index[a]].append(len(self.border))
                self.border.append([a, b, u, far, 0.0])

    def _exit_room(self, k, stage):
        room = self.sink[k]
        for e in self.exits[k]:
            if self.border[e][3] < stage:
                room += self.border[e][2] - self.border[e][4]
        return room

    def levels(self, stage):
        """Steps to the nearest usable exit for every node, walking residual arcs backwards."""
        level = [-1] * len(self.ids)
        queue = deque(k for k in range(len(self.ids)) if self._exit_room(k, stage) > EPS)
        for k in queue:
            level[k] = 0
        while queue:
            k = queue.popleft()
            for arc in self.out[k]:
                other = self.head[arc]
                if level[other] < 0 and self.room[arc ^ 1] > EPS:
                    level[other] = level[k] + 1
                    queue.append(other)
        return level

    def _leave(self, k, amount, stage):
        """Send up to ``amount`` out of the region at node ``k``."""
        sent = min(amount, self.sink[k])
        self.sink[k] -= sent
        for e in self.exits[k]:
            edge = self.border[e]
            if sent < amount and edge[3] < stage:
                more = min(amount - sent, edge[2] - edge[4])
                edge[4] += more
                sent += more
        return sent

    def push(self, stage):
        """Maximum flow from all excess to the exits usable at ``stage`` (blocking flows by level)."""
        while True:
            level = self.levels(stage)
            sources = [k for k, more in enumerate(self.excess) if more > EPS and level[k] >= 0]
            if not sources:
                return
            cursor = [0] * len(self.ids)
            for s in sources:
                path, k = [], s
                while self.excess[s] > EPS:
                    if level[k] == 0:
                        room = min([self.excess[s], self._exit_room(k, stage), *[self.room[a] for a in path]])
                        if room > EPS:
                            sent = self._leave(k, room, stage)
                            self.excess[s] -= sent
                            for a in path:
                                self.room[a] -= sent
                                self.room[a ^ 1] += sent
                            path, k = [], s
                            continue
                        level[k] = -1
                    step = None
                    while level[k] > 0 and cursor[k] < len(self.out[k]):
                        a = self.out[k][cursor[k]]
                        if self.room[a] > EPS and level[self.head[a]] == level[k] - 1:
                            step = a
                            break
                        cursor[k] += 1
                    if step is not None:
                        path.append(step)
                        k = self.head[step]
                    elif path:
                        level[k] = -1
                        k = self.head[path.pop() ^ 1]
                    else:
                        break

    def distances(self):
        """Border crossings to the sink for every node, given the far side's distances."""
        best = np.full(len(self.ids), FAR)
        steps = sorted({0, *[b[3] + 1 for b in self.border if b[3] < FAR]})
        for stage in steps:
            for k, level in enumerate(self.levels(stage)):
                if level >= 0 and stage < best[k]:
                    best[k] = stage
        return best

    def discharge(self):
        for stage in sorted({0, *[b[3] + 1 for b in self.border if b[3] < FAR]}):
            if max(self.excess, default=0.0) > EPS:
                self.push(stage)


_COLS = ["kind", "a", "b", "u", "v", "d"]


def _node_rows(r: _Region, d) -> list[np.ndarray]:
    n = len(r.ids)
    return [np.zeros(n, np.int64), r.ids, np.full(n, -1), np.array(r.excess, float), np.array(r.sink, float), d]


def _run(nodes: DataFrame, arcs: DataFrame, group: list[str], work, tasks: int) -> DataFrame:
    """Hand every region its nodes and incident arcs and collect what ``work`` returns.

    Many small regions share a call, one after the other; ``bundle`` tells which.
    """
    n = nodes.select(
        *group, "region", "bundle", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(-1).cast("long").alias("b"),
        F.col("excess").alias("u"), F.col("sink").alias("v"), "d",
    )
    ends = nodes.select(*group, "node", "d", "bundle")
    here = arcs.join(dealt(ends.withColumnsRenamed({"node": "i", "d": "di", "bundle": "bi"})), [*group, "i"])
    here = here.join(dealt(ends.withColumnsRenamed({"node": "j", "d": "dj", "bundle": "bj"})), [*group, "j"])
    one = F.lit(1).alias("kind")
    side_i = here.select(
        *group, F.col("regi").alias("region"), F.col("bi").alias("bundle"), one, F.col("i").alias("a"), F.col("j").alias("b"),
        F.col("rij").alias("u"), F.col("rji").alias("v"), F.col("dj").alias("d"),
    )
    crossing = here.filter(F.col("regi") != F.col("regj"))
    side_j = crossing.select(
        *group, F.col("regj").alias("region"), F.col("bj").alias("bundle"), one, F.col("j").alias("a"), F.col("i").alias("b"),
        F.col("rji").alias("u"), F.col("rij").alias("v"), F.col("di").alias("d"),
    )
    rows = n.unionByName(side_i).unionByName(side_j)
    keys = [*group, "region", "bundle"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *_COLS])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        number = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        columns = [pdf[c].to_numpy()[order] for c in _COLS]
        done = [work(_Region(*(x[i:j] for x in columns))) for i, j in zip(first, [*first[1:], len(order)])]
        out = pdf[keys].iloc[np.repeat(order[first], [len(rows[0]) for rows in done])].reset_index(drop=True)
        return out.assign(**{c: np.concatenate([rows[k] for rows in done]) for k, c in enumerate(_COLS)})

    # rows are few and their work is long: partitions by number, which are not merged for their small size
    return cut(rows.repartition(tasks, "bundle").groupBy("bundle").applyInPandas(task, schema))


def _work_distance(r: _Region) -> list[np.ndarray]:
    return _node_rows(r, r.distances())


def _work_discharge(r: _Region) -> list[np.ndarray]:
    r.discharge()
    inner = [(1, a, b, r.room[k], r.room[k + 1], 0) for a, b, k in r.inner]
    border = [(2, a, b, flow, 0.0, 0) for a, b, _, _, flow in r.border]
    nodes = _node_rows(r, r.distances())
    arcs = zip(*inner, *border) if inner or border else [()] * len(_COLS)
    return [np.append(x, np.array(y, x.dtype)) for x, y in zip(nodes, arcs)]


def _relabel(nodes: DataFrame, arcs: DataFrame, group: list[str], crossing: bool, tasks: int) -> DataFrame:
    """Exact crossing distances, from far to near; one round when no arc crosses a border."""
    nodes = nodes.withColumn("d", F.lit(FAR).cast("long"))
    while True:
        new = _run(nodes, arcs, group, _work_distance, tasks).select(*group, F.col("a").alias("node"), F.col("d").alias("d2"))
        nodes = nodes.join(dealt(new), [*group, "node"])
        stable = not crossing or nodes.filter(F.col("d") != F.col("d2")).isEmpty()
        nodes = nodes.drop("d").withColumnRenamed("d2", "d")
        if stable:
            return cut(nodes)
        nodes = cut(nodes)


def min_cut(terminals: DataFrame, arcs: DataFrame, group: list[str], region_nodes: int = REGION_NODES) -> DataFrame:
    """``(group, node, sink_side)``: a minimum cut with the smallest possible sink side.

    ``terminals(group, node, theta)``: ``theta`` is the cost of being on the sink side (negative: on the
    source side).  ``arcs(group, i, j, cij, cji)``, one row per pair: ``cij`` is paid when ``i`` is on
    the source side and ``j`` on the sink side.
    """
    asked = terminals.select(*group, F.col("node").cast("long").alias("node"), "theta")
    arcs = arcs.select(*group, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cij", "cji")
    asked, arcs = _split_hubs(cut(asked), cut(arcs), group, region_nodes)
    where = cut(_regions(asked, arcs, group, LOAD_PER_NODE * region_nodes))
    bundles = max(1, -(-where.count() // BUNDLE_NODES))
    nodes = asked.join(dealt(where), [*group, "node"]).select(
        *group,
        "node",
        "region",
        F.pmod(F.xxhash64(*group, "region"), F.lit(bundles)).alias("bundle"),
        F.greatest(F.col("theta"), F.lit(0.0)).alias("excess"),
        F.greatest(-F.col("theta"), F.lit(0.0)).alias("sink"),
    )
    nodes = cut(nodes)
    arcs = arcs.join(dealt(where.withColumnsRenamed({"node": "i", "region": "regi"})), [*group, "i"])
    arcs = arcs.join(dealt(where.withColumnsRenamed({"node": "j", "region": "regj"})), [*group, "j"])
    arcs = cut(arcs.select(*group, "i", "j", "regi", "regj", F.col("cij").alias("rij"), F.col("cji").alias("rji")))
    tasks = min(bundles, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = _discharge_all(nodes, arcs, group, tasks)
    return sides.join(dealt(terminals.select(*group, F.col("node").cast("long").alias("node"))), [*group, "node"], "left_semi")


def _degrees(arcs: DataFrame, group: list[str]) -> DataFrame:
    ends = arcs.select(*group, F.explode(F.array("i", "j")).alias("node"))
    return ends.groupBy(*group, "node").agg(F.count(F.lit(1)).alias("deg"))


def _split_hubs(nodes: DataFrame, arcs: DataFrame, group: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Replace a node of very many arcs by a chain of copies that no cut can separate.

    The copies share the arcs, so the arcs of one node spread over several regions.
    """
    hubs = _degrees(arcs, group).filter(F.col("deg") > most).withColumn("_n", F.ceil(F.col("deg") / most))
    hubs = cut(hubs.select(*group, "node", "_n"))
    if hubs.isEmpty():
        return nodes, arcs
    copies = hubs.select(*group, "node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") - 1)).alias("copy"))
    copies = running(copies, group, "node", "copy", pos="_p")
    if group:
        copies = copies.join(nodes.groupBy(*group).agg(F.min("node").alias("_lo")), group)
    else:
        copies = copies.withColumn("_lo", nodes.agg(F.min("node")).scalar())
    copies = cut(copies.select(*group, "node", "copy", (F.col("_lo") - 1 - F.col("_p")).alias("new")))
    for end, other in (("i", "j"), ("j", "i")):
        arcs = arcs.join(hubs.withColumnRenamed("node", end), [*group, end], "left")
        arcs = arcs.withColumn("copy", F.pmod(F.xxhash64(other), F.col("_n"))).drop("_n")
        arcs = arcs.join(copies.withColumnRenamed("node", end), [*group, end, "copy"], "left")
        arcs = cut(arcs.withColumn(end, F.coalesce("new", end)).drop("new", "copy"))
    before = copies.select(*group, "node", (F.col("copy") + 1).alias("copy"), F.col("new").alias("_prev"))
    chain = copies.join(before, [*group, "node", "copy"], "left").select(
        *group, F.coalesce("_prev", "node").alias("i"), F.col("new").alias("j"),
        F.lit(UNCUTTABLE).alias("cij"), F.lit(UNCUTTABLE).alias("cji"),
    )
    more = copies.select(*group, F.col("new").alias("node"), F.lit(0.0).alias("theta"))
    return cut(nodes.unionByName(more)), cut(arcs.unionByName(chain))


def _regions(nodes: DataFrame, arcs: DataFrame, group: list[str], load: int) -> DataFrame:
    """``(group, node, region)``: runs of consecutive ids with at most about ``load`` nodes and arc ends.

    Neighbours tend to have close ids, so few arcs cross a border.
    """
    weight = nodes.select(*group, "node").join(dealt(_degrees(arcs, group)), [*group, "node"], "left")
    weight = weight.withColumn("_w", 1 + F.coalesce("deg", F.lit(0).cast("long")))
    ranked = running(weight, group, "node", "node", {"_cum": F.col("_w")}, pos="_p")
    return ranked.select(*group, "node", F.floor((F.col("_cum") - F.col("_w")) / load).alias("region"))


def _discharge_all(nodes: DataFrame, arcs: DataFrame, group: list[str], tasks: int) -> DataFrame:
    """Sweeps until no excess can reach the sink; ``(group, node, sink_side)``."""
    crossing = not arcs.filter(F.col("regi") != F.col("regj")).isEmpty()
    if not crossing:
        # no border anywhere: one discharge per region is a complete maximum flow
        done = _run(nodes.withColumn("d", F.lit(FAR).cast("long")), arcs, group, _work_discharge, tasks)
        flat = done.filter("kind = 0")
        return flat.select(*group, F.col("a").alias("node"), (F.col("d") < FAR).alias("sink_side"))
    while True:
        nodes = _relabel(nodes, arcs, group, crossing, tasks)
        if nodes.filter((F.col("excess") > EPS) & (F.col("d") < FAR)).isEmpty():
            return nodes.select(*group, "node", (F.col("d") < FAR).alias("sink_side"))
        done = _run(nodes, arcs, group, _work_discharge, tasks)
        fresh = done.filter("kind = 0").select(
            *group, F.col("a").alias("node"), "region", "bundle", F.col("u").alias("excess"), F.col("v").alias("sink"), "d"
        )
        inner = done.filter("kind = 1").select(
            *group, F.col("a").alias("i"), F.col("b").alias("j"), F.col("region").alias("regi"),
            F.col("region").alias("regj"), F.col("u").alias("rij"), F.col("v").alias("rji"),
        )
        sent = done.filter("kind = 2").select(*group, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("u").alias("_f"))
        label = fresh.select(*group, "node", "d")
        rim = arcs.filter(F.col("regi") != F.col("regj"))
        forth = sent.withColumnsRenamed({"_a": "i", "_b": "j", "_f": "fij"})
        back = sent.withColumnsRenamed({"_a": "j", "_b": "i", "_f": "fji"})
        rim = rim.join(dealt(forth), [*group, "i", "j"]).join(dealt(back), [*group, "i", "j"])
        rim = rim.join(dealt(label.withColumnsRenamed({"node": "i", "d": "di"})), [*group, "i"])
        rim = rim.join(dealt(label.withColumnsRenamed({"node": "j", "d": "dj"})), [*group, "j"])
        # a crossing flow is kept only if the arc it opens backwards respects the distance order
        keep_ij, keep_ji = F.col("dj") <= F.col("di") + 1, F.col("di") <= F.col("dj") + 1
        rim = cut(
            rim.withColumns(
                {
                    "gij": F.when(keep_ij, F.col("fij")).otherwise(0.0),
                    "gji": F.when(keep_ji, F.col("fji")).otherwise(0.0),
                }
            )
        )
        moved = rim.select(
            *group,
            F.inline(
                F.array(
                    F.struct(F.col("i").alias("node"), (F.col("gji") + F.col("fij") - F.col("gij")).alias("more")),
                    F.struct(F.col("j").alias("node"), (F.col("gij") + F.col("fji") - F.col("gji")).alias("more")),
                )
            ),
        )
        moved = moved.groupBy(*group, "node").agg(F.sum("more").alias("more"))
        nodes = fresh.join(dealt(moved), [*group, "node"], "left")
        nodes = cut(nodes.withColumn("excess", F.col("excess") + F.coalesce("more", F.lit(0.0))).drop("more"))
        rim = rim.select(
            *group, "i", "j", "regi", "regj",
            (F.col("rij") - F.col("gij") + F.col("gji")).alias("rij"),
            (F.col("rji") - F.col("gji") + F.col("gij")).alias("rji"),
        )
        arcs = cut(inner.unionByName(rim))
