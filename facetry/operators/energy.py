"""Labelling energies and their minimisation.

``data_cost(group, site, label, cost)`` (a missing row is infeasible), ``edges(group, i, j, w)`` with one
row per pair, a pairwise cost given as a column function ``V(a, b)``, optional
``label_cost(set_id, label, cost)``.  All problems of a table are solved together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.mincut import REGION_NODES, min_cut
from facetry.session import cut, dealt

Pairwise = Callable[[Column, Column], Column]

# The largest single energy term, the smoothing strength and the swap cycles of the vote smoother.
MAX_TERM = 1e10
VOTE_SMOOTHNESS = 0.001
VOTE_CYCLES = 2
#: Above any single term, so that a label without a cost row is never worth taking.
INFEASIBLE = 100 * MAX_TERM


def potts(strength: float = 1.0) -> Pairwise:
    return lambda a, b: F.when(a == b, 0.0).otherwise(float(strength))


def truncated_linear(limit: float, strength: float = 1.0) -> Pairwise:
    return lambda a, b: F.least(F.abs(a - b).cast("double"), F.lit(float(limit))) * strength


def table_cost(matrix: list[list[float]]) -> Pairwise:
    """Pairwise costs given as a square matrix over 0-based labels."""
    n = len(matrix)
    flat = [float(c) for row in matrix for c in row]
    return lambda a, b: F.element_at(F.array(*[F.lit(c) for c in flat]), (a * n + b + 1).cast("int"))


def single_edges(edges: DataFrame, group: list[str], multiplicity: float = 1.0) -> DataFrame:
    """One row per unordered pair; ``multiplicity=2`` counts a pair listed from both ends twice."""
    pair = edges.filter(F.col("i") != F.col("j")).select(
        *group, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w"
    )
    return pair.groupBy(*group, "i", "j").agg((F.max("w") * multiplicity).alias("w"))


def argmin_labels(data_cost: DataFrame, group: list[str]) -> DataFrame:
    """Cheapest label of every site by data cost alone; the lowest label wins a tie."""
    return data_cost.groupBy(*group, "site").agg(F.min_by("label", F.struct("cost", "label")).alias("label"))


def data_energy(labeling: DataFrame, data_cost: DataFrame, group: list[str]) -> DataFrame:
    """A site whose label has no cost row costs the infeasible amount."""
    rows = labeling.join(dealt(data_cost), [*group, "site", "label"], "left")
    return rows.groupBy(*group).agg(F.sum(F.coalesce("cost", F.lit(INFEASIBLE))).alias("data"))


def _pair_labels(labeling: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    a = labeling.select(*group, F.col("site").alias("i"), F.col("label").alias("li"))
    b = labeling.select(*group, F.col("site").alias("j"), F.col("label").alias("lj"))
    return edges.join(dealt(a), [*group, "i"]).join(dealt(b), [*group, "j"])


def smooth_energy(labeling: DataFrame, edges: DataFrame, pairwise: Pairwise, group: list[str]) -> DataFrame:
    rows = _pair_labels(labeling, edges, group)
    return rows.groupBy(*group).agg(F.sum(F.col("w") * pairwise(F.col("li"), F.col("lj"))).alias("smooth"))


def label_energy(labeling: DataFrame, label_cost: DataFrame, group: list[str]) -> DataFrame:
    """Each label set with at least one label in use is paid once."""
    used = labeling.select(*group, "label").distinct()
    sets = used.join(label_cost, "label").select(*group, "set_id", "cost").distinct()
    return sets.groupBy(*group).agg(F.sum("cost").alias("label_cost"))


def total_energy(labeling, data_cost, edges, pairwise: Pairwise, group: list[str], label_cost=None) -> DataFrame:
    """Per problem: data, smooth, label and total energy."""
    parts = [
        data_energy(labeling, data_cost, group).withColumnRenamed("data", "value").withColumn("part", F.lit("data")),
        smooth_energy(labeling, edges, pairwise, group).withColumnRenamed("smooth", "value").withColumn("part", F.lit("smooth")),
    ]
    if label_cost is not None:
        e = label_energy(labeling, label_cost, group)
        parts.append(e.withColumnRenamed("label_cost", "value").withColumn("part", F.lit("label")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = ["data", "smooth", "label"]
    picked = [F.coalesce(F.sum(F.when(F.col("part") == n, F.col("value"))), F.lit(0.0)).alias(f"{n}_energy") for n in names]
    return rows.groupBy(*group).agg(*picked, F.sum("value").alias("energy"))


def check_terms(data_cost: DataFrame, edges: DataFrame, pairwise: Pairwise, labels: list[int], limit: float = MAX_TERM, metric: bool = True) -> None:
    """Reject oversized terms and, for expansion moves, pairwise costs that are no metric.

    Only two maxima and a test over the short label list reach the driver.
    """
    spark = data_cost.sparkSession
    if data_cost.filter(F.abs("cost") > limit).limit(1).count():
        raise ValueError("data cost term larger than the allowed maximum")
    one = spark.createDataFrame([(x,) for x in labels], "a int").repartition("a")
    others = F.array(*[F.lit(int(x)) for x in labels])
    # pairs and triples of labels are made by the tasks, never listed on the driver
    t = one.select("a", F.explode(others).alias("b"))
    top = t.agg(F.max(F.abs(pairwise(F.col("a"), F.col("b"))))).first()[0]
    heaviest = edges.agg(F.max(F.abs("w"))).first()[0] or 0.0
    if top * heaviest > limit:
        raise ValueError("smooth cost term larger than the allowed maximum")
    v = lambda x, y: pairwise(F.col(x), F.col(y))
    t = t.select("a", "b", F.explode(others).alias("c"))
    if metric and t.filter(v("b", "c") + v("a", "a") > v("b", "a") + v("a", "c") + 1e-12).limit(1).count():
        raise ValueError("non-metric smooth cost: expansion moves need V(b,c) + V(a,a) <= V(b,a) + V(a,c)")


# ------------------------------------------------------------------ moves


def _cost_of(sites: DataFrame, data_cost: DataFrame, label: Column, out: str, group: list[str]) -> DataFrame:
    cost = data_cost.select(*group, "site", F.col("label").alias("_l"), F.col("cost").alias(out))
    rows = sites.withColumn("_l", label).join(dealt(cost), [*group, "site", "_l"], "left").drop("_l")
    return rows.withColumn(out, F.coalesce(F.col(out), F.lit(INFEASIBLE)))


def _solve(sites: DataFrame, pairs: DataFrame, group: list[str], region_nodes: int) -> DataFrame:
    """Binary problem: ``sites(site, c0, c1)``, ``pairs(i, j, e00, e01, e10, e11)`` -> ``(site, one)``."""
    e00, e01, e10, e11 = (F.col(c) for c in ("e00", "e01", "e10", "e11"))
    tilt = F.array(
        F.struct(F.col("i").alias("site"), (e10 - e00).alias("t")), F.struct(F.col("j").alias("site"), (e11 - e10).alias("t"))
    )
    own = sites.select(*group, "site", (F.col("c1") - F.col("c0")).alias("t"))
    theta = own.unionByName(pairs.select(*group, F.inline(tilt))).groupBy(*group, "site").agg(F.sum("t").alias("theta"))
    arcs = pairs.select(*group, "i", "j", (e01 + e10 - e00 - e11).alias("cij"), F.lit(0.0).alias("cji"))
    arcs = cut(arcs)
    if not arcs.filter(F.col("cij") < -1e-9).isEmpty():
        raise ValueError("pairwise costs are not submodular for this move: a minimum cut cannot represent them")
    side = min_cut(theta.withColumnRenamed("site", "node"), arcs.filter("cij > 0"), group, region_nodes)
    return side.select(*group, F.col("node").alias("site"), F.col("sink_side").alias("one"))


def swap_move(labeling, data_cost, edges, pairwise, group, alpha, beta, region_nodes=REGION_NODES) -> DataFrame:
    """Best exchange of ``alpha`` and ``beta`` among the sites that hold one of them."""
    a, b = F.lit(alpha), F.lit(beta)
    mine = labeling.filter(F.col("label").isin(alpha, beta)).select(*group, "site")
    rows = _pair_labels(labeling, edges, group)
    in_i, in_j = F.col("li").isin(alpha, beta), F.col("lj").isin(alpha, beta)
    w = F.col("w")
    # a neighbour with another label adds to the site's own cost
    outer_i = rows.filter(in_i & ~in_j).select(*group, F.col("i").alias("site"), (w * pairwise(a, F.col("lj"))).alias("c0"), (w * pairwise(b, F.col("lj"))).alias("c1"))
    outer_j = rows.filter(in_j & ~in_i).select(*group, F.col("j").alias("site"), (w * pairwise(F.col("li"), a)).alias("c0"), (w * pairwise(F.col("li"), b)).alias("c1"))
    base = _cost_of(_cost_of(mine, data_cost, a, "c0", group), data_cost, b, "c1", group)
    sites = base.unionByName(outer_i).unionByName(outer_j).groupBy(*group, "site").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    pairs = rows.filter(in_i & in_j).select(
        *group, "i", "j", (w * pairwise(a, a)).alias("e00"), (w * pairwise(a, b)).alias("e01"),
        (w * pairwise(b, a)).alias("e10"), (w * pairwise(b, b)).alias("e11"),
    )
    side = _solve(sites, pairs, group, region_nodes)
    new = labeling.join(dealt(side), [*group, "site"], "left")
    chosen = F.when(F.col("one"), b).when(~F.col("one"), a).otherwise(F.col("label"))
    return new.select(*group, "site", chosen.cast("int").alias("label"))


def expansion_move(labeling, data_cost, edges, pairwise, group, alpha, region_nodes=REGION_NODES, label_cost=None) -> DataFrame:
    """Best set of sites to switch to ``alpha``."""
    a, w, li, lj = F.lit(alpha), F.col("w"), F.col("li"), F.col("lj")
    sites = _cost_of(_cost_of(labeling, data_cost, a, "c0", group), data_cost, F.col("label"), "c1", group)
    pairs = _pair_labels(labeling, edges, group).select(
        *group, "i", "j", (w * pairwise(a, a)).alias("e00"), (w * pairwise(a, lj)).alias("e01"),
        (w * pairwise(li, a)).alias("e10"), (w * pairwise(li, lj)).alias("e11"),
    )
    sites = sites.select(*group, "site", "c0", "c1")
    if label_cost is not None:
        sites, pairs = _with_label_costs(labeling, label_cost, sites, pairs, group, alpha)
    side = _solve(sites, pairs, group, region_nodes)
    new = labeling.join(dealt(side), [*group, "site"])
    return new.select(*group, "site", F.when(F.col("one"), F.col("label")).otherwise(a).cast("int").alias("label"))


def _with_label_costs(labeling, label_cost, sites, pairs, group, alpha):
    """One auxiliary site per label set in use: its cost is saved only if every member switches.

    Sets that contain ``alpha`` stay paid whatever happens.  Auxiliary sites get negative ids, and one
    strong pair per member ties "some member kept" to "set still paid".
    """
    has_alpha = label_cost.filter(F.col("label") == alpha).select("set_id")
    others = label_cost.join(has_alpha, "set_id", "left_anti")
    member = labeling.join(others, "label").select(*group, "site", (-1 - F.col("set_id")).cast("long").alias("aux"), "cost")
    aux = member.select(*group, F.col("aux").alias("site"), "cost").distinct()
    sites = sites.unionByName(aux.select(*group, "site", F.lit(0.0).alias("c0"), F.col("cost").alias("c1")))
    tie = member.select(
        *group, F.col("aux").alias("i"), F.col("site").alias("j"), F.lit(0.0).alias("e00"), F.col("cost").alias("e01"),
        F.lit(0.0).alias("e10"), F.lit(0.0).alias("e11"),
    )
    return sites, pairs.unionByName(tie)


def _energy(labeling, data_cost, edges, pairwise, group, label_cost):
    e = total_energy(labeling, data_cost, edges, pairwise, group, label_cost)
    return e.select(*group, "energy")


def _keep_better(old, old_e, new, data_cost, edges, pairwise, group, label_cost):
    """Per problem, take the new labelling only where the energy dropped."""
    new_e = _energy(new, data_cost, edges, pairwise, group, label_cost).withColumnRenamed("energy", "_new")
    verdict = cut(old_e.join(new_e, group).withColumn("_better", F.col("_new") < F.col("energy") - 1e-9))
    both = old.join(dealt(new.withColumnRenamed("label", "_l")), [*group, "site"]).join(verdict.select(*group, "_better"), group)
    picked = cut(both.select(*group, "site", F.when(F.col("_better"), F.col("_l")).otherwise(F.col("label")).alias("label")))
    energy = verdict.select(*group, F.when(F.col("_better"), F.col("_new")).otherwise(F.col("energy")).alias("energy"))
    return picked, energy, not verdict.filter("_better").isEmpty()


def swap(data_cost, edges, pairwise, group, labels: Iterable[int], cycles: int = -1, start=None, region_nodes=REGION_NODES) -> DataFrame:
    """Alpha-beta swap over all label pairs, first label ascending, second descending, while the energy drops.

    ``labels`` is the short list of possible labels; ``start`` defaults to the first label everywhere.
    """
    labels = sorted(labels)
    if start is None:
        start = data_cost.select(*group, "site").distinct().withColumn("label", F.lit(labels[0]))
    current = cut(start.select(*group, "site", F.col("label").cast("int").alias("label")))
    energy = cut(_energy(current, data_cost, edges, pairwise, group, None))
    while cycles != 0:
        before = energy
        for x, alpha in enumerate(labels):
            for beta in reversed(labels[x + 1 :]):
                if current.filter(F.col("label").isin(alpha, beta)).isEmpty():
                    continue
                new = swap_move(current, data_cost, edges, pairwise, group, alpha, beta, region_nodes)
                current = cut(new)
        energy = cut(_energy(current, data_cost, edges, pairwise, group, None))
        dropped = energy.join(before.withColumnRenamed("energy", "_was"), group).filter(F.col("energy") < F.col("_was") - 1e-9)
        if dropped.isEmpty():
            break
        cycles -= 1
    return current


def expansion(data_cost, edges, pairwise, group, labels, cycles: int = -1, start=None, label_cost=None, region_nodes=REGION_NODES) -> DataFrame:
    """Alpha-expansion over all labels in ascending order, while the energy drops."""
    labels = sorted(labels)
    if start is None:
        start = data_cost.select(*group, "site").distinct().withColumn("label", F.lit(labels[0]))
    current = cut(start.select(*group, "site", F.col("label").cast("int").alias("label")))
    energy = cut(_energy(current, data_cost, edges, pairwise, group, label_cost))
    while cycles != 0:
        improved = False
        for alpha in labels:
            new = cut(expansion_move(current, data_cost, edges, pairwise, group, alpha, region_nodes, label_cost))
            current, energy, better = _keep_better(current, energy, new, data_cost, edges, pairwise, group, label_cost)
            improved = improved or better
        if not improved:
            break
        cycles -= 1
    return current


def cheapest_single_label(data_cost: DataFrame, group: list[str], label_cost: DataFrame | None = None) -> DataFrame:
    """The one label that costs least when used everywhere (infeasible labels excluded by their sum)."""
    n = data_cost.select(*group, "site").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    sums = data_cost.groupBy(*group, "label").agg(F.sum("cost").alias("_c"), F.count(F.lit(1)).alias("_k")).join(n, group)
    total = F.col("_c") + (F.col("_n") - F.col("_k")) * INFEASIBLE
    if label_cost is not None:
        extra = label_cost.groupBy("label").agg(F.sum("cost").alias("_x"))
        sums = sums.join(extra, "label", "left")
        total = total + F.coalesce("_x", F.lit(0.0))
    return sums.withColumn("_t", total).groupBy(*group).agg(F.min_by("label", F.struct("_t", "label")).alias("label"))


def greedy_labels(data_cost: DataFrame, label_cost: DataFrame, labels: Iterable[int] | None = None) -> tuple[list[int], float]:
    """Greedy choice of the labels in use for data plus label costs (no smoothing), one problem.

    Starts from the cheapest single label and adds the label that lowers the energy most, one
    aggregate over the data costs per round.  Only one number per label reaches the driver.
    """
    if labels is None:
        labels = [r.label for r in data_cost.select("label").distinct().collect()]
    labels = sorted(labels)
    n = data_cost.select("site").distinct().count()
    sets: dict[int, tuple[float, set[int]]] = {}
    for r in label_cost.groupBy("set_id").agg(F.max("cost").alias("cost"), F.collect_set("label").alias("labels")).collect():
        sets[r.set_id] = (r.cost, set(r.labels))

    def paid(chosen):
        return sum(c for c, members in sets.values() if members & chosen)

    chosen: set[int] = set()
    energy = float("inf")
    while True:
        if chosen:
            now = F.min(F.when(F.col("label").isin(sorted(chosen)), F.col("cost")))
            base = data_cost.groupBy("site").agg(F.coalesce(now, F.lit(INFEASIBLE)).alias("_now"))
            rows = data_cost.join(dealt(base), "site").withColumn("_gain", F.least(F.col("cost") - F.col("_now"), F.lit(0.0)))
            kept = base.agg(F.sum("_now")).first()[0]
            change = {r.label: r.g for r in rows.groupBy("label").agg(F.sum("_gain").alias("g")).collect()}
            options = {c: kept + change.get(c, 0.0) for c in labels if c not in chosen}
        else:
            sums = data_cost.groupBy("label").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("k")).collect()
            found = {r.label: r.c + (n - r.k) * INFEASIBLE for r in sums}
            options = {c: found.get(c, n * INFEASIBLE) for c in labels}
        scored = [(options[c] + paid(chosen | {c}), c) for c in options]
        if not scored:
            return sorted(chosen), energy
        best, label = min(scored)
        if best >= energy - 1e-12:
            return sorted(chosen), energy
        chosen.add(label)
        energy = best


def assign_chosen(data_cost: DataFrame, chosen: list[int], group: list[str]) -> DataFrame:
    return argmin_labels(data_cost.filter(F.col("label").isin(chosen)), group)


def smooth_votes(shares: DataFrame, areas: DataFrame, edges: DataFrame, labels: list[int], group: list[str], multiplicity: float = 2.0, strength: float = VOTE_SMOOTHNESS, cycles: int = VOTE_CYCLES, region_nodes: int = REGION_NODES) -> DataFrame:
    """Smooth voted labels over the face graph: costs from vote shares and areas, Potts edges, swaps.

    ``shares(group, site, label, share)``, ``areas(group, site, area)``, ``edges(group, i, j, w)``.
    """
    from facetry.functions.scalar import neg_log_cost

    cost = shares.join(dealt(areas), [*group, "site"]).withColumn("cost", neg_log_cost(F.col("share"), F.col("area")))
    # a site of zero area is infinitely expensive under every label, so it takes no side
    cost = cost.withColumn("cost", F.when(F.col("area") > 0, F.col("cost")).otherwise(0.0))
    cost = cut(cost.select(*group, "site", "label", "cost"))
    pairs = cut(single_edges(edges, group, multiplicity))
    return swap(cost, pairs, potts(strength), group, labels, cycles, region_nodes=region_nodes)
