import itertools
import random

import pytest
from pyspark.sql import functions as F

from facetry.operators import energy, mincut


def brute_cut(thetas, arcs):
    """Smallest cut value over all assignments."""
    nodes = sorted(thetas)
    best = None
    for bits in itertools.product([0, 1], repeat=len(nodes)):
        x = dict(zip(nodes, bits))
        v = sum(max(t, 0) if x[n] else max(-t, 0) for n, t in thetas.items())
        v += sum(cij * (x[i] == 0 and x[j] == 1) + cji * (x[j] == 0 and x[i] == 1) for i, j, cij, cji in arcs)
        best = v if best is None else min(best, v)
    return best


def cut_value(thetas, arcs, x):
    v = sum(max(t, 0) if x[n] else max(-t, 0) for n, t in thetas.items())
    return v + sum(cij * (not x[i] and x[j]) + cji * (not x[j] and x[i]) for i, j, cij, cji in arcs)


@pytest.mark.parametrize("region_nodes", [1000, 3])
def test_min_cut_matches_brute_force(spark, region_nodes):
    rnd = random.Random(3)
    cases, nodes, arcs = {}, [], []
    for g in range(6):
        n = 11
        thetas = {k: round(rnd.uniform(-4, 4), 2) for k in range(n)}
        pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(18)}
        a = [(i, j, round(rnd.uniform(0, 3), 2), round(rnd.uniform(0, 3), 2)) for i, j in pairs]
        cases[g] = (thetas, a)
        nodes += [(g, k, t) for k, t in thetas.items()]
        arcs += [(g, *x) for x in a]
    t = spark.createDataFrame(nodes, "g int, node long, theta double")
    e = spark.createDataFrame(arcs, "g int, i long, j long, cij double, cji double")
    got = {}
    for r in mincut.min_cut(t, e, ["g"], region_nodes).collect():
        got.setdefault(r.g, {})[r.node] = r.sink_side
    for g, (thetas, a) in cases.items():
        assert cut_value(thetas, a, got[g]) == pytest.approx(brute_cut(thetas, a))


def test_hub_is_split_without_changing_the_cut(spark):
    rnd = random.Random(7)
    n = 13
    thetas = {k: round(rnd.uniform(-3, 3), 2) for k in range(n)}
    arcs = [(0, k, round(rnd.uniform(0, 1), 2), round(rnd.uniform(0, 1), 2)) for k in range(1, n)]
    t = spark.createDataFrame([(0, k, v) for k, v in thetas.items()], "g int, node long, theta double")
    e = spark.createDataFrame([(0, *a) for a in arcs], "g int, i long, j long, cij double, cji double")
    got = {r.node: r.sink_side for r in mincut.min_cut(t, e, ["g"], 5).collect()}
    assert set(got) == set(range(n))
    assert cut_value(thetas, arcs, got) == pytest.approx(brute_cut(thetas, arcs))


def costs(spark, matrix, g=0):
    rows = [(g, s, l, float(c)) for s, row in enumerate(matrix) for l, c in enumerate(row)]
    return spark.createDataFrame(rows, "g int, site long, label int, cost double")


def test_small_labelling_golden(spark):
    # fixed values: costs by label, chain weights, known optimum
    data = costs(spark, list(zip([0, 9, 2, 0], [3, 0, 3, 3], [5, 9, 0, 5])))
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 3, 2.0)], "g int, i long, j long, w double")
    pairwise = energy.table_cost([[0, 1, 2], [1, 0, 1], [2, 1, 0]])
    out = energy.expansion(data, edges, pairwise, ["g"], range(3))
    assert [r.label for r in out.orderBy("site").collect()] == [0, 1, 0, 0]
    e = energy.total_energy(out, data, edges, pairwise, ["g"]).first()
    assert (e.data_energy, e.smooth_energy, e.energy) == (2.0, 2.0, 4.0)


def test_swap_on_grid_never_beats_brute_force_and_reaches_two_label_optimum(spark):
    rnd = random.Random(1)
    h, w = 3, 4
    n = h * w
    matrix = [[round(rnd.uniform(0, 5), 2) for _ in range(2)] for _ in range(n)]
    pairs = [(i, i + 1) for i in range(n) if (i + 1) % w] + [(i, i + w) for i in range(n - w)]
    edges = [(0, i, j, round(rnd.uniform(0, 2), 2)) for i, j in pairs]
    best = min(
        sum(matrix[s][x] for s, x in enumerate(lab)) + sum(c * (lab[i] != lab[j]) for _, i, j, c in edges)
        for lab in itertools.product(range(2), repeat=n)
    )
    data = costs(spark, matrix)
    e = spark.createDataFrame(edges, "g int, i long, j long, w double")
    for region_nodes in (100,):
        out = energy.swap(data, e, energy.potts(), ["g"], range(2), region_nodes=region_nodes)
        got = energy.total_energy(out, data, e, energy.potts(), ["g"]).first().energy
        assert got == pytest.approx(best)


def test_label_costs_merge_labels(spark):
    # two labels are nearly equally good; paying for both is not worth it
    data = costs(spark, [[0.0, 0.4], [0.0, 0.4], [0.4, 0.0]])
    none = spark.createDataFrame([(0, 0, 1, 0.0)], "g int, i long, j long, w double")
    lc = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "set_id int, label int, cost double")
    start = data.select("g", "site").distinct().withColumn("label", F.when(F.col("site") == 2, 1).otherwise(0))
    out = energy.expansion(data, none, energy.potts(), ["g"], range(2), start=start, label_cost=lc)
    assert {r.label for r in out.collect()} == {0}
    chosen, value = energy.greedy_labels(data.drop("g"), lc, range(2))
    assert chosen == [0] and value == pytest.approx(1.4)


def test_greedy_labels_matches_exhaustive_on_easy_case(spark):
    matrix = [[0, 5, 5], [0, 5, 5], [5, 0, 5], [5, 0, 5], [5, 5, 1]]
    data = costs(spark, matrix).drop("g")
    lc = spark.createDataFrame([(k, k, 2.0) for k in range(3)], "set_id int, label int, cost double")
    chosen, value = energy.greedy_labels(data, lc, range(3))
    best = min(
        sum(min(row[c] for c in s) for row in matrix) + 2 * len(s)
        for k in range(1, 4)
        for s in itertools.combinations(range(3), k)
    )
    assert value == pytest.approx(best)


def test_terms_are_checked(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1.0)], "g int, i long, j long, w double")
    ok, big = costs(spark, [[0, 1], [1, 0]]), costs(spark, [[0, 2e7], [1, 0]])
    energy.check_terms(ok, edges, energy.potts(), [0, 1, 2])
    energy.check_terms(big, edges, energy.potts(), [0, 1, 2])
    with pytest.raises(ValueError, match="data cost"):
        energy.check_terms(big, edges, energy.potts(), [0, 1, 2], limit=1e7)
    with pytest.raises(ValueError, match="smooth cost term"):
        energy.check_terms(ok, edges, energy.potts(2e7), [0, 1, 2], limit=1e7)
    with pytest.raises(ValueError, match="non-metric"):
        energy.check_terms(ok, edges, energy.table_cost([[0, 1, 9], [1, 0, 1], [9, 1, 0]]), [0, 1, 2])
