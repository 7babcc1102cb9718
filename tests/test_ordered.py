import math
import random

import pytest
from pyspark.sql import functions as F

from facetry.operators import ordered, stats


@pytest.fixture(scope="module")
def rows():
    """One group holds most rows and one value holds a third of them."""
    rnd = random.Random(2)
    out = []
    for i in range(600):
        g = "hot" if rnd.random() < 0.8 else rnd.choice("abc")
        v = 5.0 if rnd.random() < 0.33 else round(rnd.uniform(-10, 10), 1)
        out.append((i, g, v, round(rnd.uniform(0.1, 2), 2)))
    return out


@pytest.mark.parametrize("cell", [50, 2_000_000])
def test_running_ranks_and_sums(spark, rows, cell):
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    got = ordered.running(df, ["g"], "v", "id", {"cw": F.col("w")}, rows_per_cell=cell)
    expected = {}
    for g in {r[1] for r in rows}:
        total = 0.0
        for pos, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            total += r[3]
            expected[r[0]] = (pos, total)
    assert {r.id: r.pos for r in got.collect()} == {k: p for k, (p, _) in expected.items()}
    assert all(math.isclose(r.cw, expected[r.id][1]) for r in got.collect())


def test_hot_value_is_split_into_cells(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    plan = ordered.running(df, [], "v", "id", rows_per_cell=50)._jdf.queryExecution().toString()
    assert "_sub" in plan and "_cell" in plan


@pytest.mark.parametrize("cell", [40, 2_000_000])
def test_order_statistics(spark, rows, cell):
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    by = {g: sorted(r for r in ((x[2], x[3]) for x in rows if x[1] == g)) for g in {r[1] for r in rows}}
    p = stats.floor_percentiles(df, ["g"], "v", {"p": 0.33}, rows_per_cell=cell)
    assert {r.g: r.p for r in p.collect()} == {g: s[math.floor(0.33 * len(s))][0] for g, s in by.items()}
    m = stats.medians(df, ["g"], "v", rows_per_cell=cell)
    mid = {g: (s[(len(s) - 1) // 2][0] + s[len(s) // 2][0]) / 2 for g, s in by.items()}
    assert {r.g: r.median for r in m.collect()} == pytest.approx(mid)
    wm = {}
    for g, s in by.items():
        half, run = sum(w for _, w in s) / 2, 0.0
        for v, w in s:
            run += w
            if run >= half:
                wm[g] = v
                break
    got = stats.weighted_medians(df, ["g"], "v", F.col("w"), rows_per_cell=cell)
    assert {r.g: r.weighted_median for r in got.collect()} == wm


def test_floor_percentile_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double").withColumn("g", F.lit(1))
    assert stats.floor_percentiles(df, ["g"], "v", {"p": 0.5}).first().p == 3.0


def test_winsorising_twice_changes_nothing(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    once = stats.winsorise_two_sided(df, ["g"], "v", 0.9, 0.1, "c")
    twice = stats.winsorise_two_sided(once.withColumn("v", F.col("c")), ["g"], "v", 0.9, 0.1, "c2")
    assert twice.filter("c <> c2").count() == 0


def test_eigenvalues_match_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    rows, want = [], []
    for _ in range(20):
        a = rnd.normal(size=(3, 3))
        m = a @ a.T
        rows.append((float(m[0, 0]), float(m[0, 1]), float(m[0, 2]), float(m[1, 1]), float(m[1, 2]), float(m[2, 2])))
        want.append(np.linalg.eigvalsh(m))
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    eig = stats.symmetric3_eigenvalues(*[F.col(n) for n in names])
    got = df.select("i", *[c.alias(f"e{k}") for k, c in enumerate(eig)]).orderBy("i").collect()
    for r, w in zip(got, want):
        assert [r.e0, r.e1, r.e2] == pytest.approx(list(w), abs=1e-9)
