"""Known labelings of a four-site, nine-label problem."""

import os

import pytest
from pyspark.sql import functions as F

from facetry.operators import energy

# Data costs by site, and the labelings they lead to (labels counted from 1).
PLAIN = [[1, 2, 5, 8, 4, 2, 3, 7, 9], [3, 1, 2, 5, 4, 5, 5, 5, 5], [5, 5, 5, 5, 4, 5, 2, 1, 3], [9, 7, 3, 2, 4, 8, 5, 2, 1]]
SMOOTH = [[1, 2, 5, 8, 4, 2, 3, 7, 9], [3, 1, 1, 5, 4, 5, 5, 5, 5], [5, 5, 5, 5, 4, 5, 1, 1, 3], [9, 7, 3, 2, 4, 8, 5, 2, 1]]
CHAIN = [(0, 1, 2.0), (1, 2, 1.0), (2, 3, 2.0)]


def problem(spark, costs):
    """Group 0 has no neighbours, group 1 is a chain."""
    rows = [(g, s, k + 1, float(c)) for g, m in enumerate(costs) for s, line in enumerate(m) for k, c in enumerate(line)]
    data = spark.createDataFrame(rows, "g int, site long, label int, cost double")
    edges = spark.createDataFrame([(1, *e) for e in CHAIN], "g int, i long, j long, w double")
    start = data.select("g", "site").distinct().withColumn("label", F.lit(5))
    return data, edges, start


def labels(out):
    return [[r.label for r in out.filter(F.col("g") == g).orderBy("site").collect()] for g in (0, 1)]


def test_single_expansion_moves(spark):
    data, edges, start = problem(spark, [PLAIN, SMOOTH])
    flat = energy.potts(0.0)
    a = energy.expansion_move(start, data, edges, flat, ["g"], 8)
    assert labels(a)[0] == [5, 5, 8, 8]


@pytest.mark.skipif("FACETRY_LONG" not in os.environ, reason="several minutes of small jobs; set FACETRY_LONG to run")
@pytest.mark.parametrize("method", ["expansion", "swap"])
def test_known_labelings(spark, method):
    costs, want = {
        "expansion": ([PLAIN, SMOOTH], [[1, 2, 8, 9], [2, 2, 8, 8]]),
        "swap": ([SMOOTH, SMOOTH], [[1, 2, 7, 9], [2, 2, 8, 8]]),
    }[method]
    data, edges, start = problem(spark, costs)
    out = getattr(energy, method)(data, edges, energy.truncated_linear(3.0), ["g"], range(1, 10), start=start)
    assert labels(out) == want
