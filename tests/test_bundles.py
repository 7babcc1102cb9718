"""Small cut problems share calls, and tables of sites meet by key instead of being broadcast."""

import random

from pyspark.sql import functions as F

from facetry.operators import energy, mincut
from facetry.session import cut


def _problem(spark, groups, size, seed):
    rng = random.Random(seed)
    sites = [(g, s, rng.uniform(-1, 1)) for g in range(groups) for s in range(size)]
    arcs = [(g, s, s + 1, rng.random(), rng.random()) for g in range(groups) for s in range(size - 1)]
    return (
        cut(spark.createDataFrame(sites, "g long, node long, theta double")),
        cut(spark.createDataFrame(arcs, "g long, i long, j long, cij double, cji double")),
    )


def test_bundles_do_not_change_cuts(spark, monkeypatch):
    terminals, arcs = _problem(spark, 12, 9, 1)
    found = []
    for bundle, region in ((1, 20_000), (1_000, 20_000), (7, 2), (1_000, 2)):
        monkeypatch.setattr(mincut, "BUNDLE_NODES", bundle)
        rows = mincut.min_cut(terminals, arcs, ["g"], region).collect()
        found.append(sorted((r.g, r.node, r.sink_side) for r in rows))
    assert len(found[0]) == 108 and all(f == found[0] for f in found)


def test_small_problems_share_a_call(spark, monkeypatch):
    terminals, arcs = _problem(spark, 40, 3, 2)
    seen = []
    real = mincut._run

    def spy(nodes, *rest):
        seen.append(nodes.select("bundle").distinct().count())
        return real(nodes, *rest)

    monkeypatch.setattr(mincut, "_run", spy)
    mincut.min_cut(terminals, arcs, ["g"]).collect()
    assert seen == [1]


def test_labels_are_not_broadcast(spark):
    labeling = cut(spark.range(50).select(F.lit(0).alias("g"), F.col("id").alias("site"), F.lit(1).alias("label")))
    links = cut(spark.range(49).select(F.lit(0).alias("g"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w")))
    cost = cut(labeling.withColumn("cost", F.lit(2.0)))
    for df in (energy.smooth_energy(labeling, links, energy.potts(), ["g"]), energy.data_energy(labeling, cost, ["g"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
