import random

from pyspark.sql import functions as F

from facetry.operators import boost


def examples(spark, n=200):
    """Three classes in disjoint intervals of x0; x1 is noise."""
    rnd = random.Random(0)
    rows = []
    for i in range(n):
        y = 1 + (i % 3)
        rows.append((i, y, [2.0 * y + rnd.uniform(0, 2) * 0.999, rnd.uniform(0, 1)], 1.0 / n))
    return spark.createDataFrame(rows, "id long, y int, x array<double>, weight double")


def test_separable_classes_are_learned_and_model_survives_a_round_trip(spark, tmp_path):
    data = examples(spark)
    model = boost.train(data, 3, rounds=5)
    table = boost.model_frame(spark, model)
    table.write.parquet(str(tmp_path / "model"))
    again = boost.model_from_frame(spark.read.parquet(str(tmp_path / "model")))
    assert [(m.f, m.th, m.s) for m in again] == [(m.f, m.th, m.s) for m in model]
    out = boost.predict(data, table)
    assert out.filter(F.col("yp") != F.col("y")).count() == 0
    total = out.select(F.aggregate("p", F.lit(0.0), lambda s, v: s + v).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert abs(total[0] - 1) < 1e-12 and abs(total[1] - 1) < 1e-12


def test_last_class_wins_ties(spark):
    h = spark.createDataFrame([([0.5, 0.5, 0.1],), ([0.1, 0.7, 0.7],)], "h array<double>")
    assert [r[0] for r in h.select(boost.predicted(F.col("h"))).collect()] == [2, 3]


def test_splitting_hot_features_changes_nothing(spark):
    state = boost.start(examples(spark, 90), 3)
    a, b = boost.search(state, 3), boost.search(state, 3, rows_per_cell=20)
    assert (a.f, a.th, a.s, round(a.err, 10)) == (b.f, b.th, b.s, round(b.err, 10))
