"""Hard negatives against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import hard_negatives as hn
from facetry.llm import queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
LAST = (1, 0)


def brute(rows, every=5, positives=5, negatives=3):
    seen = []
    for vec_id, vector, label in dict.fromkeys((i, None if v is None else tuple(v), y) for i, v, y in rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        seen.append((vec_id, label, tuple(int(np.floor(256 * x)) for x in vector)))
    seen = list(dict.fromkeys(seen))
    out = []
    for anchor, label, q in seen:
        if anchor is None or anchor % every:
            continue
        others = [(-sum(a * b for a, b in zip(q, p)), LAST if i is None else (0, i), i, y) for i, y, p in seen if i != anchor and len(p) == len(q)]
        others.sort(key=lambda x: x[:2])
        for ps, _, pid, _ in [o for o in others if o[3] == label][:positives]:
            fits = [o for o in others if o[3] != label and 50 * -ps <= 100 * -o[0] <= 95 * -ps][:negatives]
            out += [(anchor, pid, k + 1, o[2], -ps, -o[0]) for k, o in enumerate(fits)]
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    return df.selectExpr("*", *[f"'x' as {c}" for c in ("id", "q", "mark", "anchor", "block", "stripe", "kind", "score", "tops", "rank")])


def found(df, every=5, **options):
    out = hn.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def make(seed, n, labels=3, spread=0.5):
    rng = np.random.default_rng(seed)
    common = rng.standard_normal(6)
    rows = [(i, (common + spread * rng.standard_normal(6)).tolist(), int(rng.integers(labels))) for i in range(n)]
    for i in range(0, n, 7):  # ties: equal vectors under other ids and labels
        rows.append((n + i, rows[i][1], int(rng.integers(labels))))
    rows += [(1000, None, 1), (1005, [1.0, None], 1), (1010, [float("nan")] * 6, 1), (1015, [float("inf")] * 6, 0), (1020, rows[0][1], None)]
    rows += [rows[3], rows[3], rows[5]]  # repeated rows
    rows += [(5, rows[8][1], 0), (None, rows[2][1], 0), (None, rows[2][1], 1), (25, [1.0, 2.0], 0), (26, [1.0, 2.0], 0), (27, [0.8, 1.0], 1)]
    return rows


@pytest.mark.parametrize("anchors, pairs", [(4096, 1 << 21), (3, 64)])
def test_against_brute_force(spark, monkeypatch, anchors, pairs):
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "PAIRS", pairs)
    rows = make(1, 90)
    want = brute(rows)
    assert len(want) > 100
    assert found(frame(spark, rows)) == want


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, [0.0, 2.0], 1), (6, [0.0, 0.0], 1)]
    assert found(frame(spark, rows)) == brute(rows)
    empty = [(0, [], 0), (1, [], 0), (2, [], 1)]
    assert found(frame(spark, empty)) == brute(empty) == [(0, 1, 1, 2, 0, 0)]


def test_huge_components_are_exact(spark):
    rows = [(i, [float(2**19 + i), float(2**17 * (i % 3)), 3.0], i % 2) for i in range(20)]
    assert found(frame(spark, rows)) == brute(rows)
    a = np.array([[2**40, 1]])
    assert hn.products(a, a)[0, 0] == 9 * 10**16


def test_no_rows_no_anchors(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, [1.0], 0), (2, [1.0], 1), (None, [1.0], 1)])) == []


def test_query_equals_sql(spark):
    import check_oracle

    folder = "/root/testdata/sf0.01"
    ok, note = check_oracle.compare(spark, check_oracle.connect(folder), folder, queries.QUERIES["op13_hard_negatives"], hn.ORACLE_SQL)
    assert ok, note
