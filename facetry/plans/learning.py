"""Queries for boosted stumps on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.operators import boost
from facetry.plans.registry import query

R, col = F.round, F.col
CLASSES = 3


def examples(t):
    """Labels folded to three classes; the embedding components, rounded, are the features."""
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    x = F.transform("embedding", lambda v: F.round(v.cast("double"), 2))
    return t.embeddings.select(
        col("vec_id").alias("id"), (col("label") % CLASSES + 1).alias("y"), x.alias("x"), (F.lit(1.0) / n).alias("weight")
    )


SUMS = """ex AS (SELECT vec_id, label % 3 + 1 AS y, unnest(range(len(embedding))) AS fid, unnest(embedding::DOUBLE[]) AS r,
              1.0::DOUBLE / (SELECT count(*) FROM embeddings) AS w FROM embeddings),
     pv AS (SELECT fid, round(r, 2) AS v, sum(w) AS w, sum(CASE WHEN y = 1 THEN w ELSE -w END) AS y0,
              sum(CASE WHEN y = 2 THEN w ELSE -w END) AS y1, sum(CASE WHEN y = 3 THEN w ELSE -w END) AS y2 FROM ex GROUP BY ALL),
     cu AS (SELECT fid, v, sum(w) OVER k AS cw, sum(y0) OVER k AS c0, sum(y1) OVER k AS c1, sum(y2) OVER k AS c2,
              sum(w) OVER f AS tw, sum(y0) OVER f AS t0, sum(y1) OVER f AS t1, sum(y2) OVER f AS t2 FROM pv
              WINDOW k AS (PARTITION BY fid ORDER BY v), f AS (PARTITION BY fid))"""
FIT = SUMS + """, su AS (SELECT *, n & 4 > 0 AS s0, n & 2 > 0 AS s1, n & 1 > 0 AS s2 FROM cu CROSS JOIN range(1, 8) r(n)),
     ag AS (SELECT *, (s0::INT + s1::INT + s2::INT) * cw AS wb, (s0::INT + s1::INT + s2::INT) * tw AS wt,
              s0::INT * c0 + s1::INT * c1 + s2::INT * c2 AS yb, s0::INT * t0 + s1::INT * t1 + s2::INT * t2 AS yt,
              (1 - s0::INT) * (tw - t0 * t0 / tw) + (1 - s1::INT) * (tw - t1 * t1 / tw) + (1 - s2::INT) * (tw - t2 * t2 / tw) AS third FROM su),
     fi AS (SELECT *, yb / wb AS b, CASE WHEN wt - wb > 1e-14 * wt THEN (yt - yb) / (wt - wb) ELSE 0 END AS a FROM ag),
     er AS (SELECT fid, v, n, a, b, tw, t0, t1, t2, s0, s1, s2,
              round(greatest(wt - wb, 0) * (1 - a * a) + wb * (1 - b * b) + third, 12) AS err FROM fi),
     bs AS (SELECT * FROM er QUALIFY row_number() OVER (ORDER BY err, n DESC, fid DESC, v) = 1)"""


@query(
    "stump_threshold_sums",
    f"""WITH {SUMS} SELECT fid::INT AS fid, v, round(cw, 8) AS cum_w, round(c0, 8) AS cum_y0, round(c1, 8) AS cum_y1, round(c2, 8) AS cum_y2 FROM cu""",
)
def stump_threshold_sums(t):
    state = boost.start(examples(t), CLASSES)
    s = boost.threshold_sums(state, CLASSES)
    return s.select("fid", "v", R("cum_w0", 8).alias("cum_w"), *[R(f"cum_y{c}", 8).alias(f"cum_y{c}") for c in range(3)])


@query("stump_best_threshold", f"WITH {FIT} SELECT fid::INT AS f, v AS th, round(a, 6) AS a, round(b, 6) AS b, round(err, 6) AS err FROM bs")
def stump_best_threshold(t):
    state = boost.start(examples(t), CLASSES)
    s = boost.search(state, CLASSES)
    row = [(s.f, s.th, s.a, s.b, s.err)]
    out = t.spark.createDataFrame(row, "f int, th double, a double, b double, err double")
    return out.select("f", "th", R("a", 6).alias("a"), R("b", 6).alias("b"), R("err", 6).alias("err"))


@query(
    "boost_weight_update",
    f"""WITH {FIT}, r AS (SELECT e.vec_id, e.label % 3 + 1 AS y, CASE WHEN round(embedding[(fid + 1)::INT]::DOUBLE, 2) > v THEN a ELSE b END AS sp,
             bs.* FROM embeddings e, bs),
        h AS (SELECT vec_id, y, CASE WHEN s0 THEN sp ELSE t0 / tw END AS h0, CASE WHEN s1 THEN sp ELSE t1 / tw END AS h1,
              CASE WHEN s2 THEN sp ELSE t2 / tw END AS h2 FROM r),
        w AS (SELECT vec_id, exp(CASE WHEN y = 1 THEN -h0 ELSE h0 END) AS w0, exp(CASE WHEN y = 2 THEN -h1 ELSE h1 END) AS w1,
              exp(CASE WHEN y = 3 THEN -h2 ELSE h2 END) AS w2 FROM h)
        SELECT vec_id AS id, round(w0 / sum(w0 + w1 + w2) OVER (), 9) AS w0, round(w1 / sum(w0 + w1 + w2) OVER (), 9) AS w1,
               round(w2 / sum(w0 + w1 + w2) OVER (), 9) AS w2 FROM w""",
)
def boost_weight_update(t):
    state = boost.start(examples(t), CLASSES)
    new = boost.update(state, boost.search(state, CLASSES))
    return new.select("id", *[R(col("w")[c], 9).alias(f"w{c}") for c in range(3)])


@query("boost_train")
def boost_train(t):
    """Three rounds on the whole table, then predictions for every row."""
    data = examples(t)
    model = boost.train(data, CLASSES, rounds=3)
    out = boost.predict(data, boost.model_frame(t.spark, model))
    return out.select("id", "y", "yp", R(col("p")[0], 6).alias("p1"))
