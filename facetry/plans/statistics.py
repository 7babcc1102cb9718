"""Queries for statistics, order statistics, scalar shaping, votes and set lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import scalar as S
from facetry.operators import ordered, stats, votes
from facetry.plans.registry import query

R = F.round
#: Cells of so few rows let small tables take the way that large ones need.
SMALL_CELL = 100
col = F.col

# ---------------------------------------------------------------- votes

@query(
    "majority_vote",
    """WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
       SELECT user_id, votes, event_type AS vote FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS rn FROM c)
       WHERE rn = 1""",
)
def majority_vote(t):
    return votes.majority(t.events, ["user_id"], "event_type")


@query(
    "vote_share_zero_filled",
    """WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT DISTINCT event_type FROM events),
            c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
       SELECT u.user_id, k.event_type, coalesce(c.votes, 0) AS votes,
              round(coalesce(c.votes, 0) / 7.0, 6) AS share
       FROM u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = k.event_type""",
)
def vote_share_zero_filled(t):
    out = votes.vote_shares(t.events, ["user_id"], "event_type")
    return out.withColumn("share", R("share", 6))


@query(
    "masked_vote",
    """WITH e AS (SELECT user_id, event_type FROM events
                  WHERE substr('0011001', CAST(hour(ts) % 7 + 1 AS INT), 1) = '1'),
            c AS (SELECT user_id, event_type, count(*) AS votes FROM e GROUP BY ALL)
       SELECT user_id, votes, event_type AS vote FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS rn FROM c)
       WHERE rn = 1""",
)
def masked_vote(t):
    voter = F.hour("ts") % 7 + 1
    enabled = t.events.filter(S.mask_bit(F.lit("0011001"), voter))
    return votes.majority(enabled, ["user_id"], "event_type")


@query(
    "vote_coverage",
    """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
            f AS (SELECT user_id, max(n) AS expected FROM n GROUP BY ALL)
       SELECT n.user_id, event_type, n, expected, n = expected AS complete FROM n JOIN f USING (user_id)""",
)
def vote_coverage(t):
    return votes.coverage(t.events, ["user_id"], "event_type")


@query(
    "weighted_accuracy",
    """SELECT lang, sum(CASE WHEN quality = 1 - toxic THEN n_chars ELSE 0 END)::DOUBLE AS correct_area,
              round(sum(CASE WHEN quality = 1 - toxic THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS accuracy
       FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
)
def weighted_accuracy(t):
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    area, pred = col("n_chars").cast("double"), 1 - col("toxic")
    return d.groupBy("lang").agg(
        votes.weighted_accuracy(pred, col("quality"), area).alias("correct_area"),
        R(votes.weighted_accuracy(pred, col("quality"), area, normalise=True), 6).alias("accuracy"),
    )


@query(
    "macro_average_levels",
    """WITH o AS (SELECT r_regionkey, n_nationkey, c_custkey, avg(o_totalprice) AS v
                  FROM orders JOIN customer ON o_custkey = c_custkey
                  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
                  GROUP BY ALL),
            n AS (SELECT r_regionkey, n_nationkey, avg(v) AS v FROM o GROUP BY ALL),
            r AS (SELECT r_regionkey, avg(v) AS v FROM n GROUP BY ALL)
       SELECT round(avg(v), 4) AS o_totalprice FROM r""",
)
def macro_average_levels(t):
    o = (
        t.orders.select("o_custkey", "o_totalprice")
        .join(t.customer.select("c_custkey", "c_nationkey"), col("o_custkey") == col("c_custkey"))
        .join(t.nation, col("c_nationkey") == col("n_nationkey"))
        .join(t.region, col("n_regionkey") == col("r_regionkey"))
    )
    out = votes.macro_average(o, ["r_regionkey", "n_nationkey", "c_custkey"], "o_totalprice")
    return out.select(R("o_totalprice", 4).alias("o_totalprice"))


# ---------------------------------------------------------------- grouped statistics


@query(
    "weighted_mean",
    """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wmean
       FROM lineitem GROUP BY ALL""",
)
def weighted_mean(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        R(stats.weighted_mean(col("l_discount"), col("l_quantity")), 6).alias("wmean")
    )


@query(
    "power_means",
    """SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean,
              round(avg(l_quantity * l_quantity), 4) AS mean2,
              round(avg(l_quantity * l_quantity * l_quantity * l_quantity), 2) AS mean4,
              round(avg(sqrt(l_quantity)), 6) AS meansqrt, round(avg(sqrt(sqrt(l_quantity))), 6) AS meansqrtsqrt
       FROM lineitem GROUP BY ALL""",
)
def power_means(t):
    p = stats.power_mean_columns(col("l_quantity"))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"),
        R(F.avg("l_quantity"), 6).alias("mean"),
        *[R(p[n], d).alias(n) for n, d in [("mean2", 4), ("mean4", 2), ("meansqrt", 6), ("meansqrtsqrt", 6)]],
    )


@query(
    "central_moments",
    """WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mu FROM lineitem GROUP BY ALL),
            c AS (SELECT l_returnflag, l_linestatus, any_value(mu) AS mu, avg((l_quantity - mu)^2) AS m2,
                         avg((l_quantity - mu)^3) AS m3, avg((l_quantity - mu)^4) AS m4
                  FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, round(mu, 6) AS mean, round(m2, 5) AS variance,
              round(m3 / (sqrt(m2 * m2 * m2) + 1e-30), 6) AS skewness,
              round(m4 / (m2 * m2 + 1e-30), 6) AS kurtosis FROM c""",
)
def central_moments(t):
    out = stats.central_moments(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select(
        "l_returnflag",
        "l_linestatus",
        R("mean", 6).alias("mean"),
        R("variance", 5).alias("variance"),
        R("skewness", 6).alias("skewness"),
        R("kurtosis", 6).alias("kurtosis"),
    )


@query(
    "weighted_moments",
    """WITH m AS (SELECT l_returnflag, sum(l_quantity * l_discount) / sum(l_quantity) AS mu
                  FROM lineitem GROUP BY ALL),
            c AS (SELECT l_returnflag, any_value(mu) AS mu,
                         sum((l_discount - mu)^2 * l_quantity) / sum(l_quantity) AS m2,
                         sum((l_discount - mu)^3 * l_quantity) / sum(l_quantity) AS m3,
                         sum((l_discount - mu)^4 * l_quantity) / sum(l_quantity) AS m4
                  FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL)
       SELECT l_returnflag, round(mu, 6) AS mean, round(m2, 8) AS variance,
              round(m3 / (sqrt(m2 * m2 * m2) + 1e-30), 6) AS skewness,
              round(m4 / (m2 * m2 + 1e-30), 6) AS kurtosis FROM c""",
)
def weighted_moments(t):
    out = stats.central_moments(t.lineitem, ["l_returnflag"], "l_discount", "l_quantity")
    digits = {"mean": 6, "variance": 8, "skewness": 6, "kurtosis": 6}
    return out.select("l_returnflag", *[R(c, d).alias(c) for c, d in digits.items()])


@query(
    "weighted_power_means",
    """SELECT l_returnflag,
              round(sum(l_quantity * l_tax) / sum(l_tax), 6) AS p1,
              round(sum(l_quantity^2 * l_tax) / sum(l_tax), 4) AS p2,
              round(sum(l_quantity^4 * l_tax) / sum(l_tax), 2) AS p4,
              round(sum(l_quantity^8 * l_tax) / sum(l_tax) / 1e9, 4) AS p8,
              round(sum(l_quantity^0.5 * l_tax) / sum(l_tax), 6) AS p_half,
              round(sum(l_quantity^0.25 * l_tax) / sum(l_tax), 6) AS p_quarter
       FROM lineitem GROUP BY ALL""",
)
def weighted_power_means(t):
    def m(p):
        return stats.weighted_power_mean(col("l_quantity"), col("l_tax"), p)

    return t.lineitem.groupBy("l_returnflag").agg(
        R(m(1.0), 6).alias("p1"),
        R(m(2.0), 4).alias("p2"),
        R(m(4.0), 2).alias("p4"),
        R(m(8.0) / 1e9, 4).alias("p8"),
        R(m(0.5), 6).alias("p_half"),
        R(m(0.25), 6).alias("p_quarter"),
    )


@query(
    "median_by_group",
    "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY ALL",
)
def median_by_group(t):
    out = stats.medians(t.orders, ["o_orderpriority"], "o_totalprice")
    return out.withColumn("median", R("median", 4))


@query(
    "floor_percentile",
    """WITH r AS (SELECT p_brand, p_retailprice,
                         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS rn,
                         count(*) OVER (PARTITION BY p_brand) AS n FROM part)
       SELECT p_brand, max(CASE WHEN rn = floor(0.25 * n) THEN p_retailprice END) AS p25,
              max(CASE WHEN rn = floor(0.5 * n) THEN p_retailprice END) AS p50,
              max(CASE WHEN rn = floor(0.95 * n) THEN p_retailprice END) AS p95
       FROM r GROUP BY ALL""",
)
def floor_percentile(t):
    return stats.floor_percentiles(
        t.part, ["p_brand"], "p_retailprice", {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    )


@query(
    "weighted_median",
    """WITH d AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
            r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS cw,
                         sum(w) OVER (PARTITION BY l_suppkey) AS tw FROM d)
       SELECT l_suppkey, min(v) AS weighted_median FROM r WHERE cw / tw >= 0.5 GROUP BY ALL""",
)
def weighted_median(t):
    return stats.weighted_medians(t.lineitem, ["l_suppkey"], "l_extendedprice", col("l_quantity"))


@query(
    "winsorise_two_sided",
    """WITH r AS (SELECT c_nationkey, c_acctbal,
                         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS rn,
                         count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
            c AS (SELECT c_nationkey, max(CASE WHEN rn = floor(0.95 * n) THEN c_acctbal END) AS hi,
                         max(CASE WHEN rn = floor((1 - 0.95) * n) THEN c_acctbal END) AS lo
                  FROM r GROUP BY ALL)
       SELECT c_custkey, greatest(least(c_acctbal, hi), lo) AS clamped
       FROM customer JOIN c USING (c_nationkey)""",
)
def winsorise_two_sided(t):
    df = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    out = stats.winsorise_two_sided(df, ["c_nationkey"], "c_acctbal", 0.95, 1 - 0.95, "clamped")
    return out.select("c_custkey", "clamped")


@query(
    "winsorise_asymmetric",
    """WITH r AS (SELECT c_nationkey, c_acctbal,
                         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS rn,
                         count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
            c AS (SELECT c_nationkey, max(CASE WHEN rn = floor(0.9 * n) THEN c_acctbal END) AS hi,
                         max(CASE WHEN rn = floor(0.25 * n) THEN c_acctbal END) AS lo
                  FROM r GROUP BY ALL)
       SELECT c_custkey, greatest(least(c_acctbal, hi), lo) AS clamped
       FROM customer JOIN c USING (c_nationkey)""",
)
def winsorise_asymmetric(t):
    df = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    out = stats.winsorise_two_sided(df, ["c_nationkey"], "c_acctbal", 0.9, 0.25, "clamped")
    return out.select("c_custkey", "clamped")


@query(
    "winsorise_signed",
    """WITH r AS (SELECT c_nationkey, abs(c_acctbal - 4500) AS m,
                         row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal - 4500)) - 1 AS rn,
                         count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
            c AS (SELECT c_nationkey, max(CASE WHEN rn = floor(0.8 * n) THEN m END) AS t FROM r GROUP BY ALL)
       SELECT c_custkey, round(CASE WHEN abs(c_acctbal - 4500) < t THEN c_acctbal - 4500
                         WHEN c_acctbal - 4500 < 0 THEN -t ELSE t END, 6) AS clamped
       FROM customer JOIN c USING (c_nationkey)""",
)
def winsorise_signed(t):
    df = t.customer.select("c_custkey", "c_nationkey", (col("c_acctbal") - 4500).alias("v"))
    out = stats.winsorise_signed(df, ["c_nationkey"], "v", 0.8, "clamped")
    return out.select("c_custkey", R("clamped", 6).alias("clamped"))


@query(
    "rebase_min",
    """SELECT s_suppkey, round(s_acctbal - min(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS rebased
       FROM supplier""",
)
def rebase_min(t):
    out = stats.rebase(t.supplier, ["s_nationkey"], "s_acctbal", "rebased")
    return out.select("s_suppkey", R("rebased", 6).alias("rebased"))


@query(
    "max_normalise",
    """SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand), 6) AS scaled
       FROM part""",
)
def max_normalise(t):
    out = stats.scale_to_max(t.part, ["p_brand"], "p_retailprice", "scaled")
    return out.select("p_partkey", R("scaled", 6).alias("scaled"))


@query(
    "weighted_quantile_crossings",
    """WITH d AS (SELECT l_partkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
            r AS (SELECT *, sum(w) OVER (PARTITION BY l_partkey ORDER BY v)
                            / sum(w) OVER (PARTITION BY l_partkey) AS s FROM d)
       SELECT l_partkey, min(CASE WHEN s >= 0.1 THEN v END) AS q1, min(CASE WHEN s >= 0.2 THEN v END) AS q2,
              min(CASE WHEN s >= 0.3 THEN v END) AS q3, min(CASE WHEN s >= 0.4 THEN v END) AS q4,
              min(CASE WHEN s >= 0.5 THEN v END) AS q5 FROM r GROUP BY ALL""",
)
def weighted_quantile_crossings(t):
    shares = {"q1": 0.1, "q2": 0.2, "q3": 0.3, "q4": 0.4, "q5": 0.5}
    return stats.quantile_crossings(t.lineitem, ["l_partkey"], "l_extendedprice", col("l_quantity"), shares)


@query(
    "cumulative_tie_groups",
    """SELECT DISTINCT p_brand, p_size, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS cum_n,
              round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size), 4) AS cum_price
       FROM part""",
)
def cumulative_tie_groups(t):
    cum = ordered.cumulate(
        t.part, ["p_brand"], "p_size", {"n": F.lit(1).cast("long"), "price": col("p_retailprice")}, rows_per_cell=SMALL_CELL
    )
    return cum.select(
        "p_brand", col("p_size").cast("int").alias("p_size"), "cum_n", R("cum_price", 4).alias("cum_price")
    )


@query(
    "distinct_first_seen",
    "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY ALL",
)
def distinct_first_seen(t):
    return stats.distinct_first_seen(t.events, "event_type", "event_id")


@query(
    "cumulative_weight",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS pos,
              round(sum(value) OVER (PARTITION BY user_id ORDER BY value, event_id
                                     ROWS UNBOUNDED PRECEDING), 4) AS cum_value FROM events""",
)
def cumulative_weight(t):
    out = ordered.running(
        t.events.select("event_id", "user_id", "value"),
        ["user_id"],
        "value",
        "event_id",
        {"cum_value": col("value")},
        rows_per_cell=SMALL_CELL,
    )
    return out.select("event_id", "pos", R("cum_value", 4).alias("cum_value"))


@query(
    "argsort",
    """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer""",
)
def argsort(t):
    out = ordered.running(t.customer.select("c_custkey", "c_acctbal"), [], "c_acctbal", "c_custkey", rows_per_cell=SMALL_CELL)
    return out.select("c_custkey", "pos")


@query(
    "reductions",
    """SELECT l_linestatus, round(sum(l_discount - 0.05), 6) AS r_sum,
              round(sum(abs(l_discount - 0.05)), 5) AS r_asum,
              round(sum((l_discount - 0.05) * (l_discount - 0.05)), 6) AS r_sumsq,
              round(avg(l_discount - 0.05), 6) AS r_mean,
              max(greatest(l_quantity, l_linenumber)) AS e_max,
              round(sum(l_quantity * l_tax), 4) AS e_prod, round(sum(l_quantity + l_tax), 4) AS e_sum
       FROM lineitem GROUP BY ALL""",
)
def reductions(t):
    v = col("l_discount") - 0.05
    return t.lineitem.groupBy("l_linestatus").agg(
        R(F.sum(v), 6).alias("r_sum"),
        R(F.sum(F.abs(v)), 5).alias("r_asum"),
        R(F.sum(v * v), 6).alias("r_sumsq"),
        R(F.avg(v), 6).alias("r_mean"),
        F.max(F.greatest(col("l_quantity"), col("l_linenumber"))).alias("e_max"),
        R(F.sum(col("l_quantity") * col("l_tax")), 4).alias("e_prod"),
        R(F.sum(col("l_quantity") + col("l_tax")), 4).alias("e_sum"),
    )


# ---------------------------------------------------------------- lookups, set membership, re-indexing


@query(
    "split_semi_join",
    """SELECT l_orderkey, count(*) AS n_lines FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL""",
)
def split_semi_join(t):
    chosen = t.orders.filter(col("o_orderpriority") == "1-URGENT").select(col("o_orderkey").alias("l_orderkey"))
    kept = t.lineitem.select("l_orderkey").join(chosen, "l_orderkey", "left_semi")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "prerequisite_semi_join",
    """SELECT p_partkey, p_brand FROM part
       WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')
         AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A')""",
)
def prerequisite_semi_join(t):
    has = t.lineitem.select(col("l_partkey").alias("p_partkey"), "l_returnflag")
    parts = t.part.select("p_partkey", "p_brand")
    for flag in ("R", "A"):
        parts = parts.join(has.filter(col("l_returnflag") == flag), "p_partkey", "left_semi")
    return parts


@query(
    "unused_anti_join",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def unused_anti_join(t):
    used = t.orders.select(col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(used, "c_custkey", "left_anti")


@query(
    "dense_reindex",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS new_id
       FROM part WHERE p_size <= 25""",
)
def dense_reindex(t):
    kept = t.part.filter(col("p_size") <= 25).select("p_partkey")
    return ordered.running(kept, [], "p_partkey", "p_partkey", pos="new_id")


@query(
    "combinations",
    """WITH k AS (SELECT DISTINCT event_type FROM events)
       SELECT a.event_type AS first, b.event_type AS second FROM k a JOIN k b ON a.event_type < b.event_type""",
)
def combinations(t):
    from facetry.operators.project import column_combinations

    kinds = t.events.select("event_type").distinct()
    return column_combinations(kinds, "event_type", 2).select(
        col("items")[0].alias("first"), col("items")[1].alias("second")
    )


@query(
    "train_valid_split",
    """SELECT doc_id, max(CASE WHEN doc_id % 97 = 90 THEN 1 ELSE 0 END) OVER (
                PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) = 1 AS is_valid
       FROM documents""",
)
def train_valid_split(t):
    """Rows at or after the separator row of their list are validation rows."""
    from facetry.operators.project import split_at_marker

    docs = t.documents.select("doc_id", "source")
    return split_at_marker(docs, ["source"], "doc_id", col("doc_id") % 97 == 90).select("doc_id", "is_valid")


@query(
    "vertex_union_offsets",
    """SELECT user_id + 0 AS pos, 'u' AS part FROM (SELECT DISTINCT user_id FROM events)
       UNION ALL
       SELECT s_suppkey + (SELECT count(DISTINCT user_id) FROM events) AS pos, 's' AS part FROM supplier""",
)
def vertex_union_offsets(t):
    """Concatenate two example sets, the second shifted by the size of the first."""
    users = t.events.select("user_id").distinct()
    shift = users.agg(F.count(F.lit(1))).scalar()
    first = users.select(col("user_id").alias("pos"), F.lit("u").alias("part"))
    second = t.supplier.select((col("s_suppkey") + shift).alias("pos"), F.lit("s").alias("part"))
    return first.unionByName(second)


# ---------------------------------------------------------------- scalar functions


@query(
    "nan_scrub",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0
              ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem""",
)
def nan_scrub(t):
    raw = F.when(col("l_discount") != 0, col("l_tax") / F.nullif(col("l_discount"), F.lit(0.0)))
    raw = raw.when(col("l_tax") == 0, float("nan")).otherwise(float("inf"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return t.lineitem.select(*keys, R(S.scrub(raw), 6).alias("ratio"))


@query(
    "clamp_mix_step",
    """WITH x AS (SELECT l_quantity / 50.0 AS x, l_discount AS d, l_orderkey, l_partkey, l_suppkey FROM lineitem),
            y AS (SELECT *, greatest(least((x - 0.2) / (0.8 - 0.2), 1.0), 0.0) AS u FROM x)
       SELECT l_orderkey, l_partkey, l_suppkey, round(greatest(least(x, 0.7), 0.1), 6) AS clamped,
              round(x * (1 - d) + (x * x) * d, 6) AS mixed, CASE WHEN x < 0.5 THEN 0.0 ELSE 1.0 END::DOUBLE AS stepped,
              round(u * u * (3 - 2 * u), 6) AS smooth, round(7 * x - floor(7 * x), 6) AS frac FROM y""",
)
def clamp_mix_step(t):
    x = col("l_quantity") / 50.0
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        R(S.clamp(x, 0.1, 0.7), 6).alias("clamped"),
        R(S.mix(x, x * x, col("l_discount")), 6).alias("mixed"),
        S.step(0.5, x).alias("stepped"),
        R(S.smoothstep(0.2, 0.8, x), 6).alias("smooth"),
        R(S.fract(7 * x), 6).alias("frac"),
    )


@query(
    "sign_abs_log",
    """SELECT c_custkey, CASE WHEN c_acctbal - 4500 < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn,
              round(ln(abs(c_acctbal - 4500) + 1e-30), 6) AS logabs,
              round(degrees(acos(greatest(least((c_acctbal - 4500) / 4000, 1.0), -1.0))), 6) AS acosd
       FROM customer""",
)
def sign_abs_log(t):
    v = col("c_acctbal") - 4500
    return t.customer.select(
        "c_custkey",
        S.sgn(v).alias("sgn"),
        R(S.log_abs(v), 6).alias("logabs"),
        R(S.acos_degrees(v / 4000), 6).alias("acosd"),
    )


@query(
    "polynomial_expand",
    """SELECT p_partkey, round(x, 6) AS x1, round(x^2, 6) AS x2, round(x^3, 6) AS x3, round(x^5, 6) AS x5,
              round(x^10, 6) AS x10 FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)""",
)
def polynomial_expand(t):
    x = col("p_size") / 50.0
    names = [(1, "x1"), (2, "x2"), (3, "x3"), (5, "x5"), (10, "x10")]
    cols = S.powers(x, [p for p, _ in names])
    return t.part.select("p_partkey", *[R(c, 6).alias(n) for c, (_, n) in zip(cols, names)])


@query(
    "log_rescale",
    """WITH m AS (SELECT p_partkey, p_retailprice / max(p_retailprice) OVER (PARTITION BY p_type) AS v FROM part)
       SELECT p_partkey, round(ln(v * 2 + 1) / ln(3.0), 6) AS b2, round(ln(v * 4 + 1) / ln(5.0), 6) AS b4,
              round(ln(v * 8 + 1) / ln(9.0), 6) AS b8 FROM m""",
)
def log_rescale(t):
    df = stats.scale_to_max(t.part, ["p_type"], "p_retailprice", "v")
    return df.select("p_partkey", *[R(S.log_rescale(col("v"), b), 6).alias(f"b{b}") for b in (2, 4, 8)])


@query(
    "data_cost_log",
    """WITH c AS (SELECT user_id, event_type, count(*) / 7.0 AS share, sum(value) / 1000 AS area
                  FROM events GROUP BY ALL)
       SELECT user_id, event_type, CASE WHEN area > 0 THEN round(-ln((100 + share) * area / 100), 6) END AS cost
       FROM c""",
)
def data_cost_log(t):
    c = t.events.groupBy("user_id", "event_type").agg(
        (F.count(F.lit(1)) / 7.0).alias("share"), (F.sum("value") / 1000).alias("area")
    )
    return c.select("user_id", "event_type", R(S.neg_log_cost(col("share"), col("area")), 6).alias("cost"))


@query(
    "class_subset_bits",
    """SELECT p_size, k AS class, (p_size >> k) & 1 = 1 AS member
       FROM (SELECT DISTINCT p_size FROM part) CROSS JOIN range(0, 6) r(k)""",
)
def class_subset_bits(t):
    bits = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(6)])).alias("class")
    out = t.part.select("p_size").distinct().select("p_size", bits)
    member = F.call_function("shiftright", col("p_size"), col("class").cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("member", member)


@query(
    "string_ids",
    """SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host,
              split_part(url, '.', 1) AS prefix, substr(url, 1, 5) AS scheme5,
              replace('net_{i}.txt', '{i}', page_id::VARCHAR) AS templated FROM pages""",
)
def string_ids(t):
    return t.pages.select(
        "page_id",
        F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "/", 1).alias("host"),
        F.substring_index("url", ".", 1).alias("prefix"),
        F.substring("url", 1, 5).alias("scheme5"),
        F.replace(F.lit("net_{i}.txt"), F.lit("{i}"), col("page_id").cast("string")).alias("templated"),
    )


@query(
    "sequence_boundary_fraction",
    """WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt
                  FROM events)
       SELECT user_id, round(avg((event_type <> nxt)::INT), 6) AS fraction FROM e WHERE nxt IS NOT NULL GROUP BY ALL""",
)
def sequence_boundary_fraction(t):
    """Share of edges between consecutive rows whose labels differ; edges come from ranks."""
    e = ordered.running(t.events.select("user_id", "event_type", "event_id"), ["user_id"], "event_id", "event_id")
    nxt = e.select("user_id", (col("pos") - 1).alias("pos"), col("event_type").alias("nxt"))
    pair = e.join(nxt, ["user_id", "pos"])
    return pair.groupBy("user_id").agg(
        R(F.avg((col("event_type") != col("nxt")).cast("int")), 6).alias("fraction")
    )
