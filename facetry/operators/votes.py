"""Votes over several labellings, and label accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: vote shares are divided by seven voters even when fewer take part.
VOTERS = 7


def vote_counts(votes: DataFrame, site: list[str], label: str) -> DataFrame:
    return votes.groupBy(*site, label).agg(F.count(F.lit(1)).alias("votes"))


def majority(votes: DataFrame, site: list[str], label: str, out: str = "vote") -> DataFrame:
    """Most frequent label per site; the smallest label wins a tie."""
    counts = vote_counts(votes, site, label)
    return counts.groupBy(*site).agg(
        F.max("votes").alias("votes"),
        F.min_by(label, F.struct(-F.col("votes"), F.col(label))).alias(out),
    )


def vote_shares(votes: DataFrame, site: list[str], label: str, labels: list | None = None, divisor: float = VOTERS) -> DataFrame:
    """Share of every label at every site, zero where a label got no vote.

    The label domain is short (one entry per class; read from the votes unless given), so the zero fill is a
    projection of conditional counts rather than a join with the domain.
    """
    if labels is None:
        labels = sorted(r[0] for r in votes.select(label).filter(F.col(label).isNotNull()).distinct().collect())
    wide = votes.groupBy(*site).agg(
        *[F.count(F.when(F.col(label) == F.lit(v), 1)).alias(f"_c{i}") for i, v in enumerate(labels)]
    )
    rows = F.array(
        *[F.struct(F.lit(v).alias(label), F.col(f"_c{i}").alias("votes")) for i, v in enumerate(labels)]
    )
    return wide.select(*site, F.inline(rows)).withColumn("share", F.col("votes") / F.lit(float(divisor)))


def coverage(votes: DataFrame, unit: list[str], voter: str) -> DataFrame:
    """Rows per unit and voter with a flag for voters that disagree with the fullest one."""
    n = votes.groupBy(*unit, voter).agg(F.count(F.lit(1)).alias("n"))
    full = n.groupBy(*unit).agg(F.max("n").alias("expected"))
    return n.join(full, unit).withColumn("complete", F.col("n") == F.col("expected"))


def weighted_accuracy(pred: Column, truth: Column, weight: Column, normalise: bool = False) -> Column:
    """Total weight of the rows where prediction equals truth; optionally as a share."""
    hit = F.sum(F.when(pred == truth, weight).otherwise(F.lit(0).cast("double")))
    return F.try_divide(hit, F.sum(weight)) if normalise else hit


def ranked_scores(scores: DataFrame, site: list[str], score: str, label: str, keep: int) -> DataFrame:
    """The ``keep`` best (score, label) pairs per site as a sorted array; higher label wins ties.

    A site has one row per class, so the array is bounded by the number of classes.
    """
    pair = F.struct(F.col(score).alias("score"), F.col(label).alias("label"))
    best = F.sort_array(F.collect_list(pair), asc=False)
    return scores.groupBy(*site).agg(F.slice(best, 1, keep).alias("best"))


def top_k_counts(best: Column, truth: Column, k: int) -> tuple[Column, Column]:
    """Of one site: whether the truth is among the top ``k``, and how often its area counts.

    Every class 0 among the top ``k`` hands its place to the next class.  The area counts once for the hit and
    once for each place handed to the truth, so it can count twice when both meet.  ``best`` must hold at
    least ``k + 1`` ranked pairs.
    """
    labels = F.transform(best, lambda p: p["label"])
    hit = F.array_contains(F.slice(labels, 1, k), truth)
    times = hit.cast("int")
    for i in range(k):
        times = times + ((F.get(labels, F.lit(i)) == 0) & (F.get(labels, F.lit(i + 1)) == truth)).cast("int")
    return hit, times


def top_k_accuracy(best: DataFrame, label: str, area: str, k: int) -> DataFrame:
    """``(label, accuracy, area)``: share of direct hits per class, and the area its hits add to the total."""
    hit, times = top_k_counts(F.col("best"), F.col(label), k)
    return best.groupBy(label).agg(F.avg(hit.cast("int")).alias("accuracy"), F.sum(times * F.col(area)).alias("area"))


def argmax_skip_zero(scores: DataFrame, site: list[str], score: str, label: str) -> DataFrame:
    """Best-scoring class above 0; the lowest class wins a tie."""
    ok = scores.filter(F.col(label) > 0)
    return ok.groupBy(*site).agg(
        F.min_by(label, F.struct(-F.col(score), F.col(label))).alias("pred")
    )


def macro_average(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Average of averages: ``levels`` from coarse to fine, one ``groupBy`` per level."""
    out = df
    while levels:
        out = out.groupBy(*levels).agg(F.avg(value).alias(value))
        levels = levels[:-1]
    return out.agg(F.avg(value).alias(value))
