"""Grouped statistics: weighted means, moments, percentiles, winsorising, scatter matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import EPSILON, clamp, sgn
from facetry.operators.ordered import at_position, cumulate, floor_position


def weighted_mean(v: Column, w: Column) -> Column:
    """NULL where the weights add up to nothing."""
    return F.try_divide(F.sum(v * w), F.sum(w))


def power_mean_columns(v: Column) -> dict[str, Column]:
    return {
        "mean2": F.avg(v * v),
        "mean4": F.avg(v * v * v * v),
        "meansqrt": F.avg(F.sqrt(v)),
        "meansqrtsqrt": F.avg(F.sqrt(F.sqrt(v))),
    }


def weighted_power_mean(v: Column, w: Column, p: float) -> Column:
    return F.try_divide(F.sum(F.pow(v, F.lit(p)) * w), F.sum(w))


def with_group_stats(df: DataFrame, group: list[str], **stats: Column) -> DataFrame:
    """Attach group aggregates to every row by aggregate-and-join.

    Unlike a whole-group window this never moves a group into one task: the aggregate combines
    on the map side, and the join side has one row per group (Spark broadcasts it when its
    measured size allows, otherwise adaptive execution splits skewed partitions).
    """
    if not group:
        for name, stat in stats.items():
            df_stat = df.agg(stat.alias(name)).scalar()
            df = df.withColumn(name, df_stat)
        return df
    agg = df.groupBy(*group).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(agg, group)


def central_moments(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Population variance, skewness and (non-excess) kurtosis around the group mean, two passes."""
    w = F.col(weight) if weight else F.lit(1.0)
    v = F.col(value)
    rows = with_group_stats(df, group, _mu=weighted_mean(v, w))
    gap = v - F.col("_mu")
    m = rows.groupBy(*group).agg(
        F.first("_mu").alias("mean"),
        *[weighted_mean(F.pow(gap, F.lit(float(p))), w).alias(f"_m{p}") for p in (2, 3, 4)],
    )
    return m.select(
        *group,
        "mean",
        F.col("_m2").alias("variance"),
        (F.col("_m3") / (F.sqrt(F.col("_m2") * F.col("_m2") * F.col("_m2")) + EPSILON)).alias("skewness"),
        (F.col("_m4") / (F.col("_m2") * F.col("_m2") + EPSILON)).alias("kurtosis"),
    )


def floor_percentiles(df, group: list[str], value: str, ks: dict[str, float], **kw) -> DataFrame:
    """``sorted[floor(k*n)]`` without interpolation, for each named ``k``."""
    cum = cumulate(df, group, value, {"n": F.lit(1)}, **kw)
    return at_position(cum, group, value, "n", {name: floor_position(k, "n") for name, k in ks.items()})


def medians(df, group: list[str], value: str, **kw) -> DataFrame:
    """Median; an even count averages the two middle values."""
    cum = cumulate(df, group, value, {"n": F.lit(1)}, **kw)
    total = F.col("total_n")
    picks = {"_lo": F.floor((total - 1) / 2), "_hi": F.floor(total / 2)}
    mid = at_position(cum, group, value, "n", picks)
    return mid.select(*group, ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def weighted_medians(df, group: list[str], value: str, weight: Column, share: float = 0.5, **kw) -> DataFrame:
    """First value, in ascending order, whose cumulative weight share reaches ``share``; no row for a group of weight 0."""
    cum = cumulate(df, group, value, {"w": weight}, **kw)
    reached = F.try_divide("cum_w", "total_w") >= share
    return cum.filter(reached).groupBy(*group).agg(F.min(value).alias("weighted_median"))


def quantile_crossings(
    df, group: list[str], value: str, weight: Column, shares: dict[str, float], **kw
) -> DataFrame:
    """Value at which the cumulative weight share first reaches each of ``shares``; NULL in a group of weight 0."""
    cum = cumulate(df, group, value, {"w": weight}, **kw)
    reached = F.try_divide("cum_w", "total_w")
    return cum.groupBy(*group).agg(
        *[F.min(F.when(reached >= s, F.col(value))).alias(name) for name, s in shares.items()]
    )


def winsorise_two_sided(df, group: list[str], value: str, upper: float, lower: float, out: str, **kw) -> DataFrame:
    """Clamp to the floor-index percentiles ``lower`` and ``upper`` of the group."""
    cut = floor_percentiles(df, group, value, {"_hi": upper, "_lo": lower}, **kw)
    kept = df.join(cut, group)
    return kept.withColumn(out, clamp(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_hi", "_lo")


def winsorise_signed(df, group: list[str], value: str, p: float, out: str, **kw) -> DataFrame:
    """Clamp magnitudes to the floor-index percentile of ``|value|``, keeping the sign."""
    mags = df.withColumn("_mag", F.abs(F.col(value).cast("double")))
    cut = floor_percentiles(mags, group, "_mag", {"_t": p}, **kw)
    v, t = F.col(value), F.col("_t")
    kept = df.join(cut, group)
    return kept.withColumn(out, F.when(F.abs(v) < t, v).otherwise(sgn(v) * t)).drop("_t")


def rebase(df, group: list[str], value: str, out: str) -> DataFrame:
    """Subtract the group minimum."""
    return with_group_stats(df, group, _lo=F.min(value)).withColumn(out, F.col(value) - F.col("_lo")).drop("_lo")


def scale_to_max(df, group: list[str], value: str, out: str) -> DataFrame:
    """Divide by the group maximum; NULL where that is zero."""
    return with_group_stats(df, group, _hi=F.max(value)).withColumn(out, F.try_divide(F.col(value), F.col("_hi"))).drop("_hi")


def distinct_first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(position).alias("first_seen"))


def scatter3(x: Column, y: Column, z: Column, w: Column | None = None) -> dict[str, Column]:
    """The six sums of the 3x3 scatter matrix (not centred, not divided)."""
    w = F.lit(1.0) if w is None else w
    pairs = {"sxx": x * x, "sxy": x * y, "sxz": x * z, "syy": y * y, "syz": y * z, "szz": z * z}
    return {name: F.sum(term * w) for name, term in pairs.items()}


def symmetric3_eigenvalues(xx, xy, xz, yy, yz, zz) -> tuple[Column, Column, Column]:
    """Closed-form eigenvalues of a symmetric 3x3 matrix, ascending."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off
    p = F.sqrt(p2 / 6)
    safe = F.when(p > 0, p).otherwise(1.0)
    a, b, c = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe
    d, e, f = xy / safe, xz / safe, yz / safe
    half_det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(clamp(half_det, -1.0, 1.0)) / 3
    third = 2.0943951023931953
    top = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + third)
    return low, 3 * q - top - low, top


def symmetric3_eigenvector(xx, xy, xz, yy, yz, zz, value: Column) -> tuple[Column, Column, Column]:
    """Unit eigenvector of a symmetric 3x3 matrix for a simple eigenvalue.

    It is orthogonal to all rows of ``A - value I``; of the three row products the longest is used.
    """
    from facetry.functions.vectors import cross3, dot3

    rows = [(xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)]
    options = [cross3(rows[0], rows[1]), cross3(rows[0], rows[2]), cross3(rows[1], rows[2])]
    sizes = [dot3(o, o) for o in options]
    best = F.greatest(*sizes)
    length = F.sqrt(best)

    def part(i):
        raw = F.when(sizes[0] == best, options[0][i]).when(sizes[1] == best, options[1][i]).otherwise(options[2][i])
        return F.when(length > 0, raw / length).otherwise(0.0)

    return part(0), part(1), part(2)
