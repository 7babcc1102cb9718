"""Hard and soft two-dimensional histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the shape-context layout: distance bins, angle bins, log exponent, reach, angle range.
DISTANCE_BINS = [5, 5, 5, 10, 10, 10]
ANGLE_BINS = [4, 6, 8, 4, 6, 8]
LOG_EXPONENT = 0.90
REACH = 1.20
ANGLE_RANGE = (-90.0, 90.0)
# Fixed values of the spin-image layout: support, cells per side, splat width, cut-offs.
SPIN_SUPPORT = 2.0
SPIN_CELLS = 10
SPLAT_VARIANCE = 0.2
SPLAT_REACH = 2.5
SPLAT_FLOOR = 0.02


def log_edges(n: int, reach: float, p: float = LOG_EXPONENT) -> list[float]:
    """``n + 1`` bin edges from 0 to ``reach``; ``p <= 0`` gives equal widths."""
    s = n + 1.0
    if p <= 0:
        return [reach * x / n for x in range(n + 1)]
    return [(-math.log((s - x) / s)) ** p * reach / math.log(s) ** p if x else 0.0 for x in range(n + 1)]


def equal_edges(n: int, low: float, high: float) -> list[float]:
    return [low + (high - low) * i / n for i in range(n + 1)]


def log_edge_column(x: Column, n: int, reach: Column, p: float = LOG_EXPONENT) -> Column:
    """The same edges when the reach is a column (one reach per mesh)."""
    s = n + 1.0
    unit = F.pow(-F.ln((F.lit(s) - x) / s), F.lit(p)) / math.log(s) ** p
    return F.when(x == 0, 0.0).otherwise(unit * reach)


def closed_bins(value: Column, edges: list[float]) -> Column:
    """Indexes of the bins containing ``value``; both ends are closed, so an inner edge hits two bins."""
    bins = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    )
    hit = F.filter(bins, lambda b: (value >= b["a"]) & (value <= b["b"]))
    return F.transform(hit, lambda b: b["i"])


def hard(rows: DataFrame, group: list[str], x: Column, y: Column, weight: Column, x_edges, y_edges) -> DataFrame:
    """Weighted counts per ``(group, xb, yb)``; bins without mass have no row."""
    hits = rows.select(*group, weight.alias("_w"), closed_bins(x, x_edges).alias("_x"), closed_bins(y, y_edges).alias("_y"))
    hits = hits.select(*group, "_w", F.explode("_x").alias("xb"), "_y").select(
        *group, "_w", "xb", F.explode("_y").alias("yb")
    )
    return hits.groupBy(*group, "xb", "yb").agg(F.sum("_w").alias("mass"))


def soft(rows: DataFrame, group: list[str], ic: Column, jc: Column, weight: Column, cells: int = SPIN_CELLS) -> DataFrame:
    """Gaussian splat of every row over its neighbouring cells, normalised per row."""
    src = rows.select(*group, ic.alias("_i"), jc.alias("_j"), weight.alias("_w"))
    # only cells whose centre is within the splat's effective reach can pass the floor
    reach = math.sqrt(-math.log(SPLAT_FLOOR) * SPLAT_VARIANCE)

    def around(c):
        low = F.greatest(F.ceil(c - 0.5 - reach), F.lit(0)).cast("int")
        high = F.least(F.floor(c - 0.5 + reach), F.lit(cells - 1)).cast("int")
        return F.when(low <= high, F.sequence(low, high))

    src = src.select(*group, "_i", "_j", "_w", around(F.col("_i")).alias("_xs"), around(F.col("_j")).alias("_ys"))

    def splat(x, y):
        gx, gy = F.col("_i") - (x + 0.5), F.col("_j") - (y + 0.5)
        w = F.exp(-(gx * gx + gy * gy) / SPLAT_VARIANCE)
        return F.struct(x.alias("xb"), y.alias("yb"), F.when(w < SPLAT_FLOOR, 0.0).otherwise(w).alias("w"))

    hits = src.withColumn("_c", F.flatten(F.transform("_xs", lambda x: F.transform(F.col("_ys"), lambda y: splat(x, y)))))
    hits = hits.withColumn("_c", F.filter("_c", lambda c: c["w"] > 0))
    hits = hits.withColumn("_sum", F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["w"]))
    flat = hits.select(*group, "_w", "_sum", F.inline("_c"))
    return flat.groupBy(*group, "xb", "yb").agg(F.sum(F.col("w") / F.col("_sum") * F.col("_w")).alias("mass"))
