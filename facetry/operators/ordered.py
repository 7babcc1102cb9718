"""Running totals, ranks and order statistics that survive hot groups.

A plain window puts a whole group in one task.  Here the ordering column is cut at its global
approximate quantiles, so a cell ``(group, bucket)`` holds at most about ``rows/buckets`` rows no
matter how skewed the groups are.  Totals per cell are added up first (small table), then each
cell runs its own window and adds the total of the cells before it.  The quantiles only decide
where to cut; the results are exact.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 2_000_000
#: Cuts that the driver holds at most, as numbers: enough for 1e11 rows in cells of the size above.
MAX_CELLS = 1 << 16


def _cells_needed(df: DataFrame, rows_per_cell: int) -> int:
    """Number of cells so that none holds much more than ``rows_per_cell`` rows, counted, not estimated."""
    return max(1, min(MAX_CELLS, math.ceil(df.count() / rows_per_cell)))


def _cuts(df: DataFrame, column: str, cells: int) -> list[float]:
    probabilities = [i / cells for i in range(1, cells)]
    return df.approxQuantile(column, probabilities, 1.0 / (4 * cells))


def _bucket(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    inner = sorted(set(splits))
    if not inner:
        return df.withColumn(out, F.lit(0))
    tool = Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol=column, outputCol=out, handleInvalid="keep"
    )
    return tool.transform(df).withColumn(out, F.col(out).cast("int"))


def _number(column: str) -> Column:
    """The ordering value as a double, with -0.0 and 0.0 made one value."""
    v = F.col(column).cast("double")
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def cumulate(
    df: DataFrame,
    group: list[str],
    value: str,
    measures: dict[str, Column],
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Per distinct ``(group, value)``: each measure's sum, running sum and group total.

    Equal values share one running total (the tie rule of sorted scans).  Output columns: group,
    value, ``m``, ``cum_m`` (inclusive) and ``total_m`` for each measure ``m``.
    """
    src = df.filter(F.col(value).isNotNull()).withColumn("_v", _number(value))
    cells = _cells_needed(src, rows_per_cell)
    cuts = _cuts(src, "_v", cells) if cells > 1 else []
    sums = [F.sum(expr).alias(name) for name, expr in measures.items()]
    per_value = src.groupBy(*group, F.col("_v")).agg(*sums)
    names = list(measures)
    within = Window.partitionBy(*group).orderBy("_v")
    if not cuts:
        whole = Window.partitionBy(*group)
        out = per_value.select(
            *group,
            F.col("_v").alias(value),
            *names,
            *[F.sum(m).over(within).alias(f"cum_{m}") for m in names],
            *[F.sum(m).over(whole).alias(f"total_{m}") for m in names],
        )
        return out
    per_value = _bucket(per_value, "_v", cuts, "_cell")
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_value.groupBy(*group, "_cell")
        .agg(*[F.sum(m).alias(m) for m in names])
        .select(
            *group,
            "_cell",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in names],
            *[F.sum(m).over(whole).alias(f"total_{m}") for m in names],
        )
    )
    in_cell = Window.partitionBy(*group, "_cell").orderBy("_v")
    return per_value.join(offsets, [*group, "_cell"]).select(
        *group,
        F.col("_v").alias(value),
        *names,
        *[(F.sum(m).over(in_cell) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in names],
        *[f"total_{m}" for m in names],
    )


def running(
    df: DataFrame,
    group: list[str],
    value: str,
    tie: str,
    sums: dict[str, Column] | None = None,
    pos: str = "pos",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add ``pos`` (0-based rank by ``value, tie``) and inclusive running sums to every row.

    ``tie`` must be numeric and unique within a group.  A single value shared by very many rows
    gets a cell of its own, which is cut again at the quantiles of ``tie``.
    """
    measures = {pos: F.lit(1).cast("long"), **(sums or {})}
    src = df
    for i, expr in enumerate(measures.values()):
        src = src.withColumn(f"_m{i}", expr)
    src = src.withColumn("_v", _number(value)).withColumn("_t", _number(tie))
    cells = _cells_needed(src, rows_per_cell)
    order = [F.col("_v"), F.col(tie)]
    names = list(measures)
    if cells <= 1:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        out = src
        for i, name in enumerate(names):
            shift = 1 if name == pos else 0
            out = out.withColumn(name, F.sum(f"_m{i}").over(w) - F.lit(shift))
        return out.drop("_v", "_t", *[f"_m{i}" for i in range(len(names))])
    cuts = _cuts(src, "_v", cells)
    repeated = sorted({a for a, b in zip(sorted(cuts), sorted(cuts)[1:]) if a == b})
    splits = [*cuts, *[math.nextafter(v, math.inf) for v in repeated]]
    src = _bucket(src, "_v", splits, "_cell")
    if repeated:
        src = _bucket(src, "_t", _cuts(src, "_t", cells), "_sub")
        src = src.withColumn("_sub", F.when(F.col("_v").isin(repeated), F.col("_sub")).otherwise(0))
    else:
        src = src.withColumn("_sub", F.lit(0))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        src.groupBy(*group, "_cell", "_sub")
        .agg(*[F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(names))])
        .select(
            *group,
            "_cell",
            "_sub",
            *[
                F.coalesce(F.sum(f"_m{i}").over(before), F.lit(0)).alias(f"_off{i}")
                for i in range(len(names))
            ],
        )
    )
    in_cell = (
        Window.partitionBy(*group, "_cell", "_sub")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = src.join(offsets, [*group, "_cell", "_sub"])
    for i, name in enumerate(names):
        shift = 1 if name == pos else 0
        out = out.withColumn(name, F.sum(f"_m{i}").over(in_cell) + F.col(f"_off{i}") - F.lit(shift))
    extra = [f"_m{i}" for i in range(len(names))] + [f"_off{i}" for i in range(len(names))]
    return out.drop("_v", "_t", "_cell", "_sub", *extra)


def at_position(
    cum: DataFrame, group: list[str], value: str, count: str, picks: dict[str, Column]
) -> DataFrame:
    """Pick values by 0-based position from a :func:`cumulate` result.

    ``picks`` maps an output name to a position expression over ``total_<count>``.
    """
    first, last = F.col(f"cum_{count}") - F.col(count), F.col(f"cum_{count}")
    return cum.groupBy(*group).agg(
        *[
            F.max(F.when((first <= p) & (p < last), F.col(value))).alias(name)
            for name, p in picks.items()
        ]
    )


def floor_position(k: float | Column, count: str) -> Column:
    """Position ``floor(k*n)``, kept inside the group."""
    k = F.lit(float(k)) if not isinstance(k, Column) else k
    total = F.col(f"total_{count}")
    return F.least(F.floor(k * total), total - 1)
