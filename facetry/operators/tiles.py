"""Tile-wise products of two tables of a group, reduced before anything leaves a task.

All rows of a group must meet all others, but no pair is ever emitted: both sides are cut into tiles
of bounded size, each (left tile, right tile) meets in one task, and that task returns only partial
sums per left row.  A group of any size spreads over as many tasks as it has tile pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 2048


def tile_product(
    left: DataFrame,
    right: DataFrame,
    group: list[str],
    left_key: str,
    right_key: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Partial results of ``kernel(left tile, right tile)``; the caller adds them up per left row."""

    def tiles_of(df, key, name):
        per = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias(f"_{name}n"))
        return per, df.join(per, group).withColumn(f"_{name}", F.pmod(F.xxhash64(key), F.col(f"_{name}n")))

    per_l, lt = tiles_of(left, left_key, "l")
    per_r, rt = tiles_of(right, right_key, "r")
    lt = lt.join(per_r, group).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rn") - 1)))
    rt = rt.join(per_l, group).withColumn("_l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ln") - 1)))
    # fresh column identities, so that a table may meet itself
    rt = rt.select(*[F.col(c).alias(c) for c in rt.columns])
    by = [*group, "_l", "_r"]
    return lt.groupBy(*by).cogroup(rt.groupBy(*by)).applyInPandas(kernel, schema)
