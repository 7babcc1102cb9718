"""Descriptor catalogue, block projection, combinations, list splitting, array codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.ordered import running

# The seven descriptor families, their offsets and widths (593 numbers per face).
BLOCKS = {
    "cur": (0, 64),
    "pca": (64, 48),
    "sc": (112, 270),
    "geo": (382, 15),
    "sdf": (397, 72),
    "vsi": (469, 24),
    "si": (493, 100),
}
TOTAL_WIDTH = 593


def mask_width(mask: str) -> int:
    """Width of the projection selected by a seven-bit mask."""
    return sum(w for bit, (_, w) in zip(mask, BLOCKS.values()) if bit == "1")


def project_blocks(df: DataFrame, mask: str, features: str = "f", strict: bool = True) -> DataFrame:
    """Keep the descriptor families whose bit is set.

    A row shorter than the catalogue would shift its successors if dropped, so by default it
    fails the job; ``strict=False`` drops it.
    """
    v = F.col(features)
    if strict:
        ok = F.assert_true(F.size(v) >= TOTAL_WIDTH, F.lit("descriptor row is too short"))
        df = df.filter(ok.isNull())
    else:
        df = df.filter(F.size(v) >= TOTAL_WIDTH)
    kept = [F.slice(v, o + 1, w) for bit, (o, w) in zip(mask, BLOCKS.values()) if bit == "1"]
    return df.withColumn(features, F.concat(*kept))


def split_blocks(df: DataFrame, features: str = "f") -> DataFrame:
    """One array column per family, so that a columnar scan reads only the wanted families."""
    cols = {name: F.slice(F.col(features), o + 1, w) for name, (o, w) in BLOCKS.items()}
    return df.withColumns(cols).drop(features)


def column_combinations(items: DataFrame, item: str, n: int) -> DataFrame:
    """All ``n``-element combinations of a short list of distinct items, each in ascending order.

    The list (a handful of names) becomes one sorted array; every step appends each later item.
    """
    domain = items.agg(F.array_sort(F.collect_set(item)).alias("_all"))
    out = domain.select("_all", F.array().cast(domain.schema["_all"].dataType).alias("items"), F.lit(0).alias("_at"))
    for _ in range(n):
        rest = F.expr("slice(_all, _at + 1, size(_all) - _at)")
        out = out.select("_all", "items", "_at", F.posexplode(rest).alias("_skip", "_next")).select(
            "_all",
            F.array_append("items", F.col("_next")).alias("items"),
            (F.col("_at") + F.col("_skip") + 1).alias("_at"),
        )
    return out.select("items")


def split_at_marker(df: DataFrame, group: list[str], position: str, marker: Column) -> DataFrame:
    """``is_valid`` turns true from the first marker row on; one small aggregate, no row order kept."""
    first = df.filter(marker).groupBy(*group).agg(F.min(position).alias("_from"))
    out = df.join(first, group, "left")
    return out.withColumn("is_valid", F.coalesce(F.col(position) >= F.col("_from"), F.lit(False))).drop("_from")


def reindex(kept: DataFrame, key: str, out: str = "new_id") -> DataFrame:
    """Dense 0-based ids in key order."""
    return running(kept, [], key, key, pos=out)


def encode_record(values: Column, channels: int, height: int, width: int, label: Column) -> Column:
    """Pack an array and its shape into one record."""
    return F.struct(
        F.lit(channels).alias("channels"),
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        values.cast("array<float>").alias("float_data"),
        label.cast("int").alias("label"),
    )


def decode_record(record: Column) -> Column:
    """Array of channels, each an array of ``height*width`` values."""
    size = record["height"] * record["width"]
    return F.transform(
        F.sequence(F.lit(0), record["channels"] - 1),
        lambda c: F.slice(record["float_data"], c * size + 1, size),
    )
