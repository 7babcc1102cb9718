"""Line-addressed text: in these formats a row's identity is its line number.

Files are read as splittable text.  A line's number is its rank by (block offset, order of reading),
found with the skew-proof ranking, so one huge file is read and numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.operators.ordered import running


def file_stem(path: Column) -> Column:
    """File name up to the first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def lines(spark: SparkSession, path, keep: Column | None = None, **kw) -> DataFrame:
    """``(file_id, line, value)``: non-blank lines numbered from 0 within their file.

    ``keep`` drops further lines (comments) before numbering.
    """
    raw = spark.read.text(path).select(
        file_stem(F.col("_metadata.file_path")).alias("file_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_read"),
        F.trim("value").alias("value"),
    )
    raw = raw.filter(F.col("value") != "")
    if keep is not None:
        raw = raw.filter(keep)
    out = running(raw, ["file_id"], "_block", "_read", pos="line", **kw)
    return out.select("file_id", "line", "value")


def tokens(value: Column) -> Column:
    return F.split(value, r"\s+")


def numbers(value: Column, kind: str = "double", strict: bool = True) -> Column:
    """Numbers of a line; ``strict=False`` reads other words as NULL instead of failing."""
    words = tokens(value)
    return words.cast(f"array<{kind}>") if strict else words.try_cast(f"array<{kind}>")


def read_vectors(spark, path, **kw) -> DataFrame:
    """``(mesh_id, face, f)``: one whitespace-separated vector per line."""
    rows = lines(spark, path, **kw)
    return rows.select(F.col("file_id").alias("mesh_id"), F.col("line").alias("face"), numbers(F.col("value")).alias("f"))


def read_scalars(spark, path, name: str, kind: str = "double", limit: DataFrame | None = None, **kw) -> DataFrame:
    """One value per line; rows beyond the face count in ``limit(mesh_id, n)`` are dropped."""
    rows = lines(spark, path, **kw)
    out = rows.select(F.col("file_id").alias("mesh_id"), F.col("line").alias("face"), F.col("value").cast(kind).alias(name))
    if limit is not None:
        out = out.join(limit, "mesh_id").filter(F.col("face") < F.col("n")).drop("n")
    return out


def read_labels(spark, path, limit: DataFrame | None = None, **kw) -> DataFrame:
    return read_scalars(spark, path, "label", "int", limit, **kw)


def read_areas(spark, path, **kw) -> DataFrame:
    return read_scalars(spark, path, "area", "double", **kw)


def read_adjacency(spark, path, **kw) -> DataFrame:
    """``face n0 n1 n2`` rows as edges ``(mesh_id, src, slot, dst)``; a face naming itself has no neighbour."""
    rows = lines(spark, path, **kw).select(F.col("file_id").alias("mesh_id"), numbers(F.col("value"), "bigint").alias("n"))
    flat = rows.select("mesh_id", F.col("n")[0].alias("src"), F.posexplode(F.slice("n", 2, 3)).alias("slot", "dst"))
    return flat.withColumn("dst", F.when(F.col("dst") != F.col("src"), F.col("dst")))


def read_slot_values(spark, path, name: str = "w", **kw) -> DataFrame:
    """Three values per line, aligned with the adjacency slots: ``(mesh_id, src, slot, name)``."""
    rows = lines(spark, path, **kw)
    return rows.select(
        F.col("file_id").alias("mesh_id"), F.col("line").alias("src"), F.posexplode(numbers(F.col("value"))).alias("slot", name)
    )


def read_descriptors(spark, path, strict: bool = True, **kw) -> DataFrame:
    """Descriptor rows as one array column per family."""
    from facetry.operators.project import TOTAL_WIDTH, split_blocks

    rows = read_vectors(spark, path, **kw)
    if strict:
        ok = F.assert_true(F.size("f") >= TOTAL_WIDTH, F.lit("descriptor row is too short"))
        rows = rows.filter(ok.isNull())
    return split_blocks(rows)


def read_mesh_list(spark, path, **kw) -> DataFrame:
    """``mesh [labels]`` lines; those behind a lone ``-`` are for validation."""
    from facetry.operators.project import split_at_marker

    rows = split_at_marker(lines(spark, path, **kw), ["file_id"], "line", F.col("value") == "-")
    t = tokens(F.col("value"))
    rows = rows.filter(F.col("value") != "-")
    return rows.select("file_id", "line", t[0].alias("mesh_path"), F.get(t, F.lit(1)).alias("label_path"), "is_valid")


def read_ids(spark, path, **kw) -> DataFrame:
    """Whitespace-separated ids of split lists such as ``t1``: ``(fold, role, mesh_id)``."""
    rows = lines(spark, path, **kw).select("file_id", F.explode(tokens(F.col("value"))).alias("mesh_id"))
    role = F.when(F.substring("file_id", 1, 1) == "t", "train").otherwise("test")
    return rows.select(F.expr("cast(substring(file_id, 2) as int)").alias("fold"), role.alias("role"), "mesh_id")


def read_counts(spark, path, **kw) -> DataFrame:
    """A list of counts, possibly several per line: ``(mesh_id, n)`` with 1-based position as id."""
    rows = lines(spark, path, **kw).select("line", F.posexplode(tokens(F.col("value"))).alias("col", "n"))
    sizes = rows.groupBy("line").agg(F.count("*").alias("_size"))
    before = running(sizes, [], "line", "line", {"_upto": F.col("_size")}, pos="_p")
    before = before.select("line", (F.col("_upto") - F.col("_size")).alias("_before"))
    out = rows.join(before, "line")
    return out.select((F.col("_before") + F.col("col") + 1).alias("mesh_id"), F.col("n").cast("long").alias("n"))


def read_predictions(spark, path, **kw) -> DataFrame:
    """Prediction files ``<model>/<mesh>.txt``: ``(model, mesh_id, face, label)``."""
    raw = spark.read.text(path).select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("model"),
        file_stem(F.col("_metadata.file_path")).alias("mesh_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_read"),
        F.trim("value").cast("int").alias("label"),
    )
    out = running(raw.filter("label is not null"), ["model", "mesh_id"], "_block", "_read", pos="face", **kw)
    return out.select("model", "mesh_id", "face", "label")


def manifest(spark, path) -> DataFrame:
    """Files under a glob with their folder, stem and size, without reading their content."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), file_stem(F.col("path")).alias("file_id"), "length")


def with_all_inputs(meshes: DataFrame, manifests: list[DataFrame], key: str = "mesh_id") -> DataFrame:
    """Only meshes for which every manifest lists a file."""
    for m in manifests:
        meshes = meshes.join(m.select(F.col("file_id").alias(key)), key, "left_semi")
    return meshes


def write_ordered_text(rows: DataFrame, path: str, unit: str, line: str, value: str = "value", files: int | None = None) -> None:
    """One folder per unit; its part files, in name order, hold the lines in order.

    Rows are range-partitioned by (unit, line), so a unit of any size is written by several tasks; their number
    follows the size of the data unless ``files`` fixes it.
    """
    placed = rows.select(F.col(unit), F.col(line).alias("_line"), F.col(value).cast("string").alias("value"))
    by = [unit, "_line"] if files is None else [files, unit, "_line"]
    placed = placed.repartitionByRange(*by).sortWithinPartitions(unit, "_line")
    placed.drop("_line").write.mode("overwrite").partitionBy(unit).text(path)


def write_records(rows: DataFrame, path: str, by=("fold", "combo", "kind")) -> None:
    """Packed training records as partitioned parquet, one row per mesh item."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def expand_template(spark, template: str, count: int) -> DataFrame:
    """``(i, text)``: the template with ``{i}`` replaced by 0 .. count-1."""
    return spark.range(count).select(
        F.col("id").alias("i"), F.replace(F.lit(template), F.lit("{i}"), F.col("id").cast("string")).alias("text")
    )
