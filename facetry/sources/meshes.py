"""Mesh files: OFF, OBJ and PLY readers, OFF and OBJ writers.

Readers return ``(vertices, faces)`` with ``mesh_id`` = file stem.  Polygons become triangle fans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.operators.ordered import running
from facetry.session import cut
from facetry.sources.text import file_stem, lines, numbers, tokens, write_ordered_text


def _fans(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Triangles ``(mesh_id, face, v0, v1, v2)`` from polygons ``(mesh_id, line, ring)`` in line order."""
    corner = F.explode(F.sequence(F.lit(1), F.size(ring) - 2)).alias("_k")
    tri = polygons.filter(F.size(ring) >= 3).select("mesh_id", "line", ring, corner)
    # the faces of the lines before, then the place within the line: no key has to hold both
    fans = polygons.filter(F.size(ring) >= 3).select("mesh_id", "line", (F.size(ring) - 2).alias("_size"))
    fans = running(fans, ["mesh_id"], "line", "line", {"_upto": F.col("_size").cast("long")}, pos="_p")
    fans = fans.select("mesh_id", "line", (F.col("_upto") - F.col("_size")).alias("_before"))
    tri = tri.join(fans, ["mesh_id", "line"]).withColumn("face", F.col("_before") + F.col("_k") - 1)
    v = F.col(ring)
    return tri.select("mesh_id", "face", v[0].alias("v0"), F.get(v, F.col("_k")).alias("v1"), F.get(v, F.col("_k") + 1).alias("v2"))


def _points(rows: DataFrame, v: Column, xyz: Column) -> DataFrame:
    return rows.select("mesh_id", v.alias("v"), xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z"))


def read_off(spark: SparkSession, path, **kw) -> tuple[DataFrame, DataFrame]:
    rows = cut(lines(spark, path, ~F.col("value").startswith("#"), **kw).withColumnRenamed("file_id", "mesh_id"))
    counts = rows.filter("line = 1").select(
        "mesh_id", numbers(F.col("value"), "bigint")[0].alias("_nv"), numbers(F.col("value"), "bigint")[1].alias("_nf")
    )
    body = rows.filter("line > 1").join(counts, "mesh_id").withColumn("k", F.col("line") - 2)
    v = body.filter(F.col("k") < F.col("_nv"))
    f = body.filter((F.col("k") >= F.col("_nv")) & (F.col("k") < F.col("_nv") + F.col("_nf")))
    # not strict: the optimiser may look at a vertex line before the join has told the two kinds apart
    ring = numbers(F.col("value"), "bigint", strict=False)
    polygons = f.select("mesh_id", "line", F.slice(ring, F.lit(2), ring[0].cast("int")).alias("ring"))
    return _points(v, F.col("k"), numbers(F.col("value"))), _fans(polygons)


def read_obj(spark: SparkSession, path, **kw) -> tuple[DataFrame, DataFrame]:
    """Vertices ``v`` and faces ``f`` (``a``, ``a/b`` or ``a/b/c`` corners; negative ones count backwards)."""
    kind = F.substring_index("value", " ", 1)
    rows = lines(spark, path, kind.isin("v", "f"), **kw).withColumnRenamed("file_id", "mesh_id")
    rows = rows.withColumn("value", F.regexp_replace("value", r"\s+", " "))
    is_v = F.col("value").startswith("v ")
    rows = cut(running(rows, ["mesh_id"], "line", "line", {"nv": is_v.cast("long")}, pos="_p", **kw))
    rest = F.slice(tokens(F.col("value")), F.lit(2), F.size(tokens(F.col("value"))) - 1)
    v = rows.filter(is_v)
    f = rows.filter(~is_v)
    corner = F.transform(rest, lambda t: F.substring_index(t, "/", 1).try_cast("bigint"))
    ring = F.transform(corner, lambda c: F.when(c > 0, c - 1).otherwise(F.col("nv") + c))
    return _points(v, F.col("nv") - 1, rest.cast("array<double>")), _fans(f.select("mesh_id", "line", ring.alias("ring")))


# Scalar type names of the PLY format and their numpy codes.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2",
    "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4",
    "double": "f8", "float64": "f8",
}


def _ply_rows(content: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Vertex coordinates and polygon rings of one PLY file (ascii or binary)."""
    head, body = content.split(b"end_header", 1)
    body = body[body.index(b"\n") + 1 :]
    order, elements = "ascii", []
    for line in head.decode("ascii", "replace").splitlines():
        t = line.split()
        if t[:1] == ["format"]:
            order = {"ascii": "ascii", "binary_little_endian": "<", "binary_big_endian": ">"}[t[1]]
        elif t[:1] == ["element"]:
            elements.append((t[1], int(t[2]), []))
        elif t[:1] == ["property"]:
            elements[-1][2].append(t[1:])
    points, rings, at = np.zeros((0, 3)), [], 0
    words = body.split() if order == "ascii" else None
    for name, count, props in elements:
        lists = [p for p in props if p[0] == "list"]
        names = [p[-1] for p in props]
        if not lists:
            if words is not None:
                table = np.array(words[at : at + count * len(props)], dtype="float64").reshape(count, len(props))
                at += count * len(props)
            else:
                kind = np.dtype([(p[-1], order + PLY_TYPES[p[0]]) for p in props])
                raw = np.frombuffer(body, kind, count, at)
                at += kind.itemsize * count
                table = np.stack([raw[n].astype("float64") for n in names], axis=1) if count else np.zeros((0, len(names)))
            if name == "vertex":
                points = table[:, [names.index(c) for c in "xyz"]]
            continue
        for _ in range(count):
            for p in props:
                if words is not None:
                    n = int(words[at]) if p[0] == "list" else 1
                    at += p[0] == "list"
                    values = words[at : at + n]
                    at += n
                elif p[0] == "list":
                    n_kind, v_kind = np.dtype(order + PLY_TYPES[p[1]]), np.dtype(order + PLY_TYPES[p[2]])
                    n = int(np.frombuffer(body, n_kind, 1, at)[0])
                    values = np.frombuffer(body, v_kind, n, at + n_kind.itemsize)
                    at += n_kind.itemsize + n * v_kind.itemsize
                else:
                    at += np.dtype(PLY_TYPES[p[0]]).itemsize
                    continue
                if name == "face" and p[-1] in ("vertex_indices", "vertex_index"):
                    rings.append([int(float(v)) for v in values])
    return points, rings


def read_ply(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """PLY files; a binary PLY file cannot be split, so each file is decoded by one task."""
    files = spark.read.format("binaryFile").load(path).select(file_stem(F.col("path")).alias("mesh_id"), "content")

    def decode(batches):
        for pdf in batches:
            for mesh, content in zip(pdf["mesh_id"], pdf["content"]):
                points, rings = _ply_rows(content)
                for i in range(0, len(points), 65536):
                    part = points[i : i + 65536]
                    yield pd.DataFrame({"mesh_id": mesh, "line": np.arange(i, i + len(part)), "xyz": list(part), "ring": None})
                for i in range(0, len(rings), 65536):
                    part = rings[i : i + 65536]
                    yield pd.DataFrame({"mesh_id": mesh, "line": np.arange(i, i + len(part)), "xyz": None, "ring": part})

    rows = cut(files.mapInPandas(decode, "mesh_id string, line long, xyz array<double>, ring array<long>"))
    v = rows.filter("xyz is not null")
    return _points(v, F.col("line"), F.col("xyz")), _fans(rows.filter("ring is not null"))


def read_mesh(spark: SparkSession, path: str, **kw) -> tuple[DataFrame, DataFrame]:
    """Reader chosen by the file extension in the path or glob."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"off": read_off, "obj": read_obj}
    if kind == "ply":
        return read_ply(spark, path)
    if kind not in readers:
        raise ValueError(f"no mesh reader for .{kind}")
    return readers[kind](spark, path, **kw)


def off_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(mesh_id, line, value)`` rows of OFF files."""
    n = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_nv"))
    m = faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_nf"))
    sizes = n.join(m, "mesh_id", "left").fillna(0, ["_nf"])
    head = sizes.select(
        "mesh_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("long").alias("line"), F.lit("OFF").alias("value")),
                F.struct(F.lit(1).cast("long").alias("line"), F.concat_ws(" ", "_nv", "_nf", F.lit("0")).alias("value")),
            )
        ),
    )
    v = vertices.select("mesh_id", (F.col("v") + 2).cast("long").alias("line"), F.concat_ws(" ", "x", "y", "z").alias("value"))
    f = faces.join(n, "mesh_id").select(
        "mesh_id", (F.col("face") + F.col("_nv") + 2).cast("long").alias("line"),
        F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2").alias("value"),
    )
    return head.unionByName(v).unionByName(f)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    n = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_nv"))
    v = vertices.select("mesh_id", F.col("v").cast("long").alias("line"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    corners = [(F.col(f"v{i}") + 1).cast("string") for i in range(3)]
    f = faces.join(n, "mesh_id").select(
        "mesh_id", (F.col("face") + F.col("_nv")).cast("long").alias("line"), F.concat_ws(" ", F.lit("f"), *corners).alias("value")
    )
    return v.unionByName(f)


def write_off(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    write_ordered_text(off_lines(vertices, faces), path, "mesh_id", "line")


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    write_ordered_text(obj_lines(vertices, faces), path, "mesh_id", "line")
