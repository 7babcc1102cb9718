"""Token-id files: flat unsigned integers plus 64-bit document offsets, one pair of files per partition.

Documents are range-partitioned by id and encoded where they land; each task writes

* ``NNNNN.bin``: the ids of its documents, end id included, as little-endian unsigned 16-bit integers if the
  vocabulary fits, else 32-bit;
* ``NNNNN.idx``: little-endian signed 64-bit offsets (in tokens, within the file), one more than documents;
* ``NNNNN.ids``: little-endian signed 64-bit document ids (the smallest value for a null id).

Bases of the partitions are prefix sums of their token counts and stand in ``manifest.json``.  A file is
written under a name of its own and renamed when complete, and its content depends on the input alone, so a
task that runs again replaces it by the same bytes.  Files are read back through memory maps.

Local paths (shared mounts included) are memory-mapped; other stores are written through pyarrow's file
systems and read whole, one file per task.  A null text is empty: its end id alone.  Rows with null ids come
first; repeated rows are written once each; other columns are ignored.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import blocks, texts
from facetry.llm.tokens import encoder, tokenizer_path
from facetry.session import checkpoint_folder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
NO_ID = -(1 << 63)


class Store:
    """The few file operations needed, on a mounted path or any store pyarrow can reach."""

    def __init__(self, folder: str):
        parts = urlsplit(folder)
        self.local = parts.scheme in ("", "file")
        if self.local:
            import pyarrow.fs as fs

            self.fs, self.folder = fs.LocalFileSystem(), parts.path if parts.scheme else folder
        else:
            import pyarrow.fs as fs

            self.fs, self.folder = fs.FileSystem.from_uri(folder)

    def path(self, name: str) -> str:
        return posixpath.join(self.folder, name)

    def create(self) -> None:
        self.fs.create_dir(self.folder, recursive=True)

    def writer(self, name: str):
        return self.fs.open_output_stream(self.path(name))

    def rename(self, old: str, new: str) -> None:
        self.fs.move(self.path(old), self.path(new))

    def numbers(self, name: str, kind: str) -> np.ndarray:
        if self.local:
            import os

            if os.path.getsize(self.path(name)) == 0:
                return np.zeros(0, kind)
            return np.memmap(self.path(name), kind, "r")
        with self.fs.open_input_stream(self.path(name)) as f:
            return np.frombuffer(f.read(), kind)

    def text(self, name: str) -> str:
        with self.fs.open_input_stream(self.path(name)) as f:
            return f.read().decode()


def write_tokens(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID
) -> dict:
    """Write the files of ``docs`` into ``folder`` and return the manifest (one entry per file)."""
    path = path or tokenizer_path(VOCABULARY)
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id)
    kind = "<u2" if largest < 1 << 16 else "<u4"
    Store(folder).create()

    def run(batches):
        store, encode = Store(folder), encoder(path).encode_all
        number = TaskContext.get().partitionId()
        mine, attempt = f"{number:05d}", uuid.uuid4().hex
        end = np.array([end_id], kind).tobytes()
        offsets, ids, crc = [np.zeros(1, np.int64)], [], 0
        names = {x: f"{mine}.{attempt}.{x}" for x in ("bin", "idx", "ids")}
        with store.writer(names["bin"]) as out:
            for pdf in blocks(batches):
                done = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in encode(list(pdf["text"]))]
                sizes = np.fromiter(map(len, done), np.int64, len(done)) // np.dtype(kind).itemsize
                offsets.append(offsets[-1][-1] + np.cumsum(sizes))
                ids.append(pdf["doc_id"].fillna(NO_ID).to_numpy(np.int64) if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy(np.int64))
                data = b"".join(done)
                crc = zlib.crc32(data, crc)
                out.write(data)
        n = sum(map(len, ids))
        if n:
            for x, numbers in (("idx", np.concatenate(offsets)), ("ids", np.concatenate(ids))):
                with store.writer(names[x]) as out:
                    out.write(numbers.astype("<i8").tobytes())
            for x in ("idx", "ids", "bin"):
                store.rename(names[x], f"{mine}.{x}")
            yield pd.DataFrame({"file": [mine], "documents": [n], "tokens": [int(offsets[-1][-1])], "crc32": [crc]})

    rows = (
        texts(docs, key, text)
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInPandas(run, "file string, documents long, tokens long, crc32 long")
        .toPandas()  # one row per file
        .sort_values("file")
    )
    files, base = [], 0
    for r in rows.itertuples():
        files.append({"file": r.file, "base": base, "documents": int(r.documents), "tokens": int(r.tokens), "crc32": int(r.crc32)})
        base += int(r.tokens)
    manifest = {"dtype": kind, "end_id": end_id, "tokens": base, "files": files}
    with Store(folder).writer("manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of ``folder``, one task per file."""
    manifest = json.loads(Store(folder).text("manifest.json"))
    kind = manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["files"]:
        return spark.createDataFrame([], schema)

    def run(batches):
        store = Store(folder)
        for pdf in batches:
            for file, base in zip(pdf["file"], pdf["base"]):
                data, at = store.numbers(f"{file}.bin", kind), store.numbers(f"{file}.idx", "<i8")
                ids = store.numbers(f"{file}.ids", "<i8")
                for k in range(0, len(ids), 10_000):
                    part = at[k : k + 10_001].astype(np.int64)
                    crc = [zlib.crc32(data[a:b].astype("<u4").tobytes()) for a, b in zip(part[:-1], part[1:])]
                    doc = pd.Series(ids[k : k + 10_000].astype(np.int64)).astype("Int64")
                    yield pd.DataFrame(
                        {"doc_id": doc.mask(doc == NO_ID), "start": base + part[:-1], "n_tokens": np.diff(part), "ids_crc32": crc}
                    )

    listed = spark.createDataFrame([(f["file"], f["base"]) for f in manifest["files"]], "file string, base long")
    return listed.repartition(len(manifest["files"]), "file").mapInPandas(run, schema)


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files (into the shared folder unless told otherwise) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, **options)
    return read_tokens(spark, folder)
