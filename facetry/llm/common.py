"""What the operators of this subpackage share: inputs, batches of bounded size, span text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts are long, so batches are counted in documents, not in tens of thousands.
BATCH_ROWS = 512
#: Bytes a kernel works on at once (one longer text makes a block of its own).
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; the setting is read when a plan is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text", binary: bool = False) -> DataFrame:
    """``(doc_id, text)`` and nothing else, whatever other columns there are; a null text is empty."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), (body.cast("binary") if binary else body).alias("text"))


def blocks(batches: Iterable[pd.DataFrame], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """Cut batches further so that no block holds much more than ``limit`` characters or bytes."""
    for pdf in batches:
        begin, held = 0, 0
        for i, n in enumerate(map(len, pdf[column])):
            if held and held + n > limit:
                yield pdf.iloc[begin:i]
                begin, held = i, 0
            held += n
        if begin < len(pdf):
            yield pdf.iloc[begin:]


def span_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def nullable_ids(ids: Iterable) -> pd.Series:
    """Document ids as a nullable integer column: a null id stays null instead of turning the column to floats."""
    return pd.Series([None if pd.isna(i) else int(i) for i in ids], dtype="Int64")
