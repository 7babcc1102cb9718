"""Session helpers: where iterative jobs cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so we refuse instead.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    chosen = sc._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="facetry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and return a scan of it.

    Used between rounds of iterative operators and for results with several consumers: lineage stays
    short, a lost executor costs one round, and the next plan sees the true size of the table (so
    joins are planned from measured sizes instead of estimates multiplied over the rounds).  The shuffle
    files behind the table are deleted once it is written; else all rounds' files stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/facetry/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for joins that deal both sides by key instead of sending one whole side through the driver.

    Spark takes the size of a scan from its files.  Ids and few distinct values pack so tightly there that millions of rows pass
    for a table small enough to broadcast.  Use it where the rows of a key are few, such as vertices and faces.
    """
    out = df.hint("merge")
    out._cut_path = getattr(df, "_cut_path", None)
    return out


def spread(df: DataFrame, rows: int = 4000) -> DataFrame:
    """``df`` dealt evenly to one task for every ``rows`` rows, for costly work on single rows.

    A scan is cut by bytes: narrow rows pack so tightly that one task would get millions of them.  Rows are counted, not
    estimated; a table that fits one task is left as it is.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` returned, once nothing that is still to run reads them.

    Anything else (a derived frame, a frame cut nowhere) is left alone.
    """
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            df._cut_path = None
