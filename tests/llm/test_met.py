"""Rows that cannot have a partner stay where they are; those that may have one are settled by an exact join."""

import pytest
from pyspark.sql import functions as F

from facetry.llm import minhash


def test_few_rows_pass_and_none_is_lost(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("tid"))
    keys = rows.filter(F.col("doc_id") % 100 == 7)
    got = minhash._met(rows, keys, ["doc_id", "tid"])
    assert got.columns == ["doc_id", "tid", "_met"]
    passed = {r.doc_id for r in got.filter("_met").collect()}
    assert got.count() == 5000 and {r.doc_id for r in keys.collect()} <= passed and len(passed) < 60


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_same_rows_stay_whatever_the_size_of_the_map(docs, words, monkeypatch):
    monkeypatch.setattr(minhash, "MAP_WORDS", words)
    groups = minhash._grouped_texts(docs, "doc_id", "text", 3, 85, minhash.MISS)
    gone = {(r.doc_id, r.tid) for r in groups.filter(~F.col("kept")).collect()}
    tid = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
    want = [tuple(r)[:-1] for r in docs.withColumn("_t", tid).collect() if (r.doc_id, r._t) not in gone]
    left = minhash.one_of_each_group(docs, size=3, percent=85)
    assert left.columns == docs.columns and sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want))
