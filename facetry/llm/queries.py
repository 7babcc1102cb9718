"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import hard_negatives, knn_quality, minhash, mixing, packing, pii, projections, rule_forest, secrets, suffix_dedup, token_files, toxicity, turn_repair
from facetry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add(fn) if fn else add


#: Exact near-duplicate groups: every pair of distinct sets that share a shingle is counted.
NEAR_GROUPS = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[k:k+2], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- one document per distinct set stands for its copies
c AS (SELECT doc_id, n, md5(string_agg(s, chr(10) ORDER BY s)) AS d FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY d, n) AS rep FROM c),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM r) AND b.doc_id IN (SELECT rep FROM r) GROUP BY 1, 2),
l AS (
  SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * common >= 85 * (a.n + b.n - common)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
reach AS (SELECT rep AS node, rep AS root FROM r UNION SELECT j, root FROM reach JOIN e ON i = node),
f AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(f.root, w.doc_id) AS component_id,
  w.doc_id = coalesce(f.root, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN f ON f.node = r.rep
"""
#: Exact links and groups of vectors: every pair of one label is compared.
NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT j, root FROM reach JOIN links ON i = vec_id),
found AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE i = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM found
"""


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query(sql=mixing.ORACLE_SQL)
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"))


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@query
def op4_knn_quality(spark: SparkSession, folder: str) -> DataFrame:
    return knn_quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_rule_forest(spark: SparkSession, folder: str) -> DataFrame:
    return rule_forest.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query(sql=NEAR_GROUPS)
def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(table(spark, folder, "documents"), size=3, percent=85)


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query(sql=NEAR_VECTORS)
def op10_sorted_projections(spark: SparkSession, folder: str) -> DataFrame:
    return projections.near_vectors(table(spark, folder, "embeddings"))


@query(sql=hard_negatives.ORACLE_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, label=label)


@query
def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair(table(spark, folder, "conversations"))


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
