"""Hard-negative mining by a secondary sort of pair scores.

Anchors meet all rows block by block.  A row is shuffled once per block of anchors and an anchor once per stripe of
rows; inside a partition the anchors of a cell come first, so its rows stream past them as matrix products and only
the pairs that can still matter leave the task: the best positives of each anchor in the stripe, then the best
negatives within each positive's window.  These pairs are shuffled by anchor and sorted within partitions by
``(anchor, descending score, positives first, id)``.  One iterator over a partition opens a window at each positive and
emits the negatives that fall into open windows; it holds the windows of one anchor (``positives`` of them) and nothing else.

Scores are exact integers: components become ``floor(scale * x)`` and products run in double precision while
every sum stays below 2**53, in Python integers otherwise (there, scores beyond 9e16 count as 9e16).

Null labels, null vectors and vectors with a null or non-finite component take no part.  Vectors of different
lengths are never compared.  Rows equal in id, label and vector count once; different rows under one id are rows of
their own, but never each other's positives or negatives.  A null id takes part, comes last among equal scores, and
is never an anchor.  An empty table, or one without anchors, gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import cut

#: Anchors that a task holds at once.
ANCHORS = 4096
#: Parts that the rows are dealt into for each block of anchors: what a stripe sends on is bounded per anchor, so the
#: number of pairs shuffled grows with the anchors, not with anchors times rows.
STRIPES = 16
#: Pairs scored by one matrix product.
PAIRS = 1 << 21
_EXACT = 2.0**53
_MOST = 9 * 10**16


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors (rows of ``a`` by rows of ``b``) as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    x, y = a.astype(float), b.astype(float)
    if np.abs(x).max() * np.abs(y).max() * a.shape[1] < _EXACT:
        return (x @ y.T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def leading(group: np.ndarray, score: np.ndarray, nameless: np.ndarray, row_id: np.ndarray, mark: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` entries of each group by descending score, then id."""
    order = np.lexsort((mark, row_id, nameless, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]


def _at_least(masked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all entries that reach the ``k``-th largest of their row (ties included); ``-_MOST * 2`` is no entry."""
    k = min(k, masked.shape[1])
    least = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
    return np.nonzero((masked >= least[:, None]) & (masked > -2 * _MOST))


class _Cell:
    """One block of anchors and the pairs of the stripe that may still count."""

    def __init__(self, keep: int, low: int, high: int, windows: bool):
        self.keep, self.low, self.high, self.windows = keep, low, high, windows
        self.parts: list[pd.DataFrame] = []
        self.anchors: pd.DataFrame | None = None
        self.found: list[np.ndarray] = []
        self.held = 0

    def seal(self) -> None:
        self.anchors = pd.concat(self.parts, ignore_index=True) if self.parts else None
        self.held = 0
        if self.anchors is not None:
            self.by_size = {}
            sizes = self.anchors["q"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                self.by_size[d] = (at, np.array(self.anchors["q"].iloc[at].tolist(), np.int64).reshape(len(at), d))

    def meet(self, rows: pd.DataFrame) -> None:
        sizes = rows["q"].map(len).to_numpy()
        for d in np.unique(sizes):
            if d not in self.by_size:
                continue
            at, a = self.by_size[d]
            part = rows.iloc[np.flatnonzero(sizes == d)]
            step = max(1, PAIRS // len(at))
            for i in range(0, len(part), step):
                self._score(at, a, part.iloc[i : i + step], d)

    def _score(self, at: np.ndarray, a: np.ndarray, rows: pd.DataFrame, d: int) -> None:
        q = np.array(rows["q"].tolist(), np.int64).reshape(len(rows), d)
        score = products(a, q)
        nameless = rows["id"].isna().to_numpy()
        ids = rows["id"].fillna(0).to_numpy(np.int64)
        mark = rows["mark"].to_numpy(np.int64)
        same = self.anchors["label"].to_numpy()[at][:, None] == rows["label"].to_numpy()[None, :]
        other = (self.anchors["id"].to_numpy(np.int64)[at][:, None] != ids[None, :]) | nameless[None, :]
        none = -2 * _MOST
        if not self.windows:
            self._keep(at, 0, np.where(same & other, score, none), nameless, ids, mark)
            return
        tops = self.anchors["tops"].iloc[at]
        for j in range(tops.map(len).max()):
            top = np.array([t[j] if j < len(t) else -1 for t in tops], np.int64)[:, None]
            inside = ~same & other & (100 * score >= self.low * top) & (100 * score <= self.high * top)
            self._keep(at, j, np.where(inside, score, none), nameless, ids, mark)

    def _keep(self, at, window, masked, nameless, ids, mark) -> None:
        r, c = _at_least(masked, self.keep)
        slots = at[r] * 64 + window
        self.found.append(np.stack([slots, masked[r, c], nameless[c].astype(np.int64), ids[c], mark[c]]))
        self.held += len(r)
        if self.held > PAIRS:
            self._compact()

    def _compact(self) -> None:
        every = np.concatenate(self.found, axis=1)
        self.found = [every[:, leading(*every, self.keep)]]
        self.held = self.found[0].shape[1]

    def rows(self) -> pd.DataFrame | None:
        if not self.found:
            return None
        self._compact()
        slot, score, nameless, ids, mark = self.found[0]
        # a row that lies in several windows of an anchor is one pair
        pair = np.unique(np.stack([slot // 64, score, nameless, ids, mark]), axis=1)
        if not pair.shape[1]:
            return None
        who = self.anchors.iloc[pair[0]]
        out = pd.DataFrame({"anchor_id": who["id"].to_numpy(np.int64), "anchor_mark": who["mark"].to_numpy(np.int64)})
        out["score"], out["mark"] = pair[1], pair[4]
        out["id"] = pd.Series(pair[3], dtype="Int64").mask(pair[2] == 1)
        return out


def _meet(keep: int, low: int, high: int, windows: bool):
    """Kernel over rows sorted by cell, anchors first."""

    def run(batches):
        at, cell = None, None
        for pdf in batches:
            key = pdf["block"].to_numpy(np.int64) * STRIPES + pdf["stripe"].to_numpy(np.int64)
            edges = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(pdf)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if key[begin] != at:
                    if cell is not None and (out := cell.rows()) is not None:
                        yield out
                    at, cell = key[begin], _Cell(keep, low, high, windows)
                part = pdf.iloc[begin:end]
                is_row = part["kind"].to_numpy() == 1
                if not is_row.all():
                    cell.parts.append(part[~is_row])
                if is_row.any():
                    if cell.anchors is None and cell.parts:
                        cell.seal()
                    if cell.anchors is not None:
                        cell.meet(part[is_row])
        if cell is not None and (out := cell.rows()) is not None:
            yield out

    return run


_PAIR = "anchor_id long, anchor_mark long, score long, mark long, id long"


def _pairs(rows: DataFrame, anchors: DataFrame, blocks: int, keep: int, low: int, high: int, windows: bool) -> DataFrame:
    """Pairs that may count, from every (block of anchors, stripe of rows)."""
    tops = F.col("tops") if windows else F.lit(None).cast("array<long>")
    left = anchors.select(
        F.pmod("mark", F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))).alias("stripe"),
        F.lit(0).alias("kind"), "id", "label", "q", "mark", tops.alias("tops"),
    )
    right = rows.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.shiftright("mark", 32), F.lit(STRIPES)).cast("int").alias("stripe"),
        F.lit(1).alias("kind"), "id", "label", "q", "mark", F.lit(None).cast("array<long>").alias("tops"),
    )
    dealt = left.unionByName(right).repartition("block", "stripe").sortWithinPartitions("block", "stripe", "kind")
    return dealt.mapInPandas(_meet(keep, low, high, windows), _PAIR)


def _emit(negatives: int, low: int, high: int):
    """Streaming iterator over sorted pairs: windows open at positives, negatives go to the windows they fall into."""

    def run(batches):
        anchor, windows = None, []
        for pdf in batches:
            out = []
            named = pdf["id"].notna().to_numpy()
            ids = pdf["id"].fillna(0).to_numpy(np.int64)
            columns = [pdf[c].to_numpy(np.int64).tolist() for c in ("anchor_id", "anchor_mark", "kind", "score")]
            for a, m, kind, score, row_id, has in zip(*columns, ids.tolist(), named.tolist()):
                if (a, m) != anchor:
                    anchor, windows = (a, m), []
                row_id = row_id if has else None
                if kind == 0:
                    windows.append([row_id, score, 0])
                    continue
                for w in windows:
                    if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((a, w[0], w[2], row_id, w[1], score))
            if out:
                a, p, rank, n, ps, ns = zip(*out)
                yield pd.DataFrame(
                    {"anchor_id": a, "positive_id": pd.Series(p, dtype="Int64"), "rank": rank,
                     "negative_id": pd.Series(n, dtype="Int64"), "positive_score": ps, "negative_score": ns}
                )

    return run


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each anchor (a row with an id where ``is_anchor`` holds) and each of its first ``positives`` other rows of the same
    label: the first ``negatives`` rows of another label whose score lies between ``low`` and ``high`` percent of the
    positive's.  At most 64 positives.
    """
    if positives > 64:
        raise ValueError("at most 64 positives per anchor")
    label = F.col(label) if isinstance(label, str) else label
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    taken = vectors.filter(label.isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"),
        F.coalesce(is_anchor & F.col(key).isNotNull(), F.lit(False)).alias("anchor"),
    )
    rows = cut(taken.dropDuplicates(["id", "label", "q"]).withColumn("mark", F.xxhash64("id", "label", "q")))
    anchors = rows.filter("anchor")
    blocks = max(1, math.ceil(anchors.count() / ANCHORS))

    best = Window.partitionBy("anchor_id", "anchor_mark").orderBy(F.desc("score"), F.asc_nulls_last("id"), "mark")
    first = _pairs(rows, anchors, blocks, positives, low, high, False)
    chosen = cut(first.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).drop("place"))
    tops = chosen.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_mark").alias("mark")).agg(
        F.sort_array(F.collect_list("score"), asc=False).alias("tops")
    )
    opened = anchors.join(tops, ["id", "mark"])
    second = _pairs(rows, opened, blocks, negatives, low, high, True)
    sorted_pairs = (
        chosen.withColumn("kind", F.lit(0))
        .unionByName(second.withColumn("kind", F.lit(1)))
        .repartition("anchor_id", "anchor_mark")
        .sortWithinPartitions("anchor_id", "anchor_mark", F.desc("score"), "kind", F.asc_nulls_last("id"), "mark")
    )
    return sorted_pairs.mapInPandas(
        _emit(negatives, low, high),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )


#: The same rows by a plain join of anchors and rows.
ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
