"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent semantic space.

Terms are pairs of adjacent character classes, so any language and any junk has some.  A bounded sample of
labelled rows gives term weights, a truncated singular value decomposition and the labelled vectors; these
(at most ``PER_CLASS`` per label, ``RANK`` numbers each) go to every task.  Every document is projected and
its cosines with all labelled vectors are computed as one matrix product per block.

A text without any term (null or empty) gets the share of label 1 as its score.  A null id stays null and
is never held out; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, texts
from facetry.llm.textscan import Scan

#: Bound of the labelled sample, for each of the two labels.
PER_CLASS = 2000
RANK = 64
NEIGHBOURS = 25
#: Similarities are raised to this power before they weight a label.
SHARPNESS = 8
#: Rows of the sample that are weighted at once.
_FIT_ROWS = 256

_MARKS = ".,!?|#$%&*<>:;\"'-()/=+@_"


def _classes() -> np.ndarray:
    """Class of every byte: letters apart, capitals, digits, blanks, marks, other; 0 ends a text."""
    out = np.full(256, 1, np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(2, 28)
    out[ord("A") : ord("Z") + 1] = 28
    out[ord("0") : ord("9") + 1] = 29
    out[ord(" ")] = 30
    out[ord("\n")] = 31
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 32 + i
    out[0xC0:] = 32 + len(_MARKS)
    out[0x80:0xC0] = 33 + len(_MARKS)
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
TERMS = _N * _N


def counts(raw: list[bytes]) -> np.ndarray:
    """Occurrences of each pair of classes in each text; texts x TERMS."""
    scan = Scan(raw)
    c = _CLASS[scan.buf]
    doc = np.repeat(np.arange(len(raw)), scan.lengths + 1)
    pair = doc[1:] * TERMS + c[:-1] * _N + c[1:]
    inside = doc[1:] == doc[:-1]
    inside &= np.arange(1, len(doc)) < scan.ends[doc[1:]]
    flat = np.bincount(pair[inside], minlength=len(raw) * TERMS)
    return flat.reshape(len(raw), TERMS).astype(np.float32)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as the places of its terms, then their counts: most terms are absent from a text."""
    at = [np.flatnonzero(row) for row in x]
    return [a.astype("<u2").tobytes() + row[a].astype("<f4").tobytes() for a, row in zip(at, x, strict=True)]


def unpacked(rows: Sequence[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for row, raw in zip(out, rows, strict=True):
        n = len(raw) // 6
        row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    each: np.ndarray
    prior: float

    @staticmethod
    def fit(x: np.ndarray, label: np.ndarray, rank: int = RANK, seed: int = 0, overwrite: bool = False) -> Model:
        """Term weights, basis by randomised subspace iteration, and the labelled vectors.

        With ``overwrite`` the weighted unit rows take the place of ``x``, so that the sample is held once.
        """
        n = len(x)
        weight = np.log((1.0 + n) / (1.0 + (x > 0).sum(0))).astype(np.float32) + 1.0 if n else np.ones(TERMS, np.float32)
        terms = x if overwrite else np.empty_like(x)
        for i in range(0, n, _FIT_ROWS):
            part = slice(i, i + _FIT_ROWS)
            terms[part] = _unit(np.log1p(x[part]) * weight)
        rank = max(1, min(rank, n))
        start = np.random.default_rng(seed).standard_normal((TERMS, rank + 10)).astype(np.float32)
        q = np.linalg.qr(terms.T @ (terms @ start))[0]
        for _ in range(3):
            q = np.linalg.qr(terms.T @ (terms @ q))[0]
        _, _, v = np.linalg.svd(terms @ q, full_matrices=False)
        basis = (q @ v.T[:, :rank]).astype(np.float32)
        share = float(label.mean()) if n else 1.0
        # both labels weigh the same in a vote, however many rows of each were sampled
        each = np.where(label == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        return Model(weight, basis, _unit(terms @ basis), label.astype(np.float64), each, share)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.vectors) or not len(x):
            return out
        latent = _unit(_unit(np.log1p(x) * self.weight) @ self.basis)
        cosine = latent @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** SHARPNESS * self.each[near]
        total = vote.sum(1)
        some = total > 0
        out[some] = np.clip((vote * self.label[near]).sum(1)[some] / total[some], 0.0, 1.0)
        return out


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Model of a bounded labelled sample: the ``per_class`` rows of each label that come first by hash of the id."""
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    marked = marked.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marked.filter(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])

    def run(batches):
        for pdf in blocks(batches):
            x = counts(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": packed(x)})

    # at most 2 * per_class ids: a bounded side
    picked = texts(docs, key, text, binary=True).join(F.broadcast(sample), "doc_id")
    rows = picked.mapInPandas(run, "doc_id long, quality int, x binary").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values("doc_id")
    return Model.fit(unpacked(rows.pop("x")), rows["quality"].to_numpy(float), overwrite=True)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = fit_model(docs, labels, key, text, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in blocks(batches, limit=1 << 20):
            score = shared.value.score(counts(list(pdf["text"])))
            yield pd.DataFrame({"doc_id": nullable_ids(pdf["doc_id"]), "score": score})

    scored = texts(docs, key, text, binary=True).mapInPandas(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the vote accepts, with all columns; the model is fit on ``labelled`` (or ``docs``)."""
    model = fit_model(docs if labelled is None else labelled, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(body: pd.Series) -> pd.Series:
        parts = [shared.value.score(counts(list(part["text"]))) for part in blocks([pd.DataFrame({"text": body})], limit=1 << 20)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.filter(score(body) >= 0.5)
