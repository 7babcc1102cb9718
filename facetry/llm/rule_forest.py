"""Quality rules: rule statistics of every text, and an isolation forest over them.

Fixed rules fail texts of few words or much repetition.  On the rest an isolation forest decides: its
trees split the statistics of a bounded sample of well-labelled texts at random, a text that ends on
short paths is an anomaly, and the threshold on the anomaly score is calibrated on all labelled rows.

Null and empty texts have zero words and fail the base rules; a null id stays null; repeated rows give
repeated results; other columns are ignored.  Without labels the forest rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, texts
from facetry.llm.textscan import SPACE, Scan, mix, windows
from facetry.session import cut, forget

#: About so many rows are collected to fit the forest; all labelled rows calibrate it, as counts per level of the score.
FIT_ROWS, LEVELS = 8192, 10_000
TREES, SUBSAMPLE = 100, 256
#: Share of well-labelled rows that calibration must keep.
KEEP_GOOD = 0.995
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHAPE = ["n_chars", "n_lines", "n_upper", "n_digits", "n_marks"]


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?;:,.()[]{}\"'-_/\\@=+~^`")


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every (text, hash): whether an equal one exists, and whether an equal one comes earlier."""
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:][same]] = True
    some[order[1:][same]] = some[order[:-1][same]] = True
    return some, earlier


def measure(raw: list[bytes], window: int = 5) -> pd.DataFrame:
    """Counts of the base rules and further shape counts of each text."""
    scan, n = Scan(raw), len(raw)
    begin, end, doc = scan.words()
    dark = ~SPACE[scan.buf]
    lead = (scan.buf & 0xC0) != 0x80
    # every text is followed by a newline, so each newline ends one line
    line_end = np.flatnonzero(scan.buf == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    inked = np.concatenate([[0], np.cumsum(dark)])
    full = inked[line_end] > inked[line_begin]
    line_begin, line_end = line_begin[full], line_end[full]
    line_doc = scan.doc_of(line_begin)
    _, repeated = _again(line_doc, scan.hashes(line_begin, line_end))
    h, first = windows(scan.hashes(begin, end), doc, window)
    found, _ = _again(doc[first], h)
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, first[found], 1)
    np.add.at(step, first[found] + window, -1)
    covered = np.cumsum(step[:-1]) > 0
    count = lambda which: np.bincount(which, minlength=n)
    return pd.DataFrame(
        {
            "n_words": count(doc),
            "word_chars": scan.per_doc(lead & dark),
            "n_symbols": scan.per_doc(_SYMBOL[scan.buf]),
            "n_dup_lines": count(line_doc[repeated]),
            "n_repeat_words": count(doc[covered]),
            "n_chars": scan.per_doc(lead),
            "n_lines": count(line_doc),
            "n_upper": scan.per_doc(_UPPER[scan.buf]),
            "n_digits": scan.per_doc(_DIGIT[scan.buf]),
            "n_marks": scan.per_doc(_MARK[scan.buf]),
        }
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the counts of :func:`measure` for every row."""

    def run(batches):
        for pdf in blocks(batches):
            out = measure(list(pdf["text"]))
            out.insert(0, "doc_id", nullable_ids(pdf["doc_id"]))
            yield out

    columns = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS, *SHAPE))
    return texts(docs, key, text, binary=True).mapInPandas(run, columns)


def features(stats: pd.DataFrame) -> np.ndarray:
    words, chars = np.maximum(stats["n_words"], 1), np.maximum(stats["n_chars"], 1)
    lines = np.maximum(stats["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(stats["word_chars"] / words),
            np.log1p(100 * stats["n_symbols"] / chars),
            stats["n_dup_lines"] / lines,
            stats["n_repeat_words"] / words,
            np.log1p(100 * stats["n_upper"] / chars),
            np.log1p(100 * stats["n_digits"] / chars),
            np.log1p(100 * stats["n_marks"] / chars),
            np.log1p(words / lines),
        ]
    ).astype(float)


def _usual_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, n - 1)


@dataclass
class Forest:
    """Complete binary trees as arrays: the split feature (-1 at leaves), its value, the path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    usual: float
    threshold: float = 1.0

    @staticmethod
    def fit(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 0) -> Forest:
        rng = np.random.default_rng(seed)
        size = max(2, min(subsample, len(x)))
        depth = int(np.ceil(np.log2(size)))
        nodes = 2 ** (depth + 1) - 1
        feature, value = np.full((trees, nodes), -1), np.zeros((trees, nodes))
        length = np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), min(size, len(x)), replace=False)])]
            while todo:
                node, level, rows = todo.pop()
                spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) else []
                if level == depth or len(rows) < 2 or not len(spread):
                    length[t, node] = level + _usual_depth(len(rows))
                    continue
                f = rng.choice(spread)
                cut_at = rng.uniform(rows[:, f].min(), rows[:, f].max())
                feature[t, node], value[t, node] = f, cut_at
                left = rows[:, f] <= cut_at
                todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
        return Forest(feature, value, length, float(_usual_depth(size)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): near 1 for texts that few random splits set apart."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        levels = int(np.log2(self.feature.shape[1] + 1)) - 1
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(x), int)
            for _ in range(levels):
                f = feature[node]
                child = 2 * node + 1 + (x[row, np.maximum(f, 0)] > value[node])
                node = np.where(f >= 0, child, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))

    def calibrate(self, x: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> Forest:
        """Set the threshold from labelled rows at hand."""
        level, of_row = np.unique(score_levels(self.score(x)), return_inverse=True)
        kept, gone = (np.bincount(of_row[pick], minlength=len(level)) for pick in (good, ~good))
        return self.calibrate_counts(level, kept, gone, keep_good)

    def calibrate_counts(self, level: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> Forest:
        """Set the threshold of best balanced accuracy among those that keep ``keep_good`` of the good rows.

        ``good`` and ``bad`` count the rows at each level of the score, in ascending order.
        """
        if not good.sum() or not bad.sum():
            self.threshold = 1.0
            return self
        kept, missed = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
        gain = np.where(kept >= keep_good, kept - missed, -np.inf)
        self.threshold = float(level[np.argmax(gain)]) / LEVELS
        return self


def score_levels(score: np.ndarray) -> np.ndarray:
    """Scores rounded up to whole parts of ``1 / LEVELS``."""
    return np.ceil(score * LEVELS).astype(np.int64)


def base_failed(stats: pd.DataFrame) -> pd.Series:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def _sample(stats: DataFrame, rows: int) -> pd.DataFrame:
    """About ``rows`` of the distinct rows, by a share of the hash range that follows from their number."""
    columns = ["doc_id", *COUNTS, *SHAPE]
    total = stats.count()
    place = F.xxhash64(*columns) / F.lit(2.0**64) + 0.5
    some = stats.select(columns).filter(place <= min(1.0, rows / max(total, 1))).distinct().toPandas()
    return some.sort_values(columns, ignore_index=True)


def fit_forest(stats: DataFrame, labels: DataFrame | None, key: str = "doc_id") -> Forest:
    """Fit on a bounded sample of well-labelled rows (of any rows if there are none), calibrate on all labelled rows."""
    marked = None
    if labels is not None:
        mark = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull())
        mark = mark.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        # the forest decides on the rest only
        marked = cut(stats.join(mark, "doc_id").filter(~failed).withColumn("good", F.col("quality") == 1).drop("quality"))
    rows = None if marked is None else _sample(marked.filter("good"), FIT_ROWS)
    if rows is None or not len(rows):
        rows = _sample(stats, FIT_ROWS)
        return Forest.fit(features(rows)) if len(rows) else Forest.fit(np.zeros((2, 8)))
    forest = Forest.fit(features(rows))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"level": score_levels(forest.score(features(pdf))), "good": pdf["good"]})

    # at most LEVELS rows of each label reach the driver
    counts = marked.mapInPandas(run, "level long, good boolean").groupBy("level").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    ).orderBy("level").toPandas()
    forget(marked)
    return forest.calibrate_counts(counts["level"].to_numpy(), counts["good"].to_numpy(), counts["bad"].to_numpy())


def judge(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, the anomaly score and ``kept`` of every row."""
    stats = cut(statistics(docs, key, text))
    forest = fit_forest(stats, labels)

    def run(batches):
        for pdf in batches:
            out = pdf[["doc_id", *COUNTS]].copy()
            out["doc_id"] = nullable_ids(pdf["doc_id"])
            out["base_failed"] = base_failed(pdf)
            out["anomaly"] = forest.score(features(pdf)) if len(pdf) else np.zeros(0)
            out["kept"] = ~out["base_failed"] & (out["anomaly"] <= forest.threshold)
            yield out

    columns = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS))
    return stats.mapInPandas(run, f"{columns}, base_failed boolean, anomaly double, kept boolean")
