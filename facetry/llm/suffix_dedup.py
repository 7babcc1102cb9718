"""Removal of repeated byte strings with distributed two-stage suffix sorting.

A string of ``length`` bytes is repeated if the same string starts earlier, in a document of smaller id or
earlier in the same document.

* Each window of ``length`` bytes has an anchor: its leftmost 24-byte string of smallest hash.  Equal windows
  have equal anchors, so windows meet by anchor: runs of windows with a common anchor form one segment, and
  segments whose anchor occurs once are dropped.
* Segments of equal content form classes.  All windows of all members but the first are repeated.
* First members of different classes that share an anchor are compared window by window: their bytes are put
  into blocks of bounded size, and the suffixes of a block are sorted in two stages: those smaller than their
  successor directly, the others by one scan over the buckets.  Adjacent suffixes with a common prefix of
  ``length`` bytes are equal windows; all but the earliest are repeated.
* An anchor with more classes than fit a block is taken apart into windows, which meet by content hash.

A null text is empty.  Null ids come before all others.  Rows of equal id and text are one document given several
times: none is earlier than the other.  Different texts under one id, or under none, are documents of their own,
in the order of a hash of the text, and a span is only removed from the text it was found in.  Texts shorter than
``length`` stay whole.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, sha256, texts
from facetry.llm.textscan import U64, Scan, mix
from facetry.session import cut, forget

LENGTH = 100
ANCHOR = 24
#: Bytes of segments whose suffixes are sorted together, and classes of one anchor that may share a block.
SORT_BYTES = 1 << 20
MOST_CLASSES = 4096
#: ``start`` and the number of windows in one integer.
_N = 1 << 12
NO_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(raw: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``(text number, start, windows, anchor hash, content hash)`` of every run of windows with one anchor."""
    scan = Scan(raw)
    size = len(scan.buf)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none, none
    at = np.arange(size - anchor + 1)
    h = scan.hashes(at, at + anchor)
    # the high half of the hash, then the position: the smallest key is the leftmost smallest hash
    key = (h & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    place = (_sliding_min(key, length - anchor + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    window = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(scan.starts, scan.ends)] or [none])
    if not len(window):
        return none, none, none, none, none
    place = place[window]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
    n = np.diff(np.r_[first, len(window)])
    begin, doc = window[first], scan.doc_of(window[first])
    content = scan.hashes(begin, begin + n + length - 1)
    return doc, begin - scan.starts[doc], n, h[place[first]].view(np.int64), mix(content + U64(7)).view(np.int64)


def two_stage_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text``, exact up to the first ``depth`` bytes of each suffix."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller than the successor: the next different byte is larger (the end counts as smaller than all)
    ends = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]
    up = np.r_[text[ends[:-1]] < text[ends[:-1] + 1], False]
    smaller = np.repeat(up, np.diff(np.r_[-1, ends]))
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = sliding_window_view(padded, depth)
    direct = np.flatnonzero(smaller)
    strings = np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(strings, kind="stable")]
    of_byte = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = waiting[c]
        fresh = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found = [fresh]
        while len(fresh):  # runs of one byte
            fresh = fresh[fresh > 0] - 1
            fresh = fresh[text[fresh] == c]
            found.append(fresh)
        bucket = np.concatenate([*found, direct[of_byte[c] : of_byte[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        for d in np.unique(text[before]):
            waiting[d].append(before[text[before] == d])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``depth`` bytes; 0 for the first."""
    view = sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 1 << 15):
        a, b = view[order[s - 1 : s - 1 + (1 << 15)]], view[order[s : s + (1 << 15)]]
        other = a[: len(b)] != b
        out[s : s + len(b)] = np.where(other.any(1), other.argmax(1), depth)
    return out


def repeated_windows(ids: np.ndarray, starts: np.ndarray, n: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Windows of the segments that also start earlier, in this block: ``(id, start)`` of each."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8)
    base = np.cumsum(sizes) - sizes
    order = two_stage_sort(text, length)
    segment = np.searchsorted(base, order, "right") - 1
    offset = order - base[segment]
    whole = offset < n[segment]
    order, segment, offset = order[whole], segment[whole], offset[whole]
    new_group = np.flatnonzero(common_prefixes(text, order, length) < length)
    place = np.empty(len(order), np.int64)
    doc, start = ids[segment], starts[segment] + offset
    by_place = np.lexsort((start, doc))
    d, s = doc[by_place], start[by_place]
    place[by_place] = np.cumsum(np.r_[0, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]) if len(d) else 0
    if not len(place):
        return doc, start
    least = np.repeat(np.minimum.reduceat(place, new_group), np.diff(np.r_[new_group, len(place)]))
    return doc[place > least], start[place > least]


def _runs(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Windows as runs ``(id, start, n)``."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]) if len(doc) else []
    last = np.r_[first[1:], len(doc)].astype(int) - 1 if len(doc) else []
    return pd.DataFrame({"id": doc[first], "start": start[first], "n": start[last] - start[first] + 1}) if len(doc) else None


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text, id, tie)``: ``id`` and ``tie`` name a text; ``tie`` is 0 where the id has no other text."""
    body = texts(docs, key, text, binary=True).withColumn("_h", F.xxhash64("text"))
    several = body.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    # written before it is joined: mostly empty, so that the texts need not move
    several = cut(several.filter(F.col("_a") != F.col("_b")).select("doc_id", F.lit(True).alias("_several")))
    body = body.join(several, "doc_id", "left")
    tie = F.when(F.col("doc_id").isNull() | F.col("_several"), F.col("_h")).otherwise(F.lit(0)).cast("long")
    return body.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), tie.alias("tie"))


def _first_bytes(firsts: DataFrame, body: DataFrame, length: int) -> DataFrame:
    """``(hash, id, start, n, bytes)`` of the segments ``(hash, id, tie, start, n)``, with ``tie``."""
    lists = firsts.groupBy("id", "tie").agg(F.collect_list(F.struct("hash", "start", "n")).alias("parts"))

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, tie, text, parts in zip(pdf["id"], pdf["tie"], pdf["text"], pdf["parts"]):
                for p in parts:
                    part = text[p["start"] : p["start"] + p["n"] + length - 1]
                    if len(part) == p["n"] + length - 1:
                        rows.append((p["hash"], doc, tie, p["start"], p["n"], part))
            yield pd.DataFrame(rows, columns=["hash", "id", "tie", "start", "n", "bytes"])

    body = body.select("id", "tie", "text")
    return body.join(lists, ["id", "tie"]).mapInPandas(run, "hash long, id long, tie long, start long, n long, bytes binary")


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the segments of each anchor, as runs; an anchor's segments fit one block."""

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if pdf["bytes"].map(len).sum() < SORT_BYTES:
                held = pdf
                continue
            ended = (pdf["hash"] != pdf["hash"].iloc[-1]).to_numpy()
            yield from done(pdf[ended])
            held = pdf[~ended]
        if held is not None:
            yield from done(held)

    def done(pdf):
        if len(pdf):
            # the documents of the block by their rank in the order of id and tie
            names = pdf[["id", "tie"]].drop_duplicates().sort_values(["id", "tie"])
            rank = pd.MultiIndex.from_frame(names).get_indexer(pd.MultiIndex.from_frame(pdf[["id", "tie"]]))
            args = (pdf[c].to_numpy(np.int64) for c in ("start", "n"))
            found = _runs(*repeated_windows(rank, *args, list(pdf["bytes"]), length))
            if found is not None:
                at = found["id"].to_numpy()
                yield found.assign(id=names["id"].to_numpy()[at], tie=names["tie"].to_numpy()[at])

    return rows.repartition("hash").sortWithinPartitions("hash").mapInPandas(run, "id long, tie long, start long, n long")


def _by_content(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes: every window meets its equals by content hash."""

    def run(batches):
        for pdf in blocks(batches, "bytes", 1 << 18):
            scan = Scan(list(pdf["bytes"]))
            n = pdf["n"].to_numpy(np.int64)
            row = np.repeat(np.arange(len(pdf)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = scan.starts[row] + offset
            h = scan.hashes(begin, begin + length)
            yield pd.DataFrame(
                {
                    "c1": h.view(np.int64),
                    "c2": pdf["hash"].to_numpy(np.int64)[row],
                    "id": pdf["id"].to_numpy(np.int64)[row],
                    "tie": pdf["tie"].to_numpy(np.int64)[row],
                    "start": pdf["start"].to_numpy(np.int64)[row] + offset,
                }
            )

    windows = rows.mapInPandas(run, "c1 long, c2 long, id long, tie long, start long")
    first = windows.groupBy("c1", "c2").agg(F.min(F.struct("id", "tie", "start")).alias("_first"))
    later = windows.join(first, ["c1", "c2"]).filter(F.struct("id", "tie", "start") > F.col("_first"))
    return later.select("id", "tie", "start", F.lit(1).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, most_classes: int = MOST_CLASSES) -> DataFrame:
    """Runs ``(id, tie, start, n)`` of repeated windows: bytes ``start`` to ``start + n + length - 1`` are to go."""
    body = _documents(docs, key, text)

    def run(batches):
        for pdf in blocks(batches):
            doc, start, n, h, content = segments(list(pdf["text"]), length)
            ids, ties = (pdf[c].to_numpy(np.int64)[doc] for c in ("id", "tie"))
            yield pd.DataFrame({"hash": h, "content": content, "id": ids, "tie": ties, "place": start * _N + n})

    long_enough = body.filter(F.length("text") >= length).select("id", "tie", "text")
    found = long_enough.mapInPandas(run, "hash long, content long, id long, tie long, place long")
    # written before it is joined, so that both sides come straight from a shuffle and a hot anchor can be split
    often = cut(found.groupBy("hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).drop("_n"))
    met = cut(found.join(often, "hash"))
    same = ["hash", "content"]
    # the number of windows is part of the content: equal content has equal length
    classes = cut(met.groupBy(*same).agg(F.min(F.struct("id", "tie", "place")).alias("_first")))
    copies = met.join(classes, same).filter(F.struct("id", "tie", "place") > F.col("_first"))
    copies = copies.select("id", "tie", F.floor(F.col("place") / _N).alias("start"), (F.col("place") % _N).alias("n"))
    per_anchor = cut(classes.groupBy("hash").agg(F.count("*").alias("classes")).filter(F.col("classes") > 1))
    firsts = classes.join(per_anchor, "hash").select(
        "hash",
        F.col("_first.id").alias("id"),
        F.col("_first.tie").alias("tie"),
        F.floor(F.col("_first.place") / _N).alias("start"),
        (F.col("_first.place") % _N).alias("n"),
    )
    rows = cut(_first_bytes(firsts, body, length))
    forget(often, per_anchor)
    large = rows.groupBy("hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > most_classes).select("hash")
    compared = _compare(rows.join(large, "hash", "left_anti"), length)
    taken_apart = _by_content(rows.join(large, "hash", "left_semi"), length)
    out = cut(copies.unionByName(compared).unionByName(taken_apart))
    forget(met, classes, rows)
    return out


def _remaining(text: bytes, parts, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left."""
    removed, runs, left, done = 0, 0, [], 0
    begin = end = -1
    for p in sorted((p["start"], p["n"]) for p in parts):
        if p[0] >= len(text):
            break
        if p[0] > end or begin < 0:
            if begin >= 0:
                left.append(text[done:begin])
                removed, runs, done = removed + end - begin, runs + 1, end
            begin, end = p[0], min(len(text), p[0] + p[1] + length - 1)
        else:
            end = max(end, min(len(text), p[0] + p[1] + length - 1))
    if begin >= 0:
        left.append(text[done:begin])
        removed, runs, done = removed + end - begin, runs + 1, end
    left.append(text[done:])
    return removed, runs, b"".join(left)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) of every row."""
    spans = repeated_spans(docs, key, text, length)
    lists = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    body = _documents(docs, key, text)

    def run(batches):
        for pdf in batches:
            done = [_remaining(t, () if p is None else p, length) for t, p in zip(pdf["text"], pdf["parts"])]
            yield pd.DataFrame(
                {
                    "doc_id": nullable_ids(pdf["doc_id"]),
                    "n_bytes": pdf["text"].map(len),
                    "n_removed": [d[0] for d in done],
                    "n_spans": [d[1] for d in done],
                    "kept_sha256": [sha256(d[2]) for d in done],
                    "kept": [d[2] for d in done],
                }
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return body.join(lists, ["id", "tie"], "left").select("doc_id", "text", "parts").mapInPandas(run, schema)
