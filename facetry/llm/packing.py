"""Best-fit packing planned over the histogram of lengths.

Texts become pieces of at most ``room`` tokens.  Only the number of pieces of each length (at most ``room``
numbers) reaches the driver, where best-fit decreasing runs over counts: all open sequences with the same
free room are one entry, and whole runs of equal pieces are placed at once.  The plan says for every length
which ranks go to which run of sequences; pieces then take their slot by their rank within the length.

A null text is empty; an empty text is its end id alone.  Repeated rows are packed once each; a null id
stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, texts
from facetry.llm.tokens import encoder, tokenizer_path
from facetry.session import cut

ROOM = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Pieces are ranked in cells; a cell of the most frequent length holds about so many.
CELL_PIECES = 100_000


@dataclass
class Plan:
    """One row per run of equal pieces: ranks ``[rank, rank + n)`` of ``length`` go, ``per`` to a sequence, to
    the sequences from ``sequence`` on, the first at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    n: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank within the length."""
        # runs are stored by (length, rank), so the last run that starts at or before a piece holds it
        step = int(max(self.rank.max(initial=0), rank.max(initial=0))) + 1
        at = np.searchsorted(self.length * step + self.rank, length * step + rank, "right") - 1
        into = rank - self.rank[at]
        return self.sequence[at] + into // self.per[at], self.offset[at] + into % self.per[at] * length


def plan_best_fit(histogram: dict[int, int], room: int = ROOM) -> Plan:
    """Best-fit decreasing over counts."""
    free: list[int] = []  # free rooms with open sequences, ascending
    open_runs: dict[int, list[tuple[int, int]]] = {}  # free room -> [(first sequence, how many)]
    rows, sequences = [], 0

    def reopen(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if left not in open_runs:
                insort(free, left)
                open_runs[left] = []
            open_runs[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo > 0:
            i = bisect_left(free, length)
            if i < len(free):
                left = free[i]
                first, n = open_runs[left].pop()
                if not open_runs[left]:
                    del open_runs[left]
                    free.pop(i)
            else:
                # new sequences for all that is left of this length
                left, first = room, sequences
                n = -(-todo // (room // length))
                sequences += n
            per = left // length
            whole = min(n, todo // per)
            if whole:
                rows.append((length, rank, whole * per, per, first, room - left))
                reopen(left - per * length, first, whole)
                rank, todo, first, n = rank + whole * per, todo - whole * per, first + whole, n - whole
            if todo and n:  # fewer pieces than one more sequence takes
                rows.append((length, rank, todo, todo, first, room - left))
                reopen(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            reopen(left, first, n)
    columns = [np.array(c, np.int64) for c in zip(*sorted(rows))] if rows else [np.zeros(0, np.int64)] * 6
    return Plan(*columns, sequences)


def pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, room: int = ROOM
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    path = path or tokenizer_path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(path).encode_all
        for pdf in blocks(batches):
            rows = []
            for doc, ids in zip(pdf["doc_id"], encode(list(pdf["text"]))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = nullable_ids(out["doc_id"])
            yield out

    return texts(docs, key, text).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, room: int = ROOM
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; a sequence is filled from 0 without gaps up to ``room``."""
    parts = cut(pieces(docs, key, text, path, end_id, room))
    # ranks within a length: cells by hash, their sizes summed before, then a rank inside each cell
    cells = max(16, -(-parts.count() // CELL_PIECES))
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells))
    parts = parts.withColumn("_cell", cell)
    sizes = parts.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    totals = sizes.groupBy("length").agg(F.sum("_n").alias("n"))
    plan = plan_best_fit({r["length"]: r["n"] for r in totals.collect()}, room)  # at most ``room`` rows
    inside = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes.drop("_n"), ["length", "_cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def slots(batches):
        for pdf in batches:
            out = pdf.drop(columns="_rank")
            out["doc_id"] = nullable_ids(pdf["doc_id"])
            out["sequence_id"], out["offset"] = plan.place(pdf["length"].to_numpy(), pdf["_rank"].to_numpy())
            yield out

    return ranked.mapInPandas(
        slots, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
