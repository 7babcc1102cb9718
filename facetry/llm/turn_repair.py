"""Conversation repair by rank-convergence parallel Viterbi.

A conversation is a sequence of rows, and the cheapest edits that give it the roles ``(s?(ua)+)?`` are a shortest path
through four states: nothing yet, after the opening system row, after a user row, after an assistant row.  One row
turns the costs to go from its states into those before it, a min-plus product, and such products forget where they
started: after a few rows two vectors differ only by a constant.

So rows are dealt by range into their order and cut into chunks of at most ``2**bits`` rows, which run side by side from
the back: the last chunk of a conversation starts from the true end costs, every other one from a speculative vector.  In a
fix-up pass a chunk whose successor ended on another vector (constants aside) than the chunk had started from runs again, only
until its new vector differs from its old one by a constant.  When no chunk is left to run, every chunk is traced from each
state it may be entered in, taking the ASCII-least edit among the cheapest; a pass in order stitches the traces.

Rows come by turn (nulls first), then role, then text.  A null conversation id is a conversation of its own; null roles and texts
are one space.  Repeated rows are rows (the later ones duplicates).  A conversation without rows after damage has zeros, an
empty audit and the hash of the empty string; an empty table gives no rows.  Other columns are ignored.

Everything but the last pass is spread over chunks, whatever the length of a conversation.  The last pass streams a
conversation through one task, since SHA-256 of its text is sequential, and keeps only its audit, which is a result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import cut, forget

#: A chunk has at most ``2**BITS`` rows.
BITS = 12
DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
#: States: 0 nothing yet, 1 after the opening system row, 2 after a user row, 3 after an assistant row.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a row whose role was chosen to fit.
FIT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_BLANKS = " \t\n\x0b\x0c\r"


def moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row in a state as (initial, cost, next state).

    A code is the role's initial (``x`` if it is none of ``sua``), upper case for a text that is cut short, or ``d`` for a row
    that has to go.
    """
    out = [("D", DELETE, state)]
    if code != "d":
        extra = CUT_SHORT if code.isupper() else 0
        if (state, code.lower()) in KEEP:
            out.append(("K", extra, KEEP[state, code.lower()]))
        out.append(("R", REROLE + extra, FIT[state]))
    return out


def _with_insertions(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):  # at most two rows are inserted in one place
        costs = [min(c, INSERT + costs[FIT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _level(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


#: Costs to go behind the last row: a lone user row lacks its answer, an opening system row lacks both.
END = _with_insertions([0, 1 << 30, 1 << 30, 0])
SPECULATIVE = (0, 0, 0, 0)


@lru_cache(1 << 16)
def before(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row, up to a constant."""
    return _level(_with_insertions([min(c + after[n] for _, c, n in moves(code, s)) for s in range(4)]))


@lru_cache(1 << 16)
def edit(code: str, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """Cheapest, then ASCII-least edits at a row: initials, next state, cost."""
    here = _with_insertions([min(c + after[n] for _, c, n in moves(code, s)) for s in range(4)])
    done, cost = "", 0
    while True:
        options = [(c + after[n], op, c, n) for op, c, n in moves(code, state)]
        options.append((INSERT + here[FIT[state]], "I", INSERT, FIT[state]))
        _, op, c, state = min(options)
        done, cost = done + op, cost + c
        if op != "I":
            return done, state, cost


def run_back(codes: str, end: tuple[int, ...], old_end: tuple[int, ...] | None = None) -> tuple[int, ...] | None:
    """Costs at the start of a chunk; None as soon as they agree with those from ``old_end``."""
    new, old = end, old_end
    for code in reversed(codes):
        if new == old:
            return None
        new = before(code, new)
        old = None if old is None else before(code, old)
    return None if new == old else new


def trace(codes: str, end: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """Edits of a whole chunk entered in ``state``: initials, next state, cost."""
    costs = [end]
    for code in reversed(codes[1:]):
        costs.append(before(code, costs[-1]))
    done, cost = [], 0
    for code, after in zip(codes, reversed(costs)):
        ops, state, c = edit(code, after, state)
        done.append(ops)
        cost += c
    while last and state in (1, 2):
        done.append("I")
        state, cost = FIT[state], cost + INSERT
    return "".join(done), state, cost


def damage(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as ``conv, turn, role, text``, with the faults that the checksum of ``conv:turn`` chooses."""
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    words, who = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text, role))
    fault = F.col("fault")
    return rows.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        who.alias("role"), words.alias("text"), (F.crc32(key) % 20).alias("fault"),
    ).select(
        "conv", "turn", "fault",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def _chunks(rows: DataFrame, bits: int) -> DataFrame:
    """One row per chunk: ``conv, begin, seq, last, codes``."""
    body = _stripped(F.col("text"))
    marked = rows.select(
        "conv", "g", "role", F.sha2("text", 256).alias("digest"), (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    seen = marked.groupBy("conv", "role", "digest").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("new"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    code = (
        F.when(F.col("blank") | F.col("new").isNull(), F.lit("d")).when(F.col("open"), F.upper(initial)).otherwise(initial)
    )
    coded = marked.join(seen, "g", "left").select("conv", "g", F.struct("g", code.alias("code")).alias("at"))
    whole = coded.groupBy("conv", F.shiftright("g", bits).alias("chunk")).agg(
        F.min("g").alias("begin"),
        F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["code"]), "").alias("codes"),
    )
    # a chunk stands for up to 2**bits rows; these windows run over chunks
    order = Window.partitionBy("conv").orderBy("begin")
    return whole.select(
        "conv", "begin", "codes", F.row_number().over(order).alias("seq"), F.lead("begin").over(order).isNull().alias("last")
    )


_VECTORS = "conv long, begin long, seq int, last boolean, codes string, used array<int>, front array<int>"


def _start(batches):
    for pdf in batches:
        pdf["used"] = [list(_level(END)) if last else list(SPECULATIVE) for last in pdf["last"]]
        pdf["front"] = [list(run_back(c, tuple(u)) or u) for c, u in zip(pdf["codes"], pdf["used"])]
        pdf["conv"] = pdf["conv"].astype("Int64")
        yield pdf


def _again(batches):
    """A chunk runs again from ``need``; where it meets its old vectors it keeps its front."""
    for pdf in batches:
        front = []
        for codes, need, used, old in zip(pdf["codes"], pdf["need"], pdf["used"], pdf["front"]):
            if need is None:
                front.append(list(old))
                continue
            new = run_back(codes, tuple(map(int, need)), tuple(map(int, used)))
            front.append(list(old) if new is None else list(new))
        pdf["used"] = [list(u if n is None else n) for u, n in zip(pdf["used"], pdf["need"])]
        pdf["front"] = front
        pdf["conv"] = pdf["conv"].astype("Int64")
        yield pdf.drop(columns=["need"])


def costs_to_go(chunks: DataFrame) -> DataFrame:
    """Chunks with the costs behind each (``used``), settled by fix-up passes; a pass is one job over the chunks."""
    now = cut(chunks.mapInPandas(_start, _VECTORS))
    while True:
        after = now.filter("seq > 1").select(F.col("conv").alias("c"), (F.col("seq") - 1).alias("s"), F.col("front").alias("need"))
        same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s"))
        waiting = now.filter(~F.col("last")).join(after, same).filter(F.col("need") != F.col("used"))
        if waiting.isEmpty():
            return now
        joined = now.join(after, same, "left").drop("c", "s")
        joined = joined.withColumn("need", F.when(F.col("need") != F.col("used"), F.col("need")))
        newer = cut(joined.mapInPandas(_again, _VECTORS))
        forget(now)
        now = newer


def _traces(batches):
    for pdf in batches:
        rows = []
        for codes, used, seq, last in zip(pdf["codes"], pdf["used"], pdf["seq"], pdf["last"]):
            end = tuple(map(int, used))
            rows.append([trace(codes, end, s, last) if s == 0 or seq > 1 else ("", 0, 0) for s in range(4)])
        yield pd.DataFrame(
            {"conv": pdf["conv"].astype("Int64"), "g": pdf["begin"], "codes": pdf["codes"],
             "audits": [[t[0] for t in r] for r in rows], "states": [[t[1] for t in r] for r in rows],
             "costs": [[t[2] for t in r] for r in rows]}
        )


class _Conversation:
    """Running figures of one conversation while its rows stream by."""

    def __init__(self, conv, gaps):
        self.conv, self.gaps, self.state, self.cost = conv, gaps, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None
        self.audits: list[str] = []
        self.hash, self.first = hashlib.sha256(), True
        self.codes, self.ops, self.shown = iter(""), iter(""), 0

    def enter(self, codes: str, audits, states, costs) -> None:
        """The chosen trace of the next chunk."""
        ops = audits[self.state]
        self.audits.append(ops)
        self.cost += int(costs[self.state])
        self.codes, self.ops = iter(codes), iter(ops)
        self.state = int(states[self.state])

    def _write(self, role: str, text: str, then: int) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first, self.shown = False, then

    def row(self, role: str, text: str) -> None:
        code, initial = next(self.codes), role[:1]
        if code == "d":
            empty = not text.strip(_BLANKS)
            self.blank += empty
            self.duplicate += not empty
        else:
            self.truncated += code.isupper()
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        op = next(self.ops)
        while op == "I":
            self._write(_NAMES[FIT[self.shown]], "", FIT[self.shown])
            op = next(self.ops)
        if op == "K":
            self._write(role, text, KEEP[self.shown, initial])
        elif op == "R":
            self._write(_NAMES[FIT[self.shown]], text, FIT[self.shown])

    def result(self) -> tuple:
        for _ in self.ops:  # rows inserted behind the last one
            self._write(_NAMES[FIT[self.shown]], "", FIT[self.shown])
        counts = (self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return (self.conv, *counts, "".join(self.audits), self.hash.hexdigest())


_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _stitch(batches):
    """Sorted stream: a conversation's head, then each chunk's traces and rows."""
    now = None
    for pdf in batches:
        out = []
        conv = pdf["conv"].astype("Int64")
        columns = [pdf[c] for c in ("kind", "gaps", "role", "text", "codes", "audits", "states", "costs")]
        for c, kind, gaps, role, text, codes, audits, states, costs in zip(conv, *columns):
            if kind == 0:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(None if pd.isna(c) else int(c), int(gaps))
            elif kind == 1:
                now.enter(codes, audits, states, costs)
            else:
                now.row(role, text)
        if out:
            yield _frame(out)
    if now is not None:
        yield _frame([now.result()])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_RESULT)
    out["conv_id"] = pd.array([r[0] for r in rows], dtype="Int64")
    return out


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS
) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    spark = rows.sparkSession
    damaged = damage(rows, conv, turn, role, text)
    turns = damaged.groupBy("conv", "turn").agg((F.max("fault") > 0).alias("left"))
    held = F.when(F.col("left"), F.col("turn"))
    gaps = F.coalesce(F.max(held) - F.min(held) + 1 - F.count(held), F.lit(0).cast("long"))
    heads = turns.groupBy("conv").agg(gaps.alias("gaps"))

    left = damaged.filter("fault > 0").select(
        "conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    )
    # equal rows are interchangeable: a running number lets a range border fall between them
    left = left.drop("col").withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = left.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number of a partition is in its upper bits, so these numbers follow the order over all partitions
    in_order = cut(in_order.select("conv", "role", "text", F.monotonically_increasing_id().alias("g")))

    settled = costs_to_go(_chunks(in_order, bits))
    traced = settled.mapInPandas(
        _traces, "conv long, g long, codes string, audits array<string>, states array<int>, costs array<long>"
    )
    stream = (
        heads.withColumn("g", F.lit(-1).cast("long")).withColumn("kind", F.lit(0))
        .unionByName(traced.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(in_order.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        .repartition("conv").sortWithinPartitions("conv", "g", "kind")
    )
    types = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return stream.mapInPandas(_stitch, f"{types}, audit string, repaired_sha256 string")
