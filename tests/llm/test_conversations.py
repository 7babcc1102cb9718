"""Conversation repair against an exhaustive search over edits."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from facetry.llm import queries, turn_repair

BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def legal(roles):
    if not roles:
        return True
    rest = roles[1:] if roles[0] == "s" else roles
    return len(rest) > 0 and len(rest) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(rest))


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by trying every sequence of edits, cheaper ones first cut off by the best."""
    best = [(2 * len(rows), "D" * len(rows), ())]

    def go(i, cost, audit, kept):
        if cost > best[0][0]:
            return
        roles = "".join(r[0][:1] or "?" for r in kept)
        if not any(legal(roles + tail) for tail in ("", "u", "a", "ua", "au", "uau", "aua")) and kept:
            return
        if i == len(rows) and legal(roles):
            best[0] = min(best[0], (cost, audit, kept))
        if sum(c == "I" for c in audit) < 3:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", (*kept, (role, "")))
        if i == len(rows):
            return
        go(i + 1, cost + 2, audit + "D", kept)
        if faults[i] not in ("blank", "duplicate"):
            extra = 5 if faults[i] == "truncated" else 0
            go(i + 1, cost + extra, audit + "K", (*kept, rows[i]))
            for role in ("user", "assistant"):
                go(i + 1, cost + extra + 1, audit + "R", (*kept, (role, rows[i][1])))

    go(0, 0, "", ())
    return best[0]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, group in groups.items():
        faults, seen = [], set()
        for _, _, role, text in group:
            body = text.rstrip(BLANKS)
            if not body:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[1] for r in group if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = cheapest([r[2:] for r in group], faults)
        text = "\n".join(f"{a}:{b}" for a, b in kept)
        counts = tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.selectExpr("*", *[f"'x' as {c}" for c in ("conv", "g", "kind", "code", "seq", "fault", "salt", "gaps", "cost")])


def result(df):
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def make(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut", " \n", "", None, "Why? ", "Well.\t", f"Text {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_against_every_sequence_of_edits(spark, bits):
    rows = make(bits, 60, 5)
    rows += [(None, t, r, f"Said {t}.") for t, r in enumerate(["user", "user", "assistant"])]  # null id
    rows += [rows[0], rows[0], rows[5]]  # repeated rows
    assert result(turn_repair.repair(table(spark, rows), bits=bits)) == brute(rows)


def test_long_conversation_does_not_depend_on_the_chunks(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"No {t}.", f"cut {t}"])) for t in range(700)]
    rows += [(8, None, "user", "Hi.")] * 50
    whole = result(turn_repair.repair(table(spark, rows), bits=12))
    assert whole == result(turn_repair.repair(table(spark, rows), bits=3))
    assert zlib.crc32(b"8: ") % 20 == 3  # every row is repeated
    assert whole[8][:7] == (0, 0, 99, 0, 99, 200, "D" * 100)


def test_speculative_vectors_are_mended():
    """Chunks of rows that never converge (all cut short and deleted) take as many passes as there are chunks."""
    codes = "dddd" * 8
    at_end = turn_repair.run_back(codes, turn_repair.END)
    assert at_end == turn_repair.END  # deleting everything forgets nothing
    assert turn_repair.run_back("uaua", (0, 0, 0, 0), turn_repair.SPECULATIVE) is None


def test_unconverged_chunks_run_pass_after_pass(spark):
    rows = [(1, 2 * t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(8)]
    rows += [(1, 100 + t, "user", "") for t in range(40)]
    rows += [(1, 200, "user", "Last one.")]
    assert result(turn_repair.repair(table(spark, rows), bits=2)) == result(turn_repair.repair(table(spark, rows), bits=12))


def test_empty_and_dropped(spark):
    assert turn_repair.repair(table(spark, [])).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    found = result(turn_repair.repair(table(spark, [(5, turn, "user", "Gone.")])))
    assert found == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_text(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 > 4)
    rows = [(5, turn, "user", "word " * 400_000 + " " * 100_000)]
    assert result(turn_repair.repair(table(spark, rows))) == brute(rows)


def test_query_covers_all_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = result(queries.QUERIES["op12_turn_repair"](spark, folder))
    assert found == brute(rows)
