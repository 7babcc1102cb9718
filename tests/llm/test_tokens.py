"""Token files and packing against whole-text encoding."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import packing, token_files, tokens

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def whole(name, texts):
    from tokenizers import Tokenizer

    done = Tokenizer.from_file(tokens.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, "<u4") for e in done]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_units_give_the_ids_of_whole_texts(name):
    encode = tokens.encoder(tokens.tokenizer_path(name)).encode_all
    parts = ["foo", "Bar's", "don't", "12", ",", ".", "é́", "漢字", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x85", "\x1c", "<|endoftext|>", "_", "a.b", "x,", "(y)."]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=12).map("".join))
    def check(text):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == whole(name, [text])[0].tolist()

    check()


@pytest.mark.parametrize("name", VOCABULARIES)
def test_marks_after_every_letter(name):
    encode = tokens.encoder(tokens.tokenizer_path(name)).encode_all
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    for mark in ".,":
        for k in range(0, len(letters), 20_000):
            texts = [f"{c}{mark}" for c in letters[k : k + 20_000]]
            assert encode(texts) == [x.tobytes() for x in whole(name, texts)]


def test_forgetting_units_changes_nothing(monkeypatch, rows):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    e = tokens.Encoder(tokens.tokenizer_path(VOCABULARIES[0]))
    texts = [r[1] or "" for r in rows]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == [x.tolist() for x in whole(VOCABULARIES[0], texts)]


def test_token_files_round_trip(docs, rows, tmp_path, spark):
    got = token_files.token_files(docs, str(tmp_path / "t")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.append(x, 2).astype("<u4") for x in whole(VOCABULARIES[0], [r[1] or "" for r in order])]
    assert len(got) == len(rows)
    start = 0
    want = {}
    for r, x in zip(order, ids):
        want.setdefault(r[0], set()).add((start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    for g in got:
        if g.doc_id is not None:  # the two rows without id have no order between them
            assert (g.start, g.n_tokens, g.ids_crc32) in want[g.doc_id]
    starts = sorted((g.start, g.n_tokens) for g in got)
    assert [a for a, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()
    data = np.concatenate([np.fromfile(f, "<u2") for f in sorted((tmp_path / "t").glob("*.bin")) if len(f.name) == 9])
    assert len(data) == start
    again = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert again.count() == len(rows)


def test_empty_table(no_docs, tmp_path):
    assert token_files.token_files(no_docs, str(tmp_path / "e")).collect() == []
    assert packing.pack(no_docs).collect() == []


def test_best_fit_plan_equals_best_fit_of_single_pieces():
    rng = np.random.default_rng(3)
    for room in (10, 64, 257):
        for _ in range(30):
            lengths = rng.integers(1, room + 1, rng.integers(1, 300))
            plan = packing.plan_best_fit(dict(zip(*np.unique(lengths, return_counts=True))), room)
            free: list[int] = []
            for n in sorted(lengths, reverse=True):
                fits = [f for f in free if f >= n]
                free.remove(min(fits)) if fits else None
                free.append((min(fits) if fits else room) - n)
            assert plan.sequences == len(free)


def check_packing(got, room):
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist()
        assert sum(n for _, n in places) <= room
    return len(by)


@pytest.mark.parametrize("room", [2048, 32])
def test_packing(docs, rows, room, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 2)
    got = packing.pack(docs, room=room).collect()
    want = []
    for r, x in zip(rows, whole(VOCABULARIES[1], [r[1] or "" for r in rows])):
        ids = np.append(x, 0).astype("<u4")
        for k in range(0, len(ids), room):
            part = ids[k : k + room]
            want.append((r[0], k // room, k, len(part), zlib.crc32(part.tobytes())))
    key = lambda t: (t[0] is None, t)
    mine = [(g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    used = check_packing(got, room)
    total = sum(g.length for g in got)
    assert used <= -(-total // room) * 1.25 + 1


def test_repeated_units_are_looked_up_once_a_call():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    e = tokens.Encoder(tokens.tokenizer_path(VOCABULARIES[0]))
    e.young, e.old = Counted(), Counted()
    texts = ["the sea the sky\nthe end, the sky. Über größe!" * 50, "", "the sky", "\n", " the\n"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == [x.tolist() for x in whole(VOCABULARIES[0], texts)]
    assert Counted.asked < 50
    assert e.encode_all([]) == [] and e.encode_all(["", ""]) == [b"", b""]
