"""MinHash groups, suffix dedup and vector groups against brute force."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import minhash, projections, suffix_dedup, textscan
from facetry.llm.common import blocks

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def united(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n", max_size=30), max_size=5), st.integers(1, 5))
def test_shingle_sets_have_the_right_sizes(texts, size):
    got = minhash.shingle_sets([t.encode() for t in texts], size)
    assert [len(s) for s in got] == [len(shingles(t, size)) for t in texts]
    for a, x in zip(texts, got):
        for b, y in zip(texts, got):
            assert len(np.intersect1d(x, y)) == len(shingles(a, size) & shingles(b, size))


def test_tables_needed():
    for percent in (80, 85, 95):
        m = minhash.collections_needed(percent)
        alone = 1 - (percent / 100) ** 2
        assert 1 - (1 - alone**m) ** 2 <= minhash.MISS < 1 - (1 - alone ** (m - 1)) ** 2


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(docs, rows, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 2)
    monkeypatch.setattr(minhash, "SMALL", 2)
    got = minhash.near_groups(docs, size=size, percent=percent).collect()
    sets = {r[0]: shingles(r[1] or "", size) for r in rows if r[0] is not None}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    assert len(links) >= 6
    want = united(sets, links)
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None and g.kept
        else:
            assert (g.n_shingles, g.component_id, g.kept) == (len(sets[g.doc_id]), want[g.doc_id], want[g.doc_id] == g.doc_id)


@pytest.mark.parametrize("small", [128, 1])
def test_links_that_the_centre_does_not_show_are_found(spark, small, monkeypatch):
    """A chain: neighbours are similar, the ends are not; the ids make no end a good centre."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TILE", 4)
    words = [f"w{i}" for i in range(400)]
    chain = []
    for k in range(12):
        for i in range(3 * k, 3 * k + 6):
            words[i * 9] = f"x{k}-{i}"
        chain.append(" ".join(words))
    order = [7, 2, 9, 0, 5, 11, 3, 8, 1, 10, 4, 6]
    df = spark.createDataFrame([(order[k], t) for k, t in enumerate(chain)], "doc_id long, text string")
    sets = {order[k]: shingles(t, 3) for k, t in enumerate(chain)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = united(sets, links)
    got = {g.doc_id: g.component_id for g in minhash.near_groups(df, size=3, percent=85).collect()}
    assert got == want


def test_common_counts_and_spanning_links(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(20)]
    got = minhash.common_counts(sets)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    for _ in range(50):
        a, b = rng.integers(0, 30, (2, 40))
        start = rng.integers(0, 25, 30)
        p, q = minhash.spanning(a, b, start)
        known = [(int(x), int(y)) for x in range(30) for y in range(30) if start[x] == start[y]]
        assert united(range(30), [*known, *zip(p, q)]) == united(range(30), [*known, *zip(a, b)])
        assert len(p) == len(set(united(range(30), known).values())) - len(set(united(range(30), [*known, *zip(a, b)]).values()))


def test_one_of_each_group_and_empty_table(docs, no_docs, spark):
    out = minhash.one_of_each_group(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert kept == {r.doc_id for r in minhash.near_groups(docs).filter("kept").collect()}
    assert minhash.near_groups(no_docs).collect() == []
    alone = spark.createDataFrame([(1, None), (2, ""), (3, "")], "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in minhash.near_groups(alone).collect())


def test_only_the_text_that_has_to_go_goes(spark):
    a, b = "one two three four five six seven", "some other words that are not alike at all"
    df = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert {tuple(r) for r in minhash.one_of_each_group(df).collect()} == {(1, a), (2, b)}


def test_one_id_with_several_texts_does_not_crash(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (2, "a b c d e f")], "doc_id long, text string")
    assert minhash.near_groups(df, size=3, percent=85).count() == 4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=120) | st.binary(max_size=80).map(lambda b: b.decode("latin-1")))
def test_two_stage_sort_is_a_suffix_array(text):
    raw = text.encode("latin-1")
    got = suffix_dedup.two_stage_sort(np.frombuffer(raw, np.uint8), 130)
    assert got.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    prefixes = suffix_dedup.common_prefixes(np.frombuffer(raw, np.uint8), got, 130)
    for k in range(1, len(got)):
        a, b = raw[got[k - 1] :], raw[got[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        # past the end the padding is compared, which can only lengthen a prefix by zero bytes
        assert prefixes[k] >= n and (prefixes[k] == n or raw[max(got[k - 1], got[k]) + n :] == b"" or b"\0" in raw)


def brute_repeats(rows, length):
    """Per id: bytes, removed bytes, runs, digest; rows with null ids come first and count as one document."""
    texts = {}
    for r in rows:
        texts.setdefault(-1 if r[0] is None else r[0], []).append((r[1] or "").encode())
    first = {}
    for i in sorted(texts):
        for t in texts[i]:
            for k in range(len(t) - length + 1):
                first.setdefault(t[k : k + length], (i, k))
                first[t[k : k + length]] = min(first[t[k : k + length]], (i, k))
    out = {}
    for i, (t, *_) in ((i, t) for i, t in texts.items() if i >= 0):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (i, k):
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length, classes", [(100, 4096), (100, 1), (40, 3)])
def test_suffix_dedup_equals_brute_force(docs, rows, length, classes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", classes)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
    want = brute_repeats(rows, length)
    spans = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a, **k: spans(*a, most_classes=classes))
    got = suffix_dedup.remove_repeats(docs, length=length).collect()
    assert len(got) == len(rows)
    assert sum(w[1] for w in want.values()) > 1000
    for g in got:
        if g.doc_id is not None:
            assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[g.doc_id], g.doc_id
            assert hashlib.sha256(g.kept).hexdigest() == g.kept_sha256


@pytest.mark.parametrize("classes", [4096, 1])
@pytest.mark.parametrize("doc_id", [None, 7])
def test_spans_go_only_from_the_text_they_were_found_in(spark, monkeypatch, doc_id, classes):
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared, copy = word(150), word(400)
    texts = [word(10) + shared + word(200), word(170) + shared + word(90), word(500), word(600), copy, copy]
    spans = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a, **k: spans(*a, most_classes=classes))
    df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(df).collect()]
    assert all(g[0] == doc_id for g in got) and len(got) == len(texts)
    left = [g[3] for g in got]
    for whole in texts[2:]:  # clean texts, and equal rows, lose nothing
        assert whole in left
    assert left.count(copy) == 2
    removed = sorted(g[2] for g in got)
    assert removed[:-1] == [0] * 5 and removed[-1] == 150
    assert sum(shared in t for t in left) == 1


def test_suffix_dedup_of_an_empty_table(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + rng.standard_normal(16) * 0.06
            rows.append((len(rows), [float(x) for x in v], int(c % 3)))
    dense = rng.standard_normal(16)
    for _ in range(150):  # more than a window
        rows.append((len(rows), [float(x) for x in dense + rng.standard_normal(16) * 0.01], 1))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(4)]  # copies
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0)]
    rows += [(n + 4, [None] + [1.0] * 15, 0), (n + 5, rows[0][1], None), (n + 6, [2 * x for x in rows[0][1]], 0)]
    rows += [(n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [float("inf")] * 16, 0), (n + 10, [1e-300] * 16, 0), (n + 11, [1e300] * 16, 0)]
    rows += [rows[1], (None, rows[0][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as node", "'y' as root")


def test_vector_groups_equal_brute_force(spark):
    rows, df = vectors(spark)

    def sound(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = sorted({r[0] for r in rows if r[0] is not None})
    good = {r[0]: r for r in rows if r[0] is not None and r[2] is not None and sound(r[1])}
    unit = {i: np.array(r[1]) / max(map(abs, r[1])) for i, r in good.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [
        (a, b) for a in good for b in good if a < b and good[a][2] == good[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    ]
    want = united(ids, links)
    count = {i: sum(i in p for p in links) for i in ids}
    got = projections.near_vectors(df, window=8, tile=64).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.vec_id is None:
            assert (g.n_links, g.component_id, g.kept) == (0, None, True)
        else:
            assert (g.n_links, g.component_id, g.kept) == (count[g.vec_id], want[g.vec_id], want[g.vec_id] == g.vec_id)


@pytest.mark.parametrize("common, row_cost", [(0.95, None), (0.0, 0)])
def test_links_of_a_crowded_label_are_found(spark, monkeypatch, common, row_cost):
    if row_cost is not None:  # then prefixes pay even here
        monkeypatch.setattr(projections, "ROW_COST", row_cost)
    rng = np.random.default_rng(3)
    n, planted, d = 4000, 150, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = rng.standard_normal((n, d))
    x[:, 0] = 0
    x = unit(x) * np.sqrt(1 - common)
    x[:, 0] = np.sqrt(common)
    side = rng.standard_normal((planted, d))
    side = unit(side - (side * x[:planted]).sum(1, keepdims=True) * x[:planted])
    x = np.r_[x, 0.982 * x[:planted] + np.sqrt(1 - 0.982**2) * side]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in projections.near_vectors(df).collect()}
    close = x @ x.T >= 0.98
    np.fill_diagonal(close, False)
    assert close.sum() >= 2 * planted
    assert [got[i].n_links for i in range(len(x))] == close.sum(1).tolist()
    want = united(range(len(x)), zip(*np.nonzero(close)))
    assert {i: r.component_id for i, r in got.items()} == want


def test_passes_follow_the_prefix():
    angle = np.arccos(0.98) / np.pi
    assert projections.passes_needed(0, 0.98) == 1
    for bits in projections.PREFIXES[1:]:
        assert (1 - (1 - angle) ** bits) ** projections.passes_needed(bits, 0.98) <= projections.MISS


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert projections.near_vectors(df).collect() == []


def test_blocks_keep_every_row():
    import pandas as pd

    pdf = pd.DataFrame({"text": ["a" * n for n in (5, 0, 9, 1, 1, 1, 30, 2)]})
    assert pd.concat(list(blocks([pdf, pdf], limit=10)))["text"].tolist() == pdf["text"].tolist() * 2


def test_hashes_depend_on_content_only():
    a, b = textscan.Scan([b"one two", b"two one"]), textscan.Scan([b"padding", b"x one two"])
    ha, hb = a.hashes(*a.words()[:2]), b.hashes(*b.words()[:2])
    assert ha[0] == ha[3] == hb[2] and ha[1] == ha[2] == hb[3] and len({*ha, *hb}) == 4
