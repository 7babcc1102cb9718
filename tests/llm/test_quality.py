"""Classifier, rule forest, mixture and pipeline."""

import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import check_oracle
import corpus_pipeline
from facetry.llm import knn_quality, minhash, mixing, packing, pii, queries, rule_forest
from facetry.llm.common import table

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def word_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_rule_counts_equal_brute_force(docs, rows, labels):
    got = rule_forest.judge(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {g.doc_id: g for g in got if g.doc_id is not None}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            want, g = word_counts(text or ""), by_id[doc_id]
            assert tuple(g[c] for c in rule_forest.COUNTS) == want
            assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (g.base_failed and g.kept)


def test_forest_without_labels_rejects_nothing_by_itself(docs, no_docs, labels, no_labels):
    for marks in (None, no_labels):
        assert all(g.kept != g.base_failed for g in rule_forest.judge(docs, marks).collect())
    assert rule_forest.judge(no_docs, labels).collect() == []


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 4))
    odd = rng.standard_normal((50, 4)) + 7
    forest = rule_forest.Forest.fit(x)
    assert forest.score(odd).min() > np.quantile(forest.score(x), 0.99)
    both, good = np.vstack([x, odd]), np.r_[np.ones(2000, bool), np.zeros(50, bool)]
    forest.calibrate(both, good)
    kept = forest.score(both) <= forest.threshold
    assert kept[good].mean() >= rule_forest.KEEP_GOOD and not kept[~good].any()


def test_calibration_by_counts_is_the_best_allowed_threshold():
    rng = np.random.default_rng(5)
    forest = rule_forest.Forest.fit(rng.standard_normal((500, 3)))
    good, bad = rng.integers(3000, 6000, 400), rng.integers(4500, 9000, 60)
    levels = np.unique(np.r_[good, bad])
    counts = [np.array([(x == level).sum() for level in levels]) for x in (good, bad)]
    forest.calibrate_counts(levels, *counts, keep_good=0.9)
    gain = {t: (good <= t).mean() - (bad <= t).mean() for t in levels if (good <= t).mean() >= 0.9}
    assert gain[round(forest.threshold * rule_forest.LEVELS)] == max(gain.values())
    assert rule_forest.Forest.fit(np.zeros((2, 3))).calibrate_counts(levels, counts[0], 0 * counts[1]).threshold == 1.0


@tables
def test_rule_forest_keeps_good_documents(spark):
    got = queries.op7_rule_forest(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id")
    good = got.filter("quality = 1 and not base_failed").selectExpr("avg(int(kept))").first()[0]
    assert good >= 0.99


@tables
def test_classifier_on_held_out_rows(spark):
    got = queries.op4_knn_quality(spark, FOLDER)
    assert got.count() == 1000 and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert got.filter("held_out <> (crc32(string(doc_id)) % 3 = 1)").count() == 0
    got = got.filter("held_out").join(table(spark, FOLDER, "labels"), "doc_id")
    assert got.selectExpr("avg(int(predicted = quality))").first()[0] >= 0.95


def test_classifier_edge_cases(docs, rows, no_docs, labels, no_labels):
    got = knn_quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    empty = {r[0] for r in rows if not r[1] and r[0] is not None}
    assert len({g.score for g in got if g.doc_id in empty}) == 1
    assert all(g.predicted == 1 for g in knn_quality.classify(docs, no_labels).collect())
    assert knn_quality.classify(no_docs, labels).collect() == []
    kept = knn_quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(g.predicted for g in got)


def test_votes_of_equal_texts():
    x = knn_quality.counts([b"aaaa bbbb", b"#### $$$$", b"aaaa bbbb", b""])
    model = knn_quality.Model.fit(x[:2], np.array([1.0, 0.0]))
    score = model.score(x)
    assert score[0] == score[2] > 0.9 and score[1] < 0.1 and score[3] == 0.5


@tables
def test_mixture_equals_sql(spark):
    for folder in ("/root/testdata/sf0.001", FOLDER):
        con = check_oracle.connect(folder)
        ok, note = check_oracle.compare(spark, con, folder, queries.op1_mix_sources, mixing.ORACLE_SQL)
        assert ok, note


def leaf(r):
    source = "unknown" if r[3] is None else r[3]
    number = re.search("[0-9]+", source)
    domain = "crawl" if source == "src0" else f"part{int(number[0]) % 4}" if number else source
    return domain, r[2] or "unknown", source


def test_no_source_is_dropped_for_its_name(spark):
    rows = [(1, "one two", "en", "wiki"), (2, "three four", "en", "news"), (3, "five " * 90, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = {r["doc_id"] for r in mixing.mixed(docs).collect()}
    assert taken == {1, 2, 3}


def water(budget, limit, weight):
    """Shares by repeated filling: children at their limit drop out, the rest is dealt again."""
    share, left = dict.fromkeys(limit, 0.0), {c for c in limit if weight[c] > 0 and limit[c] > 0}
    while left:
        rate = budget / sum(weight[c] for c in left)
        full = {c for c in left if limit[c] <= weight[c] * rate}
        for c in full or left:
            share[c] = limit[c] if full else weight[c] * rate
        budget -= sum(share[c] for c in full)
        if not full:
            break
        left -= full
    return share


@pytest.mark.parametrize("budget", [None, 0, 37, 5_000, 10**9])
@pytest.mark.parametrize("cell", [1, 500])
def test_mixture_equals_brute_force(docs, rows, budget, cell):
    if cell == 500 and budget not in (None, 37):
        pytest.skip("one cell size is enough here")
    got = mixing.mix(docs, budget, cell_documents=cell).collect()
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += word_counts(r[1] or "")[0]
    total = sum(tokens.values()) if budget is None else budget
    weights = (mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, mixing.SOURCE_WEIGHTS)
    share = {(): float(total)}
    for depth in range(3):
        limit = Counter()
        for path, n in tokens.items():
            limit[path[: depth + 1]] += 4 * n
        for parent in [p for p in share if len(p) == depth]:
            mine = {c: n for c, n in limit.items() if c[:-1] == parent}
            share |= water(share[parent], mine, {c: weights[depth].get(c[-1], 1.0) for c in mine})
    assert len(got) == len(rows)
    taken = Counter()
    for g in got:
        taken[g.domain, g.lang, g.source] += g.taken_tokens
        assert g.prefix_tokens <= g.n_tokens and g.in_prefix >= (g.prefix_tokens > 0)
    for path in tokens:
        assert taken[path] == int(share[path] + 0.001), path


def test_mixed_rows(docs, no_docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = mixing.mix(docs).selectExpr("doc_id", "epochs + int(in_prefix) as n").filter("n > 0 and doc_id is not null")
    want = {r.doc_id: r.n for r in want.collect()}
    got = Counter(r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None)
    repeated = {3, 25}
    assert {k: v for k, v in got.items() if k not in repeated} == {k: v for k, v in want.items() if k not in repeated}
    whole = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in out.filter("doc_id is not null").collect():
        assert whole[r.doc_id].startswith(r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
    assert mixing.mixed(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


@tables
def test_pipeline_stages_take_effect(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "personal_data", "mixture", "packed"]
    folder = "/root/testdata/sf0.001"
    docs = documents
    texts = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == documents.columns
        if name == "quality":
            bad = {r.doc_id for r in queries.op4_knn_quality(spark, folder).filter("predicted = 0").collect()}
            assert bad and texts(out) == {t for t in texts(docs) if t[0] not in bad}
        elif name == "near_dedup":
            kept = {r.doc_id for r in minhash.near_groups(docs, size=5, percent=80).filter("kept").collect()}
            assert texts(out) == {t for t in texts(docs) if t[0] in kept} and len(kept) < docs.count()
        elif name == "personal_data":
            assert texts(out) == {(i, pii.mask(t)) for i, t in texts(docs)}
            assert all(pii.plain(t) == [] for _, t in texts(out))
        else:
            taken = mixing.mix(docs).agg({"taken_tokens": "sum"}).first()[0]
            assert sum(word_counts(r.text)[0] for r in out.collect()) == taken
        docs = out
    last = corpus_pipeline.run(spark, folder)
    assert last.count() == packing.pack(docs).count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_fit_holds_the_sample_once():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in rng.integers(0, 400, 1000)]
    x = knn_quality.counts([b"", *texts])
    rows = knn_quality.packed(x)
    assert sum(map(len, rows)) < x.nbytes / 5 and np.array_equal(knn_quality.unpacked(rows), x)
    terms = np.log1p(x) * (np.log((1.0 + len(x)) / (1.0 + (x > 0).sum(0))).astype(np.float32) + 1.0)
    terms = knn_quality._unit(terms)
    tracemalloc.start()
    model = knn_quality.Model.fit(x, np.arange(len(x)) % 2, rank=8, overwrite=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    assert np.array_equal(model.vectors, knn_quality._unit(terms @ model.basis))
