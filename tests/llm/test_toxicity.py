"""Noisy-channel decoding, learned evidence and scores."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def scorer(tables):
    return toxicity.fit(*tables)


@pytest.mark.parametrize(
    "written, meant",
    [("1d10t", "idiot"), ("5tup1d", "stupid"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("idiooooot", "idiot"),
     ("M0R0N!", "moron"), ("l o s e r", "loser"), ("P4th3tic", "pathetic"), ("the!!", "the"), ("plain words", "plain words"),
     ("4736962573099581", "4736962573099581"), ("y y con la", "y y con la"), ("", "")],
)
def test_decoding(scorer, written, meant):
    assert scorer.rewrite(written) == meant


def test_disguises_count_like_the_plain_word(scorer):
    plain = scorer.score("you idiot")
    for written in ("you 1d10t", "you i d i o t", "you idiooot", "you idioot!", "YOU ÍDIOT"):
        assert scorer.score(written) == pytest.approx(plain)
    assert scorer.score("nothing to see") == pytest.approx(scorer.prior)


def brute_decode(piece, cost):
    """Least cost over every path of the lattice, by enumeration."""
    paths = [(0, False, 0.0, "", "")]
    for ch in piece:
        plain = toxicity.letter(ch)
        options = [(plain, 0.0), *[(c, toxicity.LOOKALIKE) for c in toxicity.LEET.get(ch, "")]]
        new = []
        for ctx, dropped, total, out, _ in paths:
            for c, extra in options:
                symbol = toxicity._symbol(c)
                if symbol == 0 and ctx % 28 == 0:
                    new.append((ctx, False, total, out, ch))
                    continue
                new.append(((ctx * 28 + symbol) % 28**3, False, total + extra + float(cost[ctx, symbol]), out + (c or " "), ch))
                if symbol and symbol == ctx % 28 and out[-1:] == c:
                    new.append((ctx, True, total + extra + (toxicity.DROP_MORE if dropped else toxicity.DROP), out, ch))
        paths = new
    return min((t + (float(cost[c, 0]) if c % 28 else 0), out) for c, _, t, out, _ in paths)[1].strip()


def test_decoding_is_the_cheapest_path(scorer):
    rng = np.random.default_rng(1)
    for _ in range(60):
        piece = "".join(rng.choice(list("aassto01$!t3"), rng.integers(1, 7)))
        assert toxicity.decode(piece, scorer.cost) == brute_decode(piece, scorer.cost)


def test_grams_are_counted_over_all_documents(spark, tables):
    docs, _ = tables
    want = sum(toxicity.gram_counts([r["text"] or ""]).astype(object) for r in docs.select("text").limit(150).collect())
    got = toxicity.count_grams(docs.limit(150).repartition(5))
    # documents that share a block also share the break between them
    assert abs(int(got.sum()) - int(want.sum())) < 400 and (got != want).sum() < 3000
    assert toxicity.count_grams(docs.limit(0)).sum() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = queries.QUERIES["op11_toxicity"](spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels.filter("toxic is not null"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.04 and np.mean(toxic) > 0.75


def test_edge_cases(spark, docs, no_docs, labels, no_labels, rows):
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == len(rows) and {r["predicted"] for r in found} <= {0, 1}
    assert all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert not by_id[None]["held_out"]
    assert all(r["score"] == 0 for r in toxicity.classify(docs, no_labels).collect())
    assert toxicity.classify(no_docs, labels).count() == 0
    assert toxicity.restored(docs).count() == len(rows)


def test_long_and_hostile_texts(spark, scorer):
    for text in ("a" * 2_000_000, "1" * 300_000, "a1" * 150_000, "i d " * 100_000, "a." * 200_000, "!@$" * 100_000):
        assert 0 <= scorer.score(text) <= 1
    assert scorer.score("word " * 200_000 + "idiot") == pytest.approx(scorer.score("idiot"))


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    docs, labels = tables
    kept = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert toxicity.fit(docs, kept).evidence == toxicity.fit(docs, labels).evidence
