"""Toxicity by noisy-channel deobfuscation: disguised words are decoded, then the restored text is scored.

What was meant is a string of letters and word breaks; what is written went through a channel that swaps letters for
look-alikes (``1d10t``), pulls words apart (``i d i o t``) and stretches letters (``idiooot``).  Every token or spaced run that
shows one of these is a lattice: each character is a letter, a break, or nothing.  Viterbi decoding finds the path of least
cost under the channel and a character language model, four-grams counted over all documents.

The evidence of a word or stem is the lower confidence bound of the share of toxic documents among those that hold it, beyond the
share among all.  It is counted twice: the second time a toxic document is credited only to features at least half as strong as its
strongest, so that words which merely come along lose theirs.  Weak evidence is left out.  A document's score is a noisy or over its
restored words, each with its strongest feature.  Evidence is learned from a sample of labelled rows, about ``PER_CLASS`` of each label (equal texts count once).  Scoring covers every whole text; there, only lattices that
some word with evidence runs through are decoded, as no other can change the score.

A text without words (null or empty) gets the share of toxic rows as its score, 0 without any labels.  Null ids stay null and
are never held out; repeated rows give repeated results; contradictory labels of a document count as their minimum; other
columns are ignored.  Partial spacing (``id iot``) and masked letters (``id**t``) are not undone.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, texts

#: About so many labelled rows of each label are used to learn evidence; no other step is sampled.
PER_CLASS = 5_000
#: Lengths of the stems of words.
STEMS = (4, 8)
#: Words and stems with evidence, the strongest first; the least evidence that counts; documents a word must be met in; width of its
#: confidence bound.
LEXICON, LEAST_EVIDENCE, LEAST_DOCS, WIDTH = 4096, 0.25, 8, 4.0
ORDER, SYMBOLS = 4, 28
#: Channel costs in nats: a look-alike, the first and each further dropped repeat, the first and each further dropped separator.
LOOKALIKE, DROP, DROP_MORE, JOIN, JOIN_MORE = 2.0, 6.0, 0.7, 3.0, 0.3
#: Look-alikes of letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "<": "c",
}
_LEET_CLASS = "0-9@$!|+€£¢(<"
_SEPARATORS = " .-_*"
_SUSPECT = re.compile(rf"[{_LEET_CLASS}]|(\w)\1\1", re.I)
_DOUBLED = re.compile(r"(\w)\1", re.I)
_ONE = rf"(?:[^\W_]|[{_LEET_CLASS}])"
_SPACED = re.compile(rf"(?<!\w){_ONE}(?:[.\-_*]{{1,3}}{_ONE}){{2,}}(?!\w)")
_RUN = re.compile(r"(.)\1{7,}", re.S)
_WORD = re.compile(r"[^\W\d_]+")
#: Longest piece that is decoded at once, what neighbouring pieces share, and what is decoded around a possible word.
PIECE, SHARED, MARGIN = 64, 16, 8
_CACHE = 1 << 17


@lru_cache(1 << 16)
def letter(ch: str) -> str:
    """The plain small letter of a character, itself for other letters, '' for anything else."""
    base = unicodedata.normalize("NFKD", ch.lower())[:1]
    return base if base.isalpha() else ""


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        self[code] = letter(chr(code)) or chr(code)
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Small letters without marks, one for one."""
    return text.translate(_FOLD)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(fold(text)))


def _symbol(c: str) -> int:
    """0 for a break, 1 to 26 for a to z, 27 for other letters."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c else 0


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbols of the code points of the basic plane; what lies beyond is a break."""
    out = np.zeros(65537, np.int32)
    out[:65536] = [_symbol(letter(chr(c))) if not 0xD800 <= c < 0xE000 else 0 for c in range(65536)]
    return out


def gram_counts(raw: list[str]) -> np.ndarray:
    """Occurrences of every four-gram of symbols; breaks in a row are one, and each text begins and ends with some."""
    joined = " ".join(["", *raw, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.take(_symbols(), codes, mode="clip")
    dark = s != 0
    dark[1:] |= dark[:-1]
    s = np.concatenate([np.zeros(2, np.int32), s[dark]])
    gram = s[:-3] * SYMBOLS
    for k in (1, 2):
        gram += s[k : k - 3]
        gram *= SYMBOLS
    gram += s[3:]
    return np.bincount(gram, minlength=SYMBOLS**ORDER)


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Cost in nats of each symbol after each three; shorter contexts stand in for rare longer ones."""
    c = counts.reshape([SYMBOLS] * ORDER).astype(float)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for held in range(ORDER):
        table = c.sum(axis=tuple(range(ORDER - 1 - held))) if held < ORDER - 1 else c
        p = (table + weight * p) / (table.sum(-1, keepdims=True) + weight)
    return -np.log(p).reshape(SYMBOLS ** (ORDER - 1), SYMBOLS).astype(np.float32)


def decode(piece: str, cost: np.ndarray, spaced: bool = False) -> str:
    """The likeliest letters and breaks behind a piece of text."""
    size = SYMBOLS * SYMBOLS
    states: dict[tuple[int, bool, bool], tuple[float, str]] = {(0, False, False): (0.0, "")}
    before = ""
    for ch in _RUN.sub(lambda m: m.group(1) * 8, piece):
        plain = letter(ch)
        options = [(_symbol(plain), 0.0, plain or " ")]
        options += [(_symbol(c), LOOKALIKE, c) for c in LEET.get(ch, "")]
        found: dict[tuple[int, bool, bool], tuple[float, str]] = {}

        def offer(key, value):
            if key not in found or value < found[key]:
                found[key] = value

        for (ctx, dropped, joined), (sofar, out) in states.items():
            last = ctx % SYMBOLS
            if spaced and ch in _SEPARATORS and last:
                offer((ctx, dropped, True), (sofar + (JOIN_MORE if joined else JOIN), out))
            for symbol, extra, c in options:
                if symbol == 0 and last == 0:
                    offer((ctx, False, False), (sofar, out))
                    continue
                to = (ctx % size) * SYMBOLS + symbol
                step = sofar + extra + float(cost[ctx, symbol])
                offer((to, False, joined and symbol != 0), (step, out + c))
                if symbol and symbol == last and out[-1:] == c and before not in _SEPARATORS:
                    offer((ctx, True, joined), (sofar + extra + (DROP_MORE if dropped else DROP), out))
        states, before = found, ch
    ends = [(c + (float(cost[ctx, 0]) if ctx % SYMBOLS else 0.0), out) for (ctx, _, _), (c, out) in states.items()]
    return min(ends)[1].strip()


def features(word: str) -> list[str]:
    """A word and its stems."""
    return [word, *[f"{word[:k]}*" for k in range(STEMS[0], min(STEMS[1], len(word)) + 1)]]


def once(word: str) -> str:
    """A word with each run of a letter written once."""
    return re.sub(r"(.)\1+", r"\1", word)


def spaced_runs(tokens: list[str]) -> list[tuple[int, int]]:
    """Runs of three or more tokens that are one character each, but for separators."""
    small = [i for i, t in enumerate(tokens) if len(t) == 1 or (len(t) == 2 and not t.isalnum())]
    out: list[tuple[int, int]] = []
    for a, b in zip(small, small[2:]):
        if b - a == 2:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b + 1)
            else:
                out.append((a, b + 1))
    return out


def _tokens(text: str):
    """Tokens of a text, spaced runs in one piece."""
    tokens, begin = text.split(), 0
    for i, j in spaced_runs(tokens):
        yield from ((t, False) for t in tokens[begin:i])
        yield " ".join(tokens[i:j]), True
        begin = j
    yield from ((t, False) for t in tokens[begin:])


def _canonical(word: str) -> str:
    """Letters that share a look-alike made one, look-alikes as letters, repeats once, everything else gone."""
    out = []
    for ch in word:
        c = letter(ch) or LEET.get(ch, "")[:1]
        c = "i" if c == "l" else "g" if c == "q" else c
        if c and (not out or out[-1] != c):
            out.append(c)
    return "".join(out)


@dataclass
class Scorer:
    """Language model, evidence of words and the share of toxic rows."""

    cost: np.ndarray
    evidence: dict[str, float]
    prior: float
    _memory: dict = field(default_factory=dict)
    _seen: dict = field(default_factory=dict)
    _hot: dict = field(default_factory=dict)
    _shapes: dict = field(default_factory=dict)
    _finder: object = None

    def __getstate__(self):
        """Only what was learned travels; memories of tokens are those of a worker."""
        return {**vars(Scorer({}, {}, 0.0)), "cost": self.cost, "evidence": self.evidence, "prior": self.prior}

    def _decoded(self, piece: str, spaced: bool) -> str:
        if len(self._memory) > _CACHE:
            self._memory.clear()
        key = (piece, spaced)
        if key not in self._memory:
            self._memory[key] = decode(piece, self.cost, spaced)
        return self._memory[key]

    def rewrite(self, text: str) -> str:
        """The words of a text with every disguise decoded; blanks become single ones where they fall into a spaced run."""
        begin, parts = 0, []
        matches = list(re.finditer(r"\S+", text))
        for i, j in spaced_runs([m.group() for m in matches]):
            parts += [text[begin : matches[i].start()], (text[matches[i].start() : matches[j - 1].end()], True)]
            begin = matches[j - 1].end()
        parts.append(text[begin:])
        plain = lambda m: self._restore(m.group(), False)
        return "".join(re.sub(r"\S+", plain, p) if isinstance(p, str) else self._restore(*p) for p in parts)

    def _restore(self, token: str, spaced: bool) -> str:
        spaced = spaced or _SPACED.search(token) is not None
        if not (spaced or _SUSPECT.search(token)) or not any(map(str.isalpha, token)):
            return token
        steps = range(0, max(1, len(token) - SHARED), PIECE - SHARED)
        return " ".join(self._decoded(token[i : i + PIECE], spaced) for i in steps)

    def words(self, text: str) -> list[str]:
        """The restored words of a text in order."""
        out: list[str] = []
        for token, spaced in _tokens(text):
            key = (token, spaced, "words")
            if key not in self._memory:
                if len(self._memory) > _CACHE:
                    self._memory.clear()
                self._memory[key] = _WORD.findall(fold(self._restore(token, spaced)))
            out += self._memory[key]
        return out

    def _possible(self, token: str):
        """Parts of a token that some word with evidence may lie in."""
        if self._finder is None:
            for word in sorted(self.evidence):
                self._shapes[once(word)] = max(self.evidence[word], self._shapes.get(once(word), 0.0))
            self._finder = ahocorasick.Automaton()
            for shape in {_canonical(w) for w in self.evidence} - {""}:
                self._finder.add_word(shape, len(shape))
            self._finder.make_automaton()
        shape, places = [], []
        for i, ch in enumerate(token):
            c = letter(ch) or LEET.get(ch, "")[:1]
            c = "i" if c == "l" else "g" if c == "q" else c
            if c and (not shape or shape[-1] != c):
                shape.append(c)
                places.append([i, i + 1])
            elif c:
                places[-1][1] = i + 1
        begin = end = None
        for last, size in self._finder.iter("".join(shape)):
            a, b = max(0, places[last - size + 1][0] - MARGIN), places[last][1] + MARGIN
            if end is not None and a <= end:
                begin, end = min(a, begin), max(end, b)
                continue
            if end is not None:
                yield token[begin:end]
            begin, end = a, b
        if end is not None:
            yield token[begin:end]

    def _known(self, words: list[str] | set[str], found: dict[str, float]) -> None:
        for word in words:
            strength = max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)
            if strength > found.get(once(word), 0.0):
                found[once(word)] = strength

    def _hits(self, token: str, spaced: bool) -> dict[str, float]:
        """Words with evidence in one token or spaced run."""
        found: dict[str, float] = {}
        self._known(words_of(token), found)
        spaced = spaced or _SPACED.search(token) is not None
        if spaced or _SUSPECT.search(token) or _DOUBLED.search(token):
            for part in self._possible(token):
                words = _WORD.findall(self._decoded(part, spaced))
                self._known(words, found)
                if spaced or _SUSPECT.search(part):  # a disguise says nothing about letters that were doubled before
                    for word in words:
                        strength = max((self._shapes.get(f, 0.0) for f in features(once(word))), default=0.0)
                        if strength > found.get(once(word), 0.0):
                            found[once(word)] = strength
        return found

    def hits(self, text: str) -> dict[str, float]:
        """Words with evidence in the restored text (letters in a row once), with its strength."""
        if not self.evidence:
            return {}
        if len(self._seen) > _CACHE * 4:
            self._seen.clear()
            self._hot.clear()
        tokens = text.split()
        each = set(tokens)
        for token in [t for t in each if t not in self._seen]:
            self._seen[token] = None
            if found := self._hits(token, False):
                self._hot[token] = found
        out: dict[str, float] = {}
        for token in [t for t in each if t in self._hot]:
            out |= self._hot[token]
        for i, j in spaced_runs(tokens):
            out |= self._hits(" ".join(tokens[i:j]), True)
        return out

    def score(self, text: str) -> float:
        clean = 1.0 - self.prior
        for _, strength in sorted(self.hits(text).items()):
            clean *= 1.0 - strength
        return min(1.0, max(0.0, 1.0 - clean))


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def count_grams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Four-grams of all documents; what reaches the driver is bounded by the number of possible ones."""

    def run(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for pdf in blocks(batches, limit=1 << 20):
            total += gram_counts(list(pdf["text"]))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    rows = texts(docs, key, text).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**ORDER, np.int64)
    out[rows["gram"]] = rows["n"]
    return out


def _evidence(n1: float, n0: float, met: int, prior: float) -> float:
    """Lower confidence bound of the toxic share beyond the prior, as the strength of a noisy or."""
    p, z = n1 / (n1 + n0), WIDTH * WIDTH / met
    low = (p + z / 2 - np.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)
    return float(max(0.0, (low - prior) / (1 - prior))) if prior < 1 else 0.0


def _counts_frame(counts: dict[str, list[int]]) -> pd.DataFrame:
    zero, one = zip(*counts.values()) if counts else ((), ())
    return pd.DataFrame({"feature": pd.Series(list(counts), dtype=object), "n0": zero, "n1": one})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Scorer:
    """Language model from all documents, evidence from a bounded sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    marked = marked.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.0
    scorer = Scorer(language_model(count_grams(docs, key, text)), {}, prior)
    if not n1 or not n0:
        return scorer
    # a share of the hash range chosen from the counts: about per_class rows of each label, a bounded side
    share = {y: min(1.0, per_class / n) for y, n in ((0, n0), (1, n1))}
    place = (F.xxhash64("doc_id", F.lit("toxicity")) / F.lit(2.0**64)) + 0.5
    sample = marked.filter(place <= F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    rows = texts(docs, key, text)
    alike = rows.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("doc_id").alias("doc_id"))
    shared = spark.sparkContext.broadcast(scorer)

    def counted(strength: dict[str, float] | None):
        """Documents of each label that hold a feature; with strengths, a toxic one is credited to its strong features only."""

        def run(batches):
            counts: dict[str, list[int]] = {}
            for pdf in batches:
                for body, toxic in zip(pdf["text"], pdf["toxic"]):
                    found = {f for w in set(shared.value.words(body)) for f in features(w)}
                    if strength is not None:
                        found &= strength.keys()
                        least = max(map(strength.get, found), default=0.0) / 2 if toxic else 0.0
                        found = [f for f in found if strength[f] >= least]
                    for f in found:
                        counts.setdefault(f, [0, 0])[toxic] += 1
                if len(counts) > _CACHE:
                    yield _counts_frame(counts)
                    counts = {}
            yield _counts_frame(counts)

        rows = chosen.mapInPandas(run, "feature string, n0 long, n1 long").groupBy("feature")
        return rows.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)

    def strong(found: DataFrame) -> dict[str, float]:
        """At most ``LEXICON`` features, the likeliest first."""
        found = found.filter(F.col("n1") * n0 * share[0] > F.col("n0") * n1 * share[1])
        rows = found.orderBy(F.desc(F.col("n1") / (F.col("n0") + F.col("n1") + WIDTH * WIDTH)), "feature").limit(LEXICON).collect()
        each = {r["feature"]: _evidence(r["n1"] / share[1], r["n0"] / share[0], r["n0"] + r["n1"], prior) for r in rows}
        return {f: e for f, e in each.items() if e >= LEAST_EVIDENCE}

    chosen = rows.join(F.broadcast(alike.select("doc_id", "toxic")), "doc_id")
    scorer.evidence = strong(counted(strong(counted(None))))
    return scorer


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, per_class))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": nullable_ids(pdf["doc_id"]), "score": [shared.value.score(t) for t in pdf["text"]]})

    scored = texts(docs, key, text).mapInPandas(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def restored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, restored``: whole texts with their disguises decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(language_model(count_grams(docs, key, text)), {}, 0.0))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": nullable_ids(pdf["doc_id"]), "restored": [shared.value.rewrite(t) for t in pdf["text"]]})

    return texts(docs, key, text).mapInPandas(run, "doc_id long, restored string")
