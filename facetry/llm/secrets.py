"""Secret scanning with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must
contain.  Documents are indexed block by block (a document-partitioned index: every task holds the
postings of its own documents, so nothing is shuffled), postings are united and intersected as the
query says, and only the remaining candidates are matched with the expression itself.  A rule
without mandatory trigrams is matched against every document.

Nulls and empty texts give zero spans; a null id stays null; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from facetry.llm.common import blocks, nullable_ids, sha256, span_text, texts
from facetry.llm.textscan import Scan

ALL = ("all",)
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: that group of a match needs so many characters; shorter matches are dropped."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0


#: Rules that every scan applies; their order is the order of kinds.
BASE = (
    Rule(
        "assign",
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Formats of well-known issuers, added to the base rules.
ISSUERS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]{24,255}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"),
)


def _all_of(parts: list) -> tuple:
    flat = [p for p in parts if p != ALL]
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _any_of(parts: list) -> tuple:
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """What a text must contain if it contains one of the strings."""
    return _any_of([_all_of([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _exact(items) -> set[str] | None:
    """All strings a sequence can match (folded to lower case), or None if they are many or unbounded."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            more = {chr(arg).lower()} if arg < 128 else None
        elif op is sre.IN and all(k is sre.LITERAL and c < 128 for k, c in arg):
            more = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            more = _exact(arg[3])
        elif op is sre.BRANCH:
            each = [_exact(b) for b in arg[1]]
            more = None if None in each else set().union(*each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 2:
            one = _exact(arg[2])
            more = None if one is None else {a * n for a in one for n in range(arg[0], arg[1] + 1)}
        else:
            more = None
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _walk(items) -> tuple:
    parts, held = [], {""}
    for item in items:
        op, arg = item
        one = _exact([item])
        if one is not None and len(held) * len(one) <= _MOST_STRINGS:
            held = {a + b for a in held for b in one}
            continue
        parts.append(_of_strings(held))
        held = {""} if one is None else one
        if one is None:
            if op is sre.SUBPATTERN:
                parts.append(_walk(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_any_of([_walk(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_walk(arg[2]))
    parts.append(_of_strings(held))
    return _all_of(parts)


def trigram_query(pattern: str) -> tuple:
    """``("tri", t)``, ``("and", ...)``, ``("or", ...)``, or ``ALL`` if no trigram is mandatory; lower case."""
    return _walk(_parser.parse(pattern))


def trigrams_of(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams_of(q) for q in query[1:])) if query != ALL else set()


class Index:
    """Postings (sorted document numbers) of the wanted trigrams in one block of texts."""

    def __init__(self, raw: list[bytes], wanted: np.ndarray):
        self.n = len(raw)
        scan = Scan(raw, lower=True)
        b = scan.buf.astype(np.uint32)
        codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(wanted[codes])
        both = np.unique(codes[at].astype(np.int64) * self.n + scan.doc_of(at)) if len(at) else np.zeros(0, np.int64)
        code, doc = both // max(1, self.n), both % max(1, self.n)
        keys, first = np.unique(code, return_index=True)
        self.postings = dict(zip(keys.tolist(), np.split(doc, first[1:]) if len(keys) else []))

    def ask(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "tri":
            a, b, c = query[1].encode("latin-1")
            return self.postings.get(a << 16 | b << 8 | c, np.zeros(0, np.int64))
        out = self.ask(query[1])
        for q in query[2:]:
            out = np.intersect1d(out, self.ask(q)) if query[0] == "and" else np.union1d(out, self.ask(q))
        return out


def wanted_trigrams(queries: list[tuple]) -> np.ndarray:
    wanted = np.zeros(1 << 24, bool)
    for t in set().union(*map(trigrams_of, queries)):
        a, b, c = t.encode("latin-1")
        wanted[a << 16 | b << 8 | c] = True
    return wanted


def _matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in expression.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            found.append((rule.name, m.start(), m.end()))
    return found


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", added: tuple[Rule, ...] = ISSUERS) -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, and all spans as ``kind:start:end`` text."""
    rules = (*BASE, *added)
    queries = [trigram_query(r.pattern) for r in rules]
    order = {r.name: i for i, r in enumerate(rules)}
    base = {r.name for r in BASE}

    def run(batches):
        wanted = wanted_trigrams(queries)
        expressions = [re.compile(r.pattern) for r in rules]
        for pdf in blocks(batches):
            body = list(pdf["text"])
            index = Index([t.encode() for t in body], wanted)
            found: list[list] = [[] for _ in body]
            for rule, query, expression in zip(rules, queries, expressions):
                for i in index.ask(query):
                    found[i] += _matches(rule, expression, body[i])
            rows = []
            for spans in found:
                spans.sort(key=lambda s: (s[1], order[s[0]]))
                own = [s for s in spans if s[0] in base]
                count = [sum(s[0] == r.name for s in own) for r in BASE]
                rows.append((*count, sha256(span_text(own)), span_text(spans), len(spans) - len(own)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", nullable_ids(pdf["doc_id"]))
            yield out

    return texts(docs, key, text).mapInPandas(run, _SCHEMA)
