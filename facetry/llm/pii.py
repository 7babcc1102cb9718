"""Personal data in texts, plain and disguised, with offsets into the source.

Plain identifiers are found in the source text.  Disguised ones are found after a transducer has
normalised the text: look-alike letters and digits become ASCII, invisible characters vanish, spelled digits
become digits, ``[at]``/``(dot)`` and spaced `` at ``/`` dot `` become ``@`` and ``.``.  Since " at " is an
ordinary word, it counts only before a domain, and then only if the domain has a disguised dot ("jane at
mail.example dot com"), or ends in a label of letters and the word before has a digit beside letters, an inner
``. _ % +``, or a look-alike or disguised dot ("jane.doe at example.com", but not "look at example.com").  The transducer keeps, for
every normalised character, the source range it came from, so an identifier found in normalised text is
reported as a range of the source.  Only ranges that contain a rewritten character are added, and none
that lies within a plain identifier of its kind; an added range may reach beyond a plain one that is a fragment
of it, and masking covers both.

Null and empty texts have no identifiers; a null id stays null; repeated rows give repeated results; other
columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, sha256, small_batches, span_text, texts

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[Span]:
    """Matches of local@domain, found from each ``@`` outwards: no character is read twice."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append(("email", begin, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def _small_parts(value: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in value.split("."))


def _luhn(value: str) -> bool:
    digits = [ord(c) - 48 for c in value if "0" <= c <= "9"]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def _dialable(value: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in value) <= 15


def plain(text: str) -> list[Span]:
    """Identifiers as written: leftmost, non-overlapping per kind, failing matches dropped."""
    found = _emails(text)
    for kind, expression, test in (("ip", _IP, _small_parts), ("card", _CARD, _luhn), ("phone", _PHONE, _dialable)):
        found += [(kind, m.start(), m.end()) for m in expression.finditer(text) if test(m[0])]
    return found


# Letters that look like Latin ones.
_CYRILLIC = dict(zip("АВЕКМНОРСТХаеорсухіјѕһԁԛԝ", "ABEKMHOPCTXaeopcyxijshdqw"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv"))
_MARKS = {"\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u00a0": " "}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_ONE_DIGIT = f"(?:{'|'.join(_DIGITS)})"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_LABELS = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
#: Where such characters live: Greek, Cyrillic, other digits, invisible, full-width, mathematical, circled.
_RANGES = (
    "\u00a0\u00ad\u00b7\u0370-\u03ff\u0400-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u200b-\u200d\u2010-\u2013\u2024"
    "\u2060\u3002\ufeff\ufe52\ufe6b\uff01-\uff5e\U0001d400-\U0001d7ff\u2460-\u2468\u24b6-\u24e9"
)
_REWRITE = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}\s{{0,3}}(?ai:at|@)\s{{0,3}}{_CLOSE}\s{{0,3}}"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}(?:at|AT)\s{{1,3}}(?={_LABELS}\s{{0,3}}(?:{_OPEN}\s{{0,3}}(?ai:dot|\.)|\s(?ai:dot)\s)))"
    # the same before a plain domain: the word before decides
    rf"|(?P<loose>(?<=[A-Za-z0-9])\s{{1,3}}(?:at|AT)\s{{1,3}}(?=(?:[A-Za-z0-9-]++\.)++(?<=\.)[A-Za-z]{{2,24}}(?![A-Za-z0-9-])))"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}\s{{0,3}}(?ai:dot|\.)\s{{0,3}}{_CLOSE}\s{{0,3}}|(?<=[A-Za-z0-9])\s{{1,3}}(?ai:dot)\s{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<digit>(?ai:\b{_ONE_DIGIT}\b(?:[\s,-]{{1,3}}(?={_ONE_DIGIT}\b))?))"
    rf"|(?P<plus>(?ai:\bplus)\s{{1,3}}(?=(?ai:{_ONE_DIGIT}\b)|[0-9]))"
    rf"|(?P<glyph>[{_RANGES}])"
)
#: Words and signs of which every match of ``_REWRITE`` has one, at most ``_AHEAD`` characters after its start.
_SIGNS = re.compile(
    rf"[{_RANGES}]|@(?=[\s\])}}>])|(?ai:at|dot)(?=[\s\])}}>])|(?ai:\b(?:plus(?=\s)|{_ONE_DIGIT}\b))|{_OPEN}\s{{0,3}}\."
)
_AHEAD = 7
#: A local part that is no ordinary word.
_ODD = re.compile(r"[A-Za-z0-9][._%+]+[A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]")


@lru_cache(maxsize=4096)
def _ascii(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    known = _CYRILLIC.get(c) or _GREEK.get(c) or _MARKS.get(c)
    if known:
        return known
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and len(folded) == 1 else c


def _rewritings(text: str) -> Iterator[re.Match]:
    """``_REWRITE.finditer(text)``, tried only where a sign is near."""
    at = 0
    while sign := _SIGNS.search(text, at):
        for begin in range(max(at, sign.start() - _AHEAD), sign.start() + 1):
            m = _REWRITE.match(text, begin)
            if m:
                yield m
                break
        at = m.end() if m else sign.start() + 1


def _odd_local(text: str, free: int, end: int, before: str | None) -> bool:
    """Whether the word that ends at ``end`` is no ordinary one; ``before`` is what a disguise before ``free`` became."""
    begin = end
    while begin > free and text[begin - 1] in _LOCAL:
        begin -= 1
    if begin == free and before is not None and (before in ("", ".") or before.isalpha()):
        return True
    return bool(_ODD.search(text, begin, end))


def normalise(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Rewritten text, and its pieces ``(first rewritten offset, source start, source end)`` in order.

    Rewritten pieces stand for their whole source range; the pieces between keep their length.
    """
    out, pieces, done, size = [], [], 0, 0
    new = None
    for m in _rewritings(text):
        kind, last = m.lastgroup, new
        if kind == "at":
            new = "@"
        elif kind == "loose":
            if not _odd_local(text, done, m.start(), last):
                continue
            new = "@"
        elif kind == "dot":
            new = "."
        elif kind == "plus":
            new = "+"
        elif kind == "digit":
            word = re.match("[a-z]+", m[0].lower())[0]
            new = str(_DIGITS.index(word))
        else:
            new = _ascii(m[0])
            if new == m[0]:
                new = last
                continue
        if m.start() > done:
            pieces.append((size, done, m.start()))
            out.append(text[done : m.start()])
            size += m.start() - done
        pieces.append((size, m.start(), -m.end()))  # a negative end marks a rewritten piece
        out.append(new)
        size += len(new)
        done = m.end()
    if done < len(text):
        pieces.append((size, done, len(text)))
        out.append(text[done:])
    return "".join(out), pieces


def _to_source(pieces: list[tuple[int, int, int]], starts: list[int], begin: int, end: int) -> tuple[int, int, bool]:
    """Source range of a range of normalised text, and whether it contains a rewritten piece."""
    i, j = bisect_right(starts, begin) - 1, bisect_right(starts, end - 1) - 1
    first, last = pieces[i], pieces[j]
    source_begin = first[1] + (begin - first[0] if first[2] > 0 else 0)
    source_end = last[1] + (end - last[0]) if last[2] > 0 else -last[2]
    return source_begin, source_end, any(p[2] < 0 for p in pieces[i : j + 1])


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Identifiers that only normalisation shows, as source ranges."""
    new, pieces = normalise(text)
    if not any(p[2] < 0 for p in pieces):
        return []
    starts = [p[0] for p in pieces]
    taken = {kind: sorted((s, e) for k, s, e in known if k == kind) for kind in KINDS}
    found = []
    for kind, begin, end in plain(new):
        begin, end, rewritten = _to_source(pieces, starts, begin, end)
        # plain ranges of a kind do not overlap: the last that starts no later is the only one that can hold it
        k = bisect_right(taken[kind], (begin, len(text))) - 1
        if rewritten and not (k >= 0 and end <= taken[kind][k][1]):
            found.append((kind, begin, end))
    return found


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans and added spans, each by kind, then start."""
    by_kind = lambda s: (_ORDER[s[0]], s[1], s[2])
    own = sorted(plain(text), key=by_kind)
    return own, sorted(disguised(text, own), key=by_kind)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the plain kinds, a digest of their spans, and all spans as ``kind:start:end`` text."""

    def run(batches):
        for pdf in blocks(batches):
            rows = []
            for body in pdf["text"]:
                own, more = spans_of(body)
                every = sorted(own + more, key=lambda s: (_ORDER[s[0]], s[1], s[2]))
                count = [sum(s[0] == k for s in own) for k in KINDS]
                rows.append((*count, sha256(span_text(own)), span_text(every), len(more)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", nullable_ids(pdf["doc_id"]))
            yield out

    return texts(docs, key, text).mapInPandas(run, _SCHEMA)


def mask(text: str) -> str:
    """The text with every identifier replaced by its kind in angle brackets; of overlapping ones the first counts."""
    own, more = spans_of(text)
    out, done = [], 0
    for kind, begin, end in sorted(own + more, key=lambda s: (s[1], -s[2], _ORDER[s[0]])):
        if begin >= done:
            out += [text[done:begin], f"<{kind}>"]
        elif end > done:
            pass  # the rest of an overlapping identifier goes too
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """All columns of ``docs`` with identifiers in ``text`` masked and ``size``, if there, counted anew; nulls stay null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(body: pd.Series) -> pd.Series:
        return body.map(lambda t: t if t is None else mask(t))

    out = docs.withColumn(text, masked(F.col(text)))
    return out.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size in docs.columns else out
