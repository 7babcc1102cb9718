"""Personal data and secrets against plain regular expressions."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()]
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return 16 <= len(digits) <= 19 and total % 10 == 0


def brute_pii(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if luhn(m[0])]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


def brute_secrets(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1240@.+- (_%١é", max_size=60))
def test_plain_identifiers_equal_the_regular_expressions(text):
    assert pii.spans_of(text)[0] == brute_pii(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("to j.doe at mail dot example dot org.", "email", "j.doe at mail dot example dot org"),
        ("x аdmin@ехаmple.com y", "email", "аdmin@ехаmple.com"),
        ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
        ("one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
        ("４111 1111 1111 111１!", "card", "４111 1111 1111 111１"),
        ("call plus four nine 30 1234567 now", "phone", "plus four nine 30 1234567"),
    ],
)
def test_disguised_identifiers_map_back_to_the_source(text, kind, found):
    own, more = pii.spans_of(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(kind, found)]
    assert pii.mask(text) == text.replace(found, f"<{kind}>")


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("to j\u0430ne@example.com now", "email", "j\u0430ne@example.com"),
        ("to jane@example.c\u043em now", "email", "jane@example.c\u043em"),
        ("to jane@mail.example dot com", "email", "jane@mail.example dot com"),
        ("call +49 30 12345\uff16\uff17!", "phone", "+49 30 12345\uff16\uff17"),
        ("call +49 30 123456 seven!", "phone", "+49 30 123456 seven"),
        ("at 10.0.0.2\uff15 now", "ip", "10.0.0.2\uff15"),
    ],
)
def test_disguised_identifiers_are_whole_where_a_fragment_is_plain(text, kind, found):
    own, more = pii.spans_of(text)
    assert own == [s for s in brute_pii(text)]
    assert (kind, text.index(found), text.index(found) + len(found)) in more
    assert pii.mask(text) == text.replace(found, f"<{kind}>")


@pytest.mark.parametrize(
    "text, kind",
    [
        ("jane\tat\texample\tdot\tcom", "email"),
        ("jane@example\ndot\ncom", "email"),
        ("one.nine.two.four", "ip"),
        ("one.9.two.4", "ip"),
        ("jane.doe at example.com", "email"),
        ("jane99 at mail.example.com", "email"),
        ("jane dot doe at example.com", "email"),
        ("jane.d\u043ee at example.com", "email"),
        ("j\u0430ne at example.com", "email"),
        ("jane at mail.example dot com", "email"),
        ("jane at mail.example (dot) com", "email"),
    ],
)
def test_every_rewriting_opens_the_gate(text, kind):
    assert pii.spans_of(text)[1] == [(kind, 0, len(text))]
    assert pii.mask(f"; {text} ;") == f"; <{kind}> ;"


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(["at", "dot", "[", ")", "(", "]", ".", "@", "one", "Nine", "plus", "1", "jo", " ", "\t", "\u0430", "\u200b"]), max_size=12))
def test_the_gate_is_no_narrower_than_the_rewriting(parts):
    text = "".join(parts)
    assert [m.span() for m in pii._rewritings(text)] == [m.span() for m in pii._REWRITE.finditer(text)]


@pytest.mark.parametrize("text", ["look at example.com now", "sites\u2013look at example.com", "number one at example.com", "up-to-date at example.com", "open 24 at example.com"])
def test_a_spaced_at_after_an_ordinary_word_stays(text):
    assert pii.spans_of(text) == ([], []) and pii.mask(text) == text


def test_spaced_at_takes_linear_time():
    for text in ("a at " * 50_000, "a at " + "a." * 100_000, "a.b at c.d " * 20_000, "a.b at " + "x" * 200_000, "one." * 50_000):
        pii.spans_of(text)


@pytest.mark.parametrize("text", ["we met at noon. dot your i", "one two three", "look at home dot", "café абв at 12.30"])
def test_ordinary_text_is_left_alone(text):
    assert pii.spans_of(text) == ([], []) and pii.mask(text) == text


def test_long_hostile_texts_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "1 " * 100_000):
        pii.spans_of(text)


def test_pii_query(docs, rows):
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            want = brute_pii(text or "")
            assert by_id[doc_id].base_sha256 == digest(want)
            assert [by_id[doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(by_id[doc_id].spans.split(","))


def test_redaction_keeps_columns_and_nulls(docs, no_docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert out.filter("text is null").count() == docs.filter("text is null").count()
    assert not out.filter("text like '%example.org%'").count()
    assert out.filter("n_chars <> length(text)").count() == 0
    assert pii.redact(no_docs).count() == pii.find_pii(no_docs).count() == 0


def holds(query, text):
    if query == secrets.ALL:
        return True
    if query[0] == "tri":
        return query[1] in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])


@pytest.mark.parametrize("rule", (*secrets.BASE, *secrets.ISSUERS), ids=lambda r: r.name)
def test_every_match_satisfies_the_trigram_query(rule):
    query = secrets.trigram_query(rule.pattern)
    assert (query == secrets.ALL) == (rule.name == "hex")

    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(rule.pattern))
    def check(text):
        assert holds(query, "".join(c for c in text)) or not re.search(rule.pattern, text)

    check()


@pytest.mark.parametrize("piece", ["eyJ", "eyJaaaaaaaaaaa.", "eyJ-", "ghp_", "password", "AKIA", "-----BEGIN "])
def test_secret_rules_take_linear_time_on_hostile_texts(piece):
    text = piece * (1_000_000 // len(piece))
    begin = time.monotonic()
    for rule in (*secrets.BASE, *secrets.ISSUERS):
        sum(1 for _ in re.finditer(rule.pattern, text))
    assert time.monotonic() - begin < 15


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == ("and", ("tri", "abc"), ("tri", "bcd"))
    assert q("ab") == q("[0-9]+") == q("(abc)?") == secrets.ALL
    assert q("abc|xyz") == ("or", ("tri", "abc"), ("tri", "xyz"))
    assert q("abc[0-9]+def") == ("and", ("tri", "abc"), ("tri", "def"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKeN", "api_key", "AKIA", "ABCDEFGH12345678", " = ", ":", '"', "deadbeef", "0123456789", "\n", "zz", "ſ"]), max_size=14))
def test_base_secrets_equal_the_regular_expressions(parts):
    text = "".join(parts)
    index = secrets.Index([text.encode()], secrets.wanted_trigrams([secrets.trigram_query(r.pattern) for r in secrets.BASE]))
    found = []
    for r in secrets.BASE:
        if len(index.ask(secrets.trigram_query(r.pattern))):
            found += secrets._matches(r, re.compile(r.pattern), text)
    order = [r.name for r in secrets.BASE]
    assert sorted(found, key=lambda s: (s[1], order.index(s[0]))) == brute_secrets(text)


def test_secrets_query(docs, rows, no_docs):
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(rows) and secrets.scan_secrets(no_docs).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            assert by_id[doc_id].base_sha256 == digest(brute_secrets(text or ""))
    assert sum(r.n_added for r in got) == 1
