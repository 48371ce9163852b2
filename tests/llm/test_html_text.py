"""What a page shows, case by case; nothing visible is lost; odd markup stays cheap."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import html_text as H
from tidewatch.llm.queries import QUERIES

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("a<br>b<br/><br>c", "a\nb\n\nc"), ("x &lt;b&gt; &amp; y&nbsp;z &eacute;", "x <b> & y z é"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<table><tr><th>Name<th>Age<tr><td>Jo<td>7<tr><td>Maria<td>31</table>", "Name   Age\nJo     7\nMaria  31"),
    ("<table><td>a<td rowspan=2>b<tr><td>c<tr><td colspan=2>wide one<td>d</table>", "a         b\nc\nwide one     d"),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        y\nin  ner"),
    ("<style>p{}</style><script>if(a<b)'</p>'</script><p>seen", "seen"),
    ("<head><title>t</title><meta x></head><body>b", "b"), ("<head><title>t</title><p>no end", "no end"),
    ("<p hidden>a</p><p style='color:red; display : none'>b</p><p style=\"visibility:hidden\">c</p>d", "d"),
    ("<details><summary>s</summary>in</details><details open><summary>s2</summary>in2</details>", "s\ns2\nin2"),
    ("<dialog>no</dialog><dialog open>yes</dialog><template>no</template><noscript>ns</noscript>", "yes\nns"),
    ("<pre>a  b\n  c\n\nd</pre>e", "a  b\n  c\n\nd\n\ne"), ("<h1>T</h1>text<h2>U<h3>V</h2>w", "T\n\ntext\n\nU\n\nV\n\nw"),
    ("<!-- <p>no --> a <!doctype html><?x?> b </ >c", "a b c"), ("3 < 4 <5 a<", "3 < 4 <5 a<"),
    ("a<b>c</b>d <i>e</i> f", "acd e f"), ("a <a title=\"x > y\">link</a>", "a link"), ("open <a href='x", "open"),
    ("<dl><dt>t<dd>one<dd>two</dl>", "t\n  one\n  two"), ("<select><option>a<option>b</select>", "a\nb"),
    ("a</p>b</div></li></td>c", "abc"), ("<body>x</body></html> y", "x y"), ("<textarea>a &lt; b</textarea>", "a < b"),
    ("<li>loose<li>items", "- loose\n- items"), ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("<a='b'>t", "<a='b'>t"[7:]), ("<p it's>quote</p>'", "quote\n\n'"),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_pages(page, expected):
    assert H.text_of(page) == expected


TAGS = "p div li ul ol table tr td th b a h1 pre dd dl option blockquote tbody caption span".split()
PIECE = st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ["<br>", "<hr>", " ", "\n"]) | st.integers(0, 999).map(
    lambda n: f" word{n} ")


@given(st.lists(PIECE, max_size=60))
@settings(max_examples=800, deadline=None)
def test_every_visible_word_shows_once(pieces):
    page = "".join(pieces)
    assert sorted(re.findall(r"word\d+", H.text_of(page))) == sorted(re.findall(r"word\d+", page))


@given(st.text("<>/!-='\" pabr&;x\n", max_size=80))
@settings(max_examples=800, deadline=None)
def test_any_text_is_read(page):
    H.text_of(page)


@pytest.mark.parametrize("page", [
    "<div>" * 50_000, "<ul><li>x" * 20_000, "<table><tr><td>x" * 5_000, "<b>" * 50_000 + "</i>" * 50_000, "<a \"" * 60_000,
    "<a x='" * 50_001, "<" * 200_000, "<!--" * 50_000, "<p>" * 50_000, "<script>" * 30_000, "=\"" * 100_000 + "<a =\"" * 50_001,
    "<table>" + f"<tr><td>{'w ' * 500}<td>x" * 300, "<td colspan=1000 rowspan=99999>x" * 3_000, " \xa0" * 100_000,
])
def test_odd_pages_stay_cheap(page):
    began = time.process_time()
    assert len(H.text_of(page)) < 3 * len(page) + 1_500_000
    assert time.process_time() - began < 20


def test_query_and_edge_rows(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op4_html_text"](spark, folder).collect()
    assert {r.page_id: r.text for r in found} == {k: H.text_of(v) for k, v in pages.items()}
    assert all(r.n_chars == len(r.text) for r in found) and not any("<p" in r.text for r in found)
    rows = [(None, None, "a"), (1, "", "b"), (1, "<p>x", "c"), (1, "<p>x", "c")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(r.text for r in H.extract(frame).collect()) == ["", "", "x", "x"]
    assert H.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("page,expected", [
    ("<p><svg class=i /> seen</p>", "seen"), ("<body><svg/>rest<p>of it</body>", "rest\n\nof it"),
    ("a <svg><title>t</title><desc>d</desc><defs><text>n</text></defs><path d=x /><text>seen</text><text>too</text></svg>", "a\nseen\ntoo"),
    ("<svg><title/><style/><text>x</text></svg>y", "x\ny"), ("<svg><foreignObject><div/>in</div></foreignObject><g/></svg>b", "in\nb"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2 again</annotation></math> <math/>so", "x=2 so"),
    ("<object data=x><param name=a>fallback</object> b", "fallback b"), ("<svg><g>open<p>out<div/>of it", "open\n\nout\n\nof it"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i>and</i></b><p>no</p></div>d", "yesand\n\nd"),
    ("<div style='visibility:hidden'>no<p style='display:none;visibility:visible'>no</p></div>d", "d"),
    ("<svg><text visibility=hidden>no<tspan visibility=visible>yes</tspan></text><text display=none>no</text></svg>", "yes"),
    ("<desc>shown</desc> <defs>too</defs>", "shown too"), ("<div/>in<p/>x", "in\n\nx"),
])
def test_pictures_formulas_and_inherited_visibility(page, expected):
    assert H.text_of(page) == expected


def test_many_foreign_elements_stay_cheap():
    began = time.process_time()
    H.text_of("<svg>" + "<g>" * 30_000 + "<path/>" * 30_000 + "<svg><foreignObject>" * 10_000 + "<p>" * 10_000)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("page,expected", [
    ("<style>.x{display:none}</style><p class=x>hid</p>seen", "seen"), ("<p class='a x'>hid</p>b<style>.x{display:none}</style>", "b"),
    ("<style>#i, em {visibility : hidden}</style><p id=i>no<b style='visibility:visible'>yes</b></p><em>no</em>d", "yes\n\nd"),
    ("<style>p.x{display:none} /* .y{display:none} */</style><p class=x>no</p><div class=x>a</div><p class=y>b", "a\n\nb"),
    ("<style>.x{display:none}.x.y{display:block}</style><i class='x y'>a</i><i class=x>no</i>", "a"),
    ("<style>.x{display:none}#i{display:inline}i{display:none}</style><i class=x id=i>a</i><i>no</i>", "a"),
    ("<style>.x{display:none}</style><i class=x style='display:inline'>a</i>", "a"),
    ("<style>.x{display:none!important}</style><i class=x style='display:inline'>no</i>b", "b"),
    ("<style>.x{display:none}.x{display:block}</style><i class=x>a</i>", "a"),
    ("<style>@media print{.x{display:none}}@media screen{.y{display:none}}.z{display:none}</style>"
     "<i class=x>a</i><i class=y>no</i><i class=z>no</i>", "a"),
    ("<style media=print>.x{display:none}</style><style>@import 'a';.y{display:none}</style><i class=x>a</i><i class=y>no</i>", "a"),
    ("<style>div .x,.x:hover,[a]{display:none}</style><div><i class=x>a</i></div>", "a"),
    ("<style>}}{.x{display:none</style><i class=x>a</i>", "a"), ("<style>*{visibility:hidden}b{visibility:visible}</style>no<b>a</b>", "a"),  # loose text is in the body
    ("<form>x<input type=submit value=Go><input value='a  b'><input type=hidden value=no><input type=password value=no>y", "x Go a b y"),
    ("<div style='visibility:hidden'><input value=no></div>a", "a"), ("<input>a<input value=''>b", "a b"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"), ("<ol type=I><li>x<li value=9>y</ol>", "I. x\nIX. y"),
    ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
])
def test_style_elements_inputs_and_list_types(page, expected):
    assert H.text_of(page) == expected


def test_many_rules_stay_cheap():
    began = time.process_time()
    page = "<style>" + "".join(f".x.a{i}{{display:none}}" for i in range(20_000)) + "</style>" + "<i class='x a1'>no</i><i class=x>y</i>" * 20_000
    assert H.text_of(page) == "y" * 20_000
    H.text_of("<style>" + "{" * 100_000 + "</style>" + "<style>/*" * 20_000)
    assert time.process_time() - began < 20
