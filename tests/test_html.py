"""The per-document operators: stated cases, limits and properties."""

import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.operators import grid, render, scan, tree
from tagloom.plans.selector import Selector, SelectorError, parse_selector

MARKUP = st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href=x>", "</a>", "<!--", "-->", "<script>", "</script>", "<h1>", "</h1>", "<pre>", "\n", "x", "&amp;", "&", "<", ">", "\0", "<br/>", "<title>", "</title>"]), max_size=40).map("".join)


@pytest.mark.parametrize(
    ("html", "tokens"),
    [
        ("<img src=a src=b>", [("StartTag", "img", [("src", "a")], False)]),
        ("<br/>", [("StartTag", "br", [], True)]),
        ("<div a=1/>", [("StartTag", "div", [("a", "1/")], False)]),
        ("<a =b>", [("StartTag", "a", [("=b", "")], False)]),
        ("</>x</ p><?q?>", [("Character", "x"), ("Comment", " p"), ("Comment", "?q?")]),
        ("<![CDATA[x]]>", [("Comment", "[CDATA[x]]")]),
        ("<!--><!---><!--a--!>b<!--c-", [("Comment", ""), ("Comment", ""), ("Comment", "a"), ("Character", "b"), ("Comment", "c")]),
        ("a<b c='d", [("Character", "a")]),
        ("</", [("Character", "</")]),
        ("<a href='&notin&not=&amp;x&ampy'>", [("StartTag", "a", [("href", "&notin&not=&x&ampy")], False)]),
        ("<title>\0<b>&lt;</TITLE >", [("StartTag", "title", [], False), ("Character", "�<b><"), ("EndTag", "title")]),
        ("<script><!--<script></script></script>x", [("StartTag", "script", [], False), ("Character", "<!--<script></script>"), ("EndTag", "script"), ("Character", "x")]),
        ("<script><!--></script>x", [("StartTag", "script", [], False), ("Character", "<!-->"), ("EndTag", "script"), ("Character", "x")]),
        ('<!DOCTYPE h PUBLIC "p" \'s\'><!doctype><!doctype a system>', [("DOCTYPE", "h", "p", "s", True), ("DOCTYPE", None, None, None, False), ("DOCTYPE", "a", None, None, False)]),
        ("a\r\nb\rc", [("Character", "a\nb\nc")]),
        ("\0", [("Character", "\0")]),
    ],
)
def test_tokens(html, tokens):
    assert scan.tokenize(html) == tokens


def test_states():
    assert scan.tokenize_state("a&amp;</b>x", "rcdata", "b") == [("Character", "a&"), ("EndTag", "b"), ("Character", "x")]
    assert scan.tokenize_state("a&amp;</b>", "rawtext", "c") == [("Character", "a&amp;</b>")]
    assert scan.tokenize_state("x]]><i>", "cdata") == [("Character", "x"), ("StartTag", "i", [], False)]
    assert scan.tokenize_state("<title><b>", "data")[1][0] == "StartTag"
    with pytest.raises(ValueError):
        scan.tokenize_state("", "nope")


def test_bytes():
    assert scan.repair_utf8(b"a\xe2\x82b") == "a��b"
    assert scan.repair_utf8("é€".encode()) == "é€"
    began = time.perf_counter()
    assert len(scan.repair_utf8(b"a\xff" * 500_000)) == 1_000_000
    assert time.perf_counter() - began < 5


def test_depth_and_text():
    t = tree.parse("<div>" * 300 + "x" + "</div>" * 300)
    assert max(t.depth) == 257
    assert render.serialize(t) == "<div>" * 256 + "x" + "</div>" * 256
    assert render.text_content(tree.parse("<title>T</title>a<noscript>n</noscript>b")) == "ab"


def test_nodes():
    t = tree.parse("<ul>a<li>b<li>c</ul><!--d-->")
    assert [t.label(n) for n in range(len(t))] == ["Node('document', '')", "Node('element', 'ul')", "Node('text', 'a')", "Node('element', 'li')", "Node('text', 'b')", "Node('element', 'li')", "Node('text', 'c')", "Node('comment', 'd')"]
    assert (t.siblings(5), t.siblings(2), t.siblings(0), t.is_bare(), tree.parse("").is_bare()) == ([3, 5], [3, 5], [0], False, True)


def test_sanitizer_is_one_pass():
    once = {"<pre>\n\nx</pre>": "<pre>\nx</pre>", "<h1><font><h2>x": "<h1><h2>x</h2></h1>", "<p><marquee><p>x": "<p><p>x</p></p>"}
    assert {k: render.sanitize(k) for k in once} == once
    assert render.Policy().allow_tag("plaintext") == render.Policy()
    assert not render.is_safe_url("http:x", ())


@pytest.mark.parametrize("bad", ["", "p >", "p,", ",p", "[href", ":hover", "p!", "li:nth-child(x)", "a[href=]", "li:nth-child(1234567890)", "li:nth-child(١)", ":not(a b)", "a[b='c]"])
def test_bad_selectors(bad):
    with pytest.raises(SelectorError):
        parse_selector(bad)


def test_selector_offset_and_subtree():
    with pytest.raises(SelectorError) as e:
        parse_selector(":nth-child( x)")
    assert (e.value.offset, str(e.value)) == (12, "BAD_SELECTOR at character 12")
    assert e.value.code == "BAD_SELECTOR"
    t = tree.parse("<div><p>a</p><div><p>b</p></div></div>")
    inner = Selector("div div").select(t)[0]
    assert [render.text_content(t, n) for n in Selector("div > p").select(t, inner)] == ["b"]
    assert not Selector("*").matches(t, 0)


def test_table_limits():
    wide = grid.tables(tree.parse("<table><tr><th colspan=1200>x<th>y</table>"))[0]
    assert [len(x) for x in wide] == [1001]
    full = grid.tables(tree.parse("<table>" + "<tr><td colspan=800>x<td>y" * 1300 + "</table>"))[0]
    assert (len(full), len(full[-2]), len(full[-1])) == (1249, 801, 1_000_000 - 1248 * 801)
    held = grid.tables(tree.parse("<table><tr><td rowspan=3 colspan=2>a<tr><td>b<tr><tr><td>c</table>"))[0]
    assert held == [["a", "a"], ["a", "a", "b"], ["a", "a"], ["c"]]
    assert [grid.span(x, 9) for x in (None, "", "0", " +3", "x", "12345678901", "2px")] == [1, 1, 1, 3, 1, 9, 2]


@pytest.mark.parametrize("shape", ["<ol><li>y</li><!--c-->{}</ol>", "<dl><dt>k<dd>v{}</dl>", "<p title='q'>a<b>b</b>{}", "&amp;&nosuch{}", "<![CDATA[{}", "<x y='{}", "<script><!--{}", "</script <"])
def test_time_grows_with_the_input(shape):
    def seconds(n: int) -> float:
        head, _, tail = shape.partition("{}")
        html = head * n + tail
        began = time.perf_counter()
        t = tree.parse(html)
        for s in ("li ~ li", "dd + dt", "p b:only-child", "ol ol > *, :nth-last-child(3n)"):
            Selector(s).select(t)
        render.extract_text(t), render.sanitize(html)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 40 * max(seconds(2_000), 0.02)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_escape_round_trip(text):
    assert scan.decode_entities(render.escape_attr(text)) == text


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_any_markup(html):
    t = tree.parse(html)
    assert all(t.parent[n] < n <= t.last[n] for n in range(1, len(t.kind)))
    clean = render.sanitize(html)
    assert "<script" not in clean
    assert "<!--" not in clean
    render.extract_text(t), grid.tables(t), grid.meta(t), render.serialize(t)


PLAIN = st.lists(st.sampled_from(["<tr>", "</tr>", "<td>x</td>", "<th> a \n\x0bb </th>", "<td></td>", "<tr><td>y</td></tr>", "<tr></tr>", "\n", " ", "z", "<td>", "</td>", "&lt;", "\r", "\0", "<td>a</th>", "<table>", "</table>", "<tbody>", "</tbody>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PLAIN, st.sampled_from(["<table>", "<table><tbody>"]), st.sampled_from(["</table>", "</tbody></table>", ""]))
def test_plain_tables_without_a_tree(rows, start, end):
    html = start + rows + end
    assert grid.grids(html) == grid.tables(tree.parse(html))


@settings(max_examples=100, deadline=None)
@given(st.text(string.printable))
def test_text_only(text):
    plain = render.escape_text(text.replace("\r", ""))
    assert render.text_content(tree.parse(plain)) == text.replace("\r", "")
