import random
import time
from html import escape
from html.parser import HTMLParser

import pytest

from dockyard.llm.html_text import extract_text, op10_html_extraction, visible_text

WORDS = "alpha beta gamma delta epsilon x1 & < naïve".split()


def made(r: random.Random, depth: int, inside: str = "") -> tuple[str, list[str]]:
    """A random block of well-formed markup with optional end tags left out, and its lines by the plain rules of layout:
    each kind of block written out by hand, "" for a blank line asked for."""
    words = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 5)))
    kind = r.choice(["p", "h2", "plain", "hidden", "ul", "ol", "table", "div", "pre", "quote"] if depth else ["p", "plain", "hidden", "pre"])
    if kind in ("p", "h2"):
        inline = escape(words).replace(" ", r.choice([" ", "\n  ", " <i></i>", "<b> </b>"]))
        return f"<{kind}>{inline}" + (f"</{kind}>" if kind == "h2" or r.random() < 0.5 else ""), ["", words, ""]
    if kind == "plain":
        return f"<div>{escape(words)}<br>{escape(words)}</div>", [words, words]
    if kind == "hidden":
        tag, end = r.choice([("<div hidden>", "</div>"), ('<p style="display: none">', "</p>"), ("<script>", "</script>"), ("<!-- ", " -->"), ("<noscript>", "</noscript>")])
        return tag + "unseen" + end, []
    if kind == "pre":
        return f"<pre>{escape(words)}\n   {escape(words)}</pre>", ["", words, "   " + words, ""]
    if kind == "table":
        cells = [[r.choice(WORDS) for _ in range(3)] for _ in range(r.randint(1, 3))]
        wide = [max(len(row[c]) for row in cells) for c in range(3)]
        lines = ["  ".join(x.ljust(w) for x, w in zip(row, wide)).rstrip() for row in cells]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(x)}" for x in row) for row in cells) + "</table>", ["", *lines, ""]
    parts = [made(r, depth - 1) for _ in range(r.randint(1, 3))]
    if kind == "div":
        return "<div>" + "".join(h for h, _ in parts) + "</div>", [x for _, lines in parts for x in lines]
    if kind == "quote":
        inner = settled([x for _, lines in parts for x in lines])
        return "<blockquote>" + "".join(h for h, _ in parts) + "</blockquote>", ["", *["  " + x if x else x for x in inner], ""]
    lines, items = [], []
    for n in range(r.randint(1, 3)):
        mark = f"{n + 1}. " if kind == "ol" else "- "
        word = r.choice(WORDS)
        items.append(f"<li>{escape(word)}" + r.choice(["", "</li>"]))
        lines.append(mark + word)
    return f"<{kind}>" + "".join(items) + f"</{kind}>", ["", *lines, ""]


def settled(lines: list[str]) -> list[str]:
    """Blank lines at the ends go and several in a row are one."""
    out: list[str] = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    return out[:-1] if out and not out[-1] else out


def test_equals_brute_force_layout():
    r = random.Random(4)
    for _ in range(400):
        parts = [made(r, 2) for _ in range(r.randint(1, 4))]
        page = r.choice(["<html><head><title>t</title><body>", "", "<!doctype html>\n"]) + "".join(h for h, _ in parts)
        assert visible_text(page) == "\n".join(settled([x for _, lines in parts for x in lines])), page


class Words(HTMLParser):
    """The words of a page by the standard library's parser: a second opinion on what is visible."""

    SKIP = {"script", "style", "head", "title", "template", "noscript", "svg", "textarea", "iframe"}
    VOID = {"br", "img", "input", "meta", "link", "hr", "col", "wbr", "area", "base", "embed", "source", "track", "param"}

    def __init__(self):
        super().__init__()
        self.stack, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        gone = tag in self.SKIP or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        if tag not in self.VOID:
            self.stack.append((tag, gone))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(gone for _, gone in self.stack):
            self.words += data.split()


def test_words_of_the_tables_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    out = op10_html_extraction(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        other = Words()
        other.feed(pages[r.page_id] or "")
        other.close()
        mine = "".join((r.text or "").split())
        assert all(w in mine for w in other.words), (r.page_id, [w for w in other.words if w not in mine])


@pytest.mark.parametrize(
    "page",
    ["<a " * 100_000, "</ " * 100_000, '<a "x>y"' * 20_000, "<" * 200_000, "<!--" * 50_000, "<script>" + "</script " * 50_000, "<a '\"" * 50_000 + ">",
     "<table><tr>" + "<td colspan=1000 rowspan=1000>x" * 40 + "<tr><td>y" * 40, "<table><tr>" + "<td rowspan=1000>x" * 3000 + "<tr><td>y" * 1000,
     "<blockquote>" * 300 + "a<br>" * 10_000, "<table><tr>" + ("<td>" + "w" * 60) * 1000 + ("<tr>" + "<td colspan=1000>" * 2 + "<td>z") * 1000],
)
def test_hostile_pages_end_soon(page):
    began = time.process_time()
    out = visible_text(page)
    assert time.process_time() - began < 3 and len(out) < 20 * len(page) + 100


def test_spans_share_columns():
    assert visible_text("<table><tr><td rowspan=3>a<td>b<tr><td>c<td rowspan=2>d<tr><td>e</table>") == "a  b\n   c  d\n   e"


def test_blocks_lists_tables_and_visibility():
    html = """<html><head><title>x</title></head><body><h1>Hi  <b>you</b></h1><p>One<p>Two &amp; three<br>line
    <ul><li>a<li>b<ol start=3><li>c</ol><li>d</ul><table><tr><th>Name<th>N<tr><td>abc<td>1<tr><td>longer one<td>22</table>
    <div style="display:none">no</div><div hidden>no</div><pre>  x\n   y</pre><script>if(a<b){}</script>tail <i>it</i>. 1 < 2
    <span style="visibility:hidden">gone <b style="visibility:visible">back</b></span>"""
    assert visible_text(html).split("\n") == [
        "Hi you", "", "One", "", "Two & three", "line", "", "- a", "- b", "  3. c", "- d", "",
        "Name        N", "abc         1", "longer one  22", "", "  x", "   y", "", "tail it. 1 < 2 back",
    ]


def test_spans_of_cells_and_details():
    assert visible_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert visible_text("<table><tr><td colspan=2>wide cell<tr><td>x<td>y</table>") == "wide cell\nx  y"
    assert visible_text("<details><summary>S</summary>hidden</details>") == "S"
    assert visible_text("<details open><summary>S</summary>seen</details>") == "S\nseen"


def test_odd_input():
    for html, text in [("", ""), (None, None), ("a <", "a <"), ("plain  text", "plain text"), ("<!-- x", ""), ("</p>x", "x"),
                       ("<td>x", "x"), ("<li>x", "x"), ("<ul>x<b>y</b></ul>", "xy"), ("<a href='x", "<a href='x"), ("a&nbsp;b", "a\xa0b")]:
        assert visible_text(html) == text, html
    assert visible_text("<div>" * 20_000 + "deep") == "deep"
    assert visible_text("<table><tr><td>" * 200 + "deep") == "deep"
    assert len(visible_text("<p>word</p>" * 50_000)) == 50_000 * 6 - 2


def test_operator(spark):
    df = spark.createDataFrame([(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, "u"), (None, "", None)], "page_id long, html string, text string")
    assert sorted(map(tuple, extract_text(df).collect()), key=str) == [(1, "a"), (1, "a"), (2, None), (None, "")]
    assert extract_text(df.limit(0)).count() == 0
    assert extract_text(df.withColumn("_html", df.html).withColumn("x", df.text)).columns == ["page_id", "text"]
