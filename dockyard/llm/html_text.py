"""HTML extraction: layout-aware rendering of all visible text.

A regular expression cuts the markup into tags and text, a tree builder supplies the tags that HTML lets
authors leave out, visibility rules drop what a browser would not show, and a renderer keeps the layout:
blank lines between blocks, markers and indents of lists, and cells of tables lined up in columns.
Spark deals out the pages; each is rendered on its own in a pandas UDF, so there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockyard.llm.shared import table

# Names of elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset(
    "head title script style noscript template iframe object audio video canvas svg math datalist noembed noframes "
    "area base link meta param source track".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table ul caption tr td th tbody thead tfoot".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl ul ol menu dir article section hr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends open elements of the second set, up to the nearest one of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "caption": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: An end tag does not reach beyond these, unless it is their own.
WALLS = frozenset("table td th caption html".split())

#: What a ``<`` may begin; where a tag ends is for ``Scanner.close``.
OPENS = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)|</")
COMMENT_ENDS = re.compile(r"--!?>")
STOPS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HIDES = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Elements within one another; characters of a cell that its column is as wide as, of a line that cells are lined up
#: in, and of indents. Beyond these text is laid out more simply; none is left out.
DEEPEST, WIDEST, LONGEST, INDENT = 400, 60, 1000, 60


class Scanner:
    """Cuts markup into text and tags, in a time that is linear in its length whatever it holds."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.dead: set[int] = set()  # quotes of tags that never close

    def close(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends: at the first ``>`` outside quotes or, if all are within, at the first."""
        html, i, seen = self.html, at, []
        while i <= self.last and (m := STOPS.search(html, i)):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            i = html.find(m[0], m.end()) + 1
            if not i:
                break
        self.dead.update(seen)
        return html.find(">", at) if at <= self.last else -1

    def tokens(self, at: int = 0) -> Iterator[tuple]:
        """Text as (text,), tags as (name, is an end tag, attributes, where the tag ends); ``send`` moves on."""
        html, size = self.html, len(self.html)
        while at < size:
            m = OPENS.search(html, at)
            start, stop = (m.start(), -1) if m else (size, -1)
            if m and m[0] == "<!--":
                short = html[start + 4 : start + 6]
                found = None if short[:1] == ">" or short == "->" else COMMENT_ENDS.search(html, start + 4)
                stop = start + 4 + short.index(">") + 1 if short[:1] == ">" or short == "->" else found.end() if found else size
            elif m and m[0] == "<![CDATA[":
                end = html.find("]]>", m.end())
                yield (unescape(html[at:start]) + html[m.end() : size if end < 0 else end],)
                at = size if end < 0 else end + 3
                continue
            elif m and m["name"] is None:
                end = html.find(">", m.end()) if start <= self.last else -1
                stop = end + 1 if end >= 0 else size if m[0] != "</" else -1
            elif m:
                end = self.close(m.end())
                if end >= 0:
                    if start > at:
                        yield (unescape(html[at:start]),)
                    at = (yield m["name"].lower(), bool(m["end"]), html[m.end() : end], end + 1) or end + 1
                    continue
            if m and stop < 0:  # no tag ends any more: the rest is text
                start = stop = size
            if start > at:
                yield (unescape(html[at:start]),)
            at = max(stop, start)


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def parse(html: str) -> Node:
    """The tree of a document. Elements deeper than ``DEEPEST`` hang on the last level, as browsers do."""
    root = Node("#root", {})
    stack = [root]

    def close_to(at: int) -> None:
        del stack[at:]

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(text)

    def start(name: str, attrs: dict[str, str]) -> Node:
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close_to(i)
                    break
                if stack[i].name in WALLS or stack[i].name == "button":
                    break
        if name in HEADINGS and stack[-1].name in HEADINGS:
            close_to(len(stack) - 1)
        if name in IMPLIED:
            ends, until = IMPLIED[name]
            lowest = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    lowest = i
                elif stack[i].name in until:
                    break
            if lowest:
                close_to(lowest)
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            start("tr", {})
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID and len(stack) <= DEEPEST:
            stack.append(node)
        return node

    size, scanner = len(html), Scanner(html)
    tokens, onward = scanner.tokens(), None
    while True:
        try:
            token = tokens.send(onward)
        except StopIteration:
            break
        onward = None
        if len(token) == 1:
            say(token[0])
            continue
        name, ends, written, at = token
        if ends:
            if name == "br":
                start("br", {})
            elif name == "p" and not any(n.name == "p" for n in stack):
                start("p", {})
                close_to(len(stack) - 1)
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name or (name in HEADINGS and stack[i].name in HEADINGS):
                        close_to(i)
                        break
                    if stack[i].name in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        attrs: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(written):
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        node = start(name, attrs)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            after = html.find(">", end.end()) if end else -1
            body = html[at : end.start() if after >= 0 else size]
            if name in ("textarea", "title"):
                body = unescape(body)
            node.children.append(body)
            onward = after + 1 if after >= 0 else size
            if stack[-1] is node:
                close_to(len(stack) - 1)
    return root


class Page:
    """Collects lines; runs of white space collapse across elements, blank lines are asked for, not written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.prefix = ""
        self.marker = ""

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s[:1] == " ":
            self.space = True
        body = s.strip(" ")
        if not body:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(body)
        self.space = s[-1] == " "

    def end_line(self) -> None:
        if self.now:
            self.put("".join(self.now))
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.prefix[:INDENT]
        if self.marker:
            lead, self.marker = self.prefix[: -len(self.marker)][:INDENT] + self.marker, ""
        self.lines.append((lead + line).rstrip())

    def gap(self, blank: bool) -> None:
        self.end_line()
        self.blank |= blank

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def shown(node: Node) -> bool:
    a = node.attrs
    if node.name in NEVER_SHOWN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.name == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.name == "dialog" and "open" not in a:
        return False
    return not ("style" in a and HIDES.search(a["style"]))


def render(node: Node, page: Page, visible: bool = True, pre: bool = False, depth: int = 0) -> None:
    for i, child in enumerate(node.children):
        if isinstance(child, str):
            if not visible:
                continue
            if pre:
                head, *more = child.replace("\r\n", "\n").split("\n")
                page.now.append(head)
                for line in more:
                    page.put("".join(page.now))
                    page.now = [line]
            else:
                page.text(child)
            continue
        if not shown(child):
            continue
        name, sees = child.name, visible
        if "style" in child.attrs and (m := VISIBILITY.search(child.attrs["style"])):
            sees = m[1].lower() not in ("hidden", "collapse")
        if name == "br":
            if page.now or not visible:
                page.end_line()
            elif page.lines:
                page.blank = True
            continue
        if name == "details" and "open" not in child.attrs:
            child = Node(name, child.attrs) if not child.children else _summary(child)
        if name == "input":
            kind = child.attrs.get("type", "text").lower()
            if sees and kind in ("submit", "button", "reset") and child.attrs.get("value"):
                page.text(f" {child.attrs['value']} ")
            continue
        if name == "table":
            page.gap(True)
            if sees:
                for line in grid(child, depth):
                    page.put(line)
            page.gap(True)
            continue
        block = name in BLOCKS
        if block:
            page.gap(name in SPACED and not (depth and name in ("ul", "ol", "menu", "dir")))
        if name == "pre":
            render(child, page, sees, True, depth)
        elif name in ("ul", "ol", "menu", "dir"):
            items(child, page, sees, depth)
        elif name == "blockquote" or name == "dd":
            before, page.prefix = page.prefix, page.prefix + "  "
            render(child, page, sees, pre, depth)
            page.end_line()
            page.prefix = before
        else:
            render(child, page, sees, pre, depth)
        if name == "pre" and page.now and not "".join(page.now).strip():
            page.now = []
        if block:
            page.gap(name in SPACED and not (depth and name in ("ul", "ol", "menu", "dir")))


def _summary(details: Node) -> Node:
    out = Node("details", details.attrs)
    out.children = [c for c in details.children if isinstance(c, Node) and c.name == "summary"][:1]
    return out


def _whole(text: str, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text)
    return int(m[1]) if m else default


def items(node: Node, page: Page, visible: bool, depth: int) -> None:
    number = _whole(node.attrs.get("start", ""), 1)
    for child in node.children:
        if isinstance(child, str) or child.name != "li":
            own = Node("#item", {})
            own.children = [child]
            render(own, page, visible, False, depth + 1)
            continue
        if not shown(child):
            continue
        if node.name == "ol":
            number = _whole(child.attrs.get("value", ""), number)
            marker = f"{number}. "
            number += 1
        else:
            marker = "- "
        page.gap(False)
        before, page.prefix = page.prefix, page.prefix + " " * len(marker)
        page.marker = marker
        own = Node("#item", {})
        sees = visible
        if "style" in child.attrs and (m := VISIBILITY.search(child.attrs["style"])):
            sees = m[1].lower() not in ("hidden", "collapse")
        own.children = child.children
        render(own, page, sees, False, depth + 1)
        page.gap(False)
        page.prefix, page.marker = before, ""


def grid(node: Node, depth: int) -> list[str]:
    """Lines of a table: the caption, then rows of cells in columns of one width each, up to ``WIDEST``; see ``extract_text``."""
    heads, bodies, feet, above = [], [], [], []
    queue = [(c, "") for c in node.children]
    for child, part in queue:
        if isinstance(child, str):
            if child.strip():
                above.append(child)
        elif not shown(child):
            continue
        elif child.name == "tr":
            {"thead": heads, "tfoot": feet}.get(part, bodies).append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            for c in child.children:
                if isinstance(c, Node) and c.name == "tr" and shown(c):
                    {"thead": heads, "tfoot": feet}.get(child.name, bodies).append(c)
                elif isinstance(c, Node) or c.strip():
                    above.append(c)
        elif child.name not in ("colgroup", "col"):
            above.append(child)
    out: list[str] = []
    if above:
        own, page = Node("#above", {}), Page()
        own.children = above
        render(own, page, True, False, depth + 1)
        if text := page.result():
            out += text.split("\n")
    placed: list[list[tuple[int, list[str], bool]]] = []
    held: list[tuple[int, int, int]] = []  # columns from, to, and the row before which cells of earlier rows end
    for r, row in enumerate(heads + bodies + feet):
        line, col, ahead, mine = [], 0, 0, []
        held = [x for x in held if x[2] > r]
        sees = "hidden" != (VISIBILITY.search(row.attrs.get("style", "")) or [0, ""])[1].lower()
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip():
                continue
            if isinstance(cell, Node) and not shown(cell):
                continue
            while ahead < len(held) and held[ahead][0] <= col:
                col = max(col, held[ahead][1])
                ahead += 1
            page, own = Page(), Node("#cell", {})
            attrs = cell.attrs if isinstance(cell, Node) else {}
            own.children = cell.children if isinstance(cell, Node) and cell.name in ("td", "th") else [cell]
            hides = VISIBILITY.search(attrs.get("style", ""))
            render(own, page, sees if not hides else hides[1].lower() not in ("hidden", "collapse"), False, depth + 1)
            across = min(1000, max(1, _whole(attrs.get("colspan", ""), 1)))
            down = min(1000, max(1, _whole(attrs.get("rowspan", ""), 1)))
            line.append((col, page.result().split("\n"), across > 1))
            if down > 1:
                if mine and mine[-1][1:] == (col, r + down):
                    mine[-1] = (mine[-1][0], col + across, r + down)
                else:
                    mine.append((col, col + across, r + down))
            col += across
        held = sorted(held + mine) if mine else held
        placed.append(line)
    widths: dict[int, int] = {}
    for line in placed:
        for col, lines, wide in line:
            if not wide:
                widths[col] = max(widths.get(col, 0), min(WIDEST, max(map(len, lines))))
    columns, begins = sorted(c for c in widths if widths[c]), [0]
    for col in columns:
        begins.append(begins[-1] + widths[col] + 2)
    for line in placed:
        for k in range(max([0, *(len(x) for _, x, _ in line)])):
            text = ""
            for col, lines, _ in line:
                piece = lines[k] if k < len(lines) else ""
                if piece:
                    begin = begins[bisect_left(columns, col)]
                    text = text.ljust(begin) if (len(text) < begin or not text) and begin <= LONGEST else text + "  " if text else text
                    text += piece
            if text:
                out.append(text.rstrip())
    return out


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    page = Page()
    render(parse(html), page)
    return page.result()


@F.pandas_udf(T.StringType())
def _rendered(html: pd.Series) -> pd.Series:
    return html.map(visible_text, na_action="ignore")


def extract_text(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` and ``text``, the visible text of each page.

    A null page gives a null text, an empty one or one without visible text an empty text; plain text stays as
    it is but for its white space. Malformed markup never fails: what can't be a tag is text, and a tag whose quotes
    never close ends at its first ``>``. Pages of any length are rendered whole, in a time about linear in it. Elements
    more than ``DEEPEST`` within one another count as that deep; spans reach 1,000 columns or rows, as in HTML, and no
    further than the rows there are; columns are as wide as their widest cell, but ``WIDEST`` characters at most, and
    cells are lined up in the first ``LONGEST`` characters of a line; indents stop at ``INDENT``. Repeated rows are each
    rendered; an empty table gives an empty result; other columns are not read, so their names can't clash.
    """
    return pages.select(*keep, _rendered(F.col(html)).alias("text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
