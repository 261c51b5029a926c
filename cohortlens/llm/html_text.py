"""HTML extraction by layout-aware rendering.

A tree builder reads the tags (implied ``html``/``head``/``body``, ``p``, ``li``, ``dt``/``dd``, ``option``,
``tr``, ``td``, ``tbody`` and their implied ends; void elements; raw text), visibility rules drop what a
browser doesn't show (``head``, scripts, styles, templates, comments, ``hidden``, ``display:none``,
closed ``details``; what ``visibility`` hides, but for parts that it shows again), and a renderer emits all
the rest: blocks on lines of their own with blank lines around paragraphs and headings, list
items with bullets or numbers and indents, table rows with aligned cells, ``pre`` as it stands.

The tags are read once from left to right, and tree and text are made with stacks of their own, so that
neither broken markup nor any depth costs more than its length (cells of tables within tables are laid out
once for each table around them).

Defined cases: null html gives null text; empty html, or one without visible text, gives an empty
string; html without tags is rendered as text; elements that are never closed end with the
page; a tag whose quote is never closed ends at the next ``>``, and is text if there is none; indents
grow to ``INDENT`` columns; repeated rows each give a row; an empty table gives an empty result; a
clashing output column is replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

INDENT = 120  # columns: deeper lists and quotes are not indented further

# Element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object video audio canvas "
                   "svg math datalist map meta link base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
                  "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul "
                  "caption xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp table figure hr fieldset".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: a start tag of the key ends an open element of the value, up to one of the walls
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th", "caption", "colgroup"),
    "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"),
}
WALLS = {
    "li": ("ul", "ol", "menu", "dir", "table", "td", "th"), "dt": ("dl", "table", "td", "th"),
    "dd": ("dl", "table", "td", "th"), "option": ("select", "datalist"), "optgroup": ("select",),
    "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",),
    "tfoot": ("table",),
}
#: blocks that end an open paragraph
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend summary".split())
#: an end tag doesn't reach out of these
SCOPES = frozenset("html body td th table caption".split())

_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_UNQUOTED = re.compile(r"[^>\"']*+")
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.children = name, attrs, []


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Builder:
    """The tree of a page; ``open`` is the path of open elements, ``places`` where each name stands in it."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.body = Node("body", {})
        self.root.children.append(self.body)
        self.head: Node | None = None
        self.open = [self.root, self.body]
        self.places: dict[str, list[int]] = {}

    def _end_to(self, at: int) -> None:
        while len(self.open) > max(at, 2):
            self.places[self.open.pop().name].pop()

    def _last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _nearest(self, names, walls) -> int:
        """Place of the innermost open element of these names, unless a wall is further in; else -1."""
        at = self._last(names)
        return at if at > self._last(walls) else -1

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body"):
            target = self.root if name == "html" else self.body
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            if name == "body":
                self._leave_head()
            return
        if name == "head":
            if self.head is None and len(self.open) == 2 and not self.body.children:
                self.head = Node("head", attrs)
                self.root.children.insert(0, self.head)
                self._enter(self.head)
            return
        if name not in HEAD_ONLY:
            self._leave_head()
        if name in CLOSES_P and (at := self._nearest(("p",), SCOPES)) >= 0:
            self._end_to(at)
        if name in ENDS:
            while (at := self._nearest(ENDS[name], WALLS[name])) >= 0:
                self._end_to(at)
        if name in ("td", "th") and self._nearest(("tr",), ("table",)) < 0 and self._nearest(("table",), ()) >= 0:
            self._push(Node("tr", {}))
        if name == "tr" and self.open[-1].name == "table":
            self._push(Node("tbody", {}))
        if name in _HEADING and self.open[-1].name in _HEADING:
            self._end_to(len(self.open) - 1)
        node = Node(name, attrs)
        if name in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self._enter(node)

    def _enter(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.open))
        self.open.append(node)

    def _leave_head(self) -> None:
        if len(self.open) > 2 and self.open[2] is self.head:
            self._end_to(2)

    def end(self, name: str) -> None:
        if name == "p" and self._nearest(("p",), SCOPES) < 0:
            self.start("p", {})  # as browsers do: a stray end makes an empty paragraph
        if name == "br":
            self.start("br", {})
            return
        walls = () if name in SCOPES or name in ("tr", "tbody", "thead", "tfoot") else SCOPES
        names = _HEADING if name in _HEADING else (name,)
        if (at := self._nearest(names, walls)) >= 0:
            self._end_to(at)

    def text(self, data: str) -> None:
        if data:
            if self.open[-1] is self.head and data.strip():
                self._leave_head()
            self.open[-1].children.append(data)


class Source:
    """A page read from left to right; what a search has found holds until the reader has passed it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ahead: dict[str, int] = {}
        self.endless: set[int] = set()  # places in tags from which no tag end follows outside quotes

    def find(self, what: str, at: int) -> int:
        """The first ``what`` from ``at`` on (places asked for may only grow by ``what``), or -1."""
        known = self.ahead.get(what, 0)
        if known != -1 and known <= at:
            known = self.ahead[what] = self.text.find(what, at)
        return known

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, or -1 if a quote is never closed."""
        text, passed = self.text, []
        while at not in self.endless:
            passed.append(at)
            at = _UNQUOTED.match(text, at).end()
            if at < len(text) and text[at] == ">":
                return at
            close = text.find(text[at], at + 1) if at < len(text) else -1
            if close < 0:
                break
            at = close + 1
        self.endless.update(passed)
        return -1


def tokens(page: str):
    """``(kind, name, value)``: text, start and end tags; after the start tag of raw text, its text and end."""
    source, at, shown = Source(page), 0, 0
    while (at := page.find("<", at)) >= 0:
        after, name = at + 1, None
        if page.startswith("!--", after):
            ends = [e + n for e, n in ((source.find("-->", at + 4), 3), (source.find("--!>", at + 4), 4)) if e >= 0]
            stop = min(ends, default=len(page))
        elif page[after:after + 1] in ("!", "?"):
            stop = source.find(">", at) + 1 or len(page)
        else:
            ending = page.startswith("/", after)
            m = _NAME.match(page, after + ending)
            if m is None or source.find(">", at) < 0:
                if m is not None:
                    break  # no tag ends any more: the rest is text
                at += 1
                continue
            close = source.tag_end(m.end())
            name, attrs = m[0].lower(), page[m.end():close] if close >= 0 else ""
            stop = (close if close >= 0 else page.find(">", at)) + 1
        if at > shown:
            yield "text", "", html.unescape(page[shown:at])
        at = shown = stop
        if name is None:
            continue
        if ending:
            yield "end", name, ""
            continue
        yield "start", name, attrs
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at:stop.start()] if stop else page[at:]
            yield "raw", name, html.unescape(body) if name in ("textarea", "title") else body
            at = shown = stop.end() if stop else len(page)
    if shown < len(page):
        yield "text", "", html.unescape(page[shown:])


def parse(page: str) -> Node:
    """The tree of ``page``."""
    tree = Builder()
    for kind, name, value in tokens(page):
        if kind == "text":
            tree.text(value)
        elif kind == "end":
            tree.end(name)
        elif kind == "start":
            tree.start(name, _attrs(value))
        elif tree.open[-1].name == name:
            tree.text(value)
            tree.end(name)
    return tree.root


def _style(node: Node) -> dict[str, str]:
    """The inline declarations that bear on visibility; the last of each counts."""
    out = {}
    if "style" in node.attrs:
        for part in node.attrs["style"].lower().split(";"):
            name, _, value = part.partition(":")
            if name.strip() in ("display", "visibility"):
                out[name.strip()] = value.replace("!important", "").strip()
    return out


def rendered(node: Node) -> bool:
    """Whether the node or something in it can be seen at all."""
    if node.name in UNSEEN or "hidden" in node.attrs:
        return False
    if node.name == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return _style(node).get("display") != "none"


def shows(node: Node, inherited: bool) -> bool:
    """Whether the node's own text is visible: its own ``visibility``, or that around it."""
    own = _style(node).get("visibility")
    return own not in ("hidden", "collapse") if own in ("hidden", "collapse", "visible") else inherited


def run(work):
    """Run a generator that yields the generators it needs the results of, on a stack of its own."""
    stack, value = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Lines of text (the last one in ``parts``); ``gap`` is how many line ends are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space, self.marker = 0, False, ""
        self.indent = ""
        self.some = False  # whether there is text in any line
        self.inked = False  # whether the last line has more than blanks
        self.put_count = 0

    def due(self, n: int) -> None:
        self.gap, self.space = max(self.gap, n), False

    def _end_line(self) -> None:
        self.lines.append("".join(self.parts))
        self.parts, self.inked = [], False

    def _begin(self) -> None:
        if self.gap and self.some:
            if not self.parts and self.lines:
                self.gap -= 1
            for _ in range(self.gap):
                self._end_line()
        self.gap = 0

    def put(self, text: str) -> None:
        self._begin()
        if not self.parts:
            lead = self.indent[:len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent
            if lead:
                self.parts.append(lead)
            self.inked, self.marker, self.space = bool(self.marker), "", False
        if self.space:
            self.parts.append(" ")
        self.parts.append(text)
        self.some, self.inked, self.space = True, self.inked or not text.isspace(), False
        self.put_count += 1

    def words(self, text: str) -> None:
        """Running text: blanks collapse."""
        body = _BLANK.sub(" ", text)
        core = body.strip(" ")
        if body[:1] == " " and self.gap == 0 and self.inked:
            self.space = True
        if core:
            self.put(core)
            if body[-1:] == " ":
                self.space = True

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self._begin()
                self._end_line()
            if line:
                self.put(line)
        self.space = False

    def block(self, text: str, spaced: int) -> None:
        self.due(spaced)
        for i, line in enumerate(text.split("\n")):
            if i:
                self.due(1)
                if not line:
                    self.due(2)
                    continue
            if line:
                self.put(line)
        self.due(spaced)

    def result(self) -> str:
        return "\n".join(x.rstrip(" ") for x in [*self.lines, "".join(self.parts)]).strip("\n")

    def node(self, node: Node, seen: bool, pre: bool = False):
        name = node.name
        if not rendered(node):
            return
        seen = shows(node, seen)
        if name == "br":
            self._begin()
            self._end_line()
            self.space = False
            return
        if name == "hr":
            self.due(2)
            return
        if name == "input":
            value = node.attrs.get("value", "")
            if seen and value and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "image"):
                self.words(value)
            return
        if name == "table":
            text = yield render_table(node, seen)
            self.block(text, 2)
            return
        if name in ("ul", "ol", "menu", "dir"):
            yield self.list(node, seen)
            return
        spaced = 2 if name in SPACED else 1
        before = self.indent
        if name in BLOCK:
            self.due(spaced)
        if name in ("blockquote", "dd") and len(self.indent) < INDENT:
            self.indent += "    "
        closed = name == "details" and "open" not in node.attrs
        keep = pre or name in ("pre", "textarea", "xmp")
        for i, child in enumerate(node.children):
            if not isinstance(child, str):
                if not closed or child.name == "summary":
                    yield self.node(child, seen, keep)
            elif seen and not closed:
                if keep:
                    self.raw(child.removeprefix("\n") if i == 0 and not pre else child)
                else:
                    self.words(child)
        self.indent = before
        if name in BLOCK:
            self.due(spaced)

    def list(self, node: Node, seen: bool):
        nested = bool(self.indent.strip(" ") == "" and self.indent)
        self.due(1 if nested else 2)
        try:
            number = int(node.attrs.get("start", "1"))
        except ValueError:
            number = 1
        for child in node.children:
            if isinstance(child, str):
                if seen and child.strip():
                    self.words(child)
                continue
            if child.name != "li":
                yield self.node(child, seen)
                continue
            if not rendered(child):
                continue
            shown = shows(child, seen)
            if node.name == "ol":
                try:
                    number = int(child.attrs.get("value", number))
                except ValueError:
                    pass
                marker = f"{number}. "
                number += 1
            else:
                marker = "- "
            before, count = self.indent, self.put_count
            self.due(1)
            if len(before) < INDENT:
                self.indent = before + " " * len(marker)
            self.marker = marker if shown else ""
            for c in child.children:
                if isinstance(c, str):
                    if shown:
                        self.words(c)
                else:
                    yield self.node(c, shown)
            if shown and self.put_count == count:  # an item without text keeps its line
                self.marker = marker
                self.put("")
            self.indent, self.marker = before, ""
            self.due(1)
        self.due(1 if nested else 2)


def render(nodes: list, seen: bool = True):
    """Visible text of nodes and texts."""
    out = Renderer()
    for c in nodes:
        if isinstance(c, str):
            if seen:
                out.words(c)
        else:
            yield out.node(c, seen)
    return out.result()


def _span(node: Node, name: str, most: int) -> int:
    """A span of at least 1, up to the standard's limit; a rowspan of 0 reaches as far as a row can."""
    try:
        n = int(node.attrs.get(name, "1"))
    except ValueError:
        return 1
    return most if n == 0 and name == "rowspan" else min(max(n, 1), most)


def render_table(table: Node, seen: bool):
    """Rows with their cells aligned; captions and stray content above."""
    above: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []

    def collect(node: Node, seen: bool):
        for c in node.children:
            if isinstance(c, str):
                if seen and c.strip():
                    above.append(_BLANK.sub(" ", c).strip())
            elif not rendered(c) or c.name in ("colgroup", "col"):
                continue
            elif c.name in ("tbody", "thead", "tfoot"):
                yield collect(c, shows(c, seen))
            elif c.name == "tr":
                cells, shown = [], shows(c, seen)
                for d in c.children:
                    if isinstance(d, str):
                        if shown and d.strip():
                            above.append(_BLANK.sub(" ", d).strip())
                    elif d.name in ("td", "th"):
                        text = (yield render(d.children, shows(d, shown))) if rendered(d) else ""
                        cells.append((text.split("\n"), _span(d, "colspan", 1000), _span(d, "rowspan", 65534)))
                    else:
                        above.append((yield render([d], shown)))
                rows.append(cells)
            else:
                above.append((yield render([c], seen)))

    yield collect(table, seen)
    grid: list[list[tuple[int, list[str]]]] = []  # by row: column and text of the cells that start there
    held: list[tuple[int, int, int]] = []  # columns from, to and last row of cells that reach down, in order
    for row, cells in enumerate(rows):
        line, down, at, todo = [], [], 0, iter(held)
        taken = next(todo, None)
        for text, wide, high in cells:
            while taken and taken[0] <= at:
                at, taken = max(at, taken[1]), next(todo, None)
            line.append((at, text))
            if high > 1:
                down.append((at, at + wide, row + high - 1))
            at += wide
        grid.append(line)
        held = sorted(h for h in [*held, *down] if h[2] > row)
    # columns in which no cell starts have no text to align
    columns = {c: i for i, c in enumerate(sorted({c for line in grid for c, _ in line}))}
    widths = [0] * len(columns)
    for line in grid:
        for c, text in line:
            widths[columns[c]] = max(widths[columns[c]], *map(_width, text))
    out = [x for x in above if x]
    for line in grid:
        for k in range(max((len(t) for _, t in line), default=0)):
            parts = [""] * (columns[line[-1][0]] + 1)
            for c, text in line:
                if k < len(text):
                    parts[columns[c]] = text[k]
            padded = [p + " " * (widths[i] - _width(p)) for i, p in enumerate(parts)]
            out.append(" | ".join(padded).rstrip(" |") if not any(parts) else " | ".join(padded).rstrip(" "))
    return "\n".join(x for x in out if x)


def extract_text(source: str | None) -> str | None:
    """All visible text of an HTML page."""
    if source is None:
        return None
    root = parse(source)
    if not rendered(root):
        return ""
    return run(render(root.children, shows(root, True)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every column of ``pages`` but the html, plus ``text``."""
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    schema = T.StructType([*pages.select(*rest).schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        for b in text_slices(batches, html_col):
            text = [extract_text(x) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(text, pa.string())],
                                             names=[*rest, "text"])

    return pages.select(*rest, html_col).mapInArrow(run, schema)
