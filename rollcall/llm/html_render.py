"""All visible text of HTML pages, laid out: a tree with implied tags, visibility rules, and a text renderer.

Blocks stand on lines of their own, paragraphs and headings apart by an empty line; list items carry
bullets or numbers and are indented by depth; preformatted text keeps its lines; the cells of a table
are padded to the width of their column.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tr ul xmp plaintext".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp plaintext table ul ol dl figure hr".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt legend optgroup option caption tr".split())
#: A start tag closes the open elements of the first set, up to the nearest of the second.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: Elements beyond which an end tag looks no further.
SCOPE = frozenset("table td th caption html template".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: What an SVG image holds but does not draw where it stands.
UNDRAWN = frozenset("defs symbol metadata desc clippath mask pattern marker".split())
#: What may stand in a head; anything else begins the body.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Form controls: boxes of their own within a line.
CONTROLS = frozenset("button input select textarea".split())
#: Columns are padded up to this width; what a wider cell holds is shown whole, past the column's end.
MAX_COLUMN = 80
#: The most columns that the standard lets a cell span.
MAX_SPAN = 1000

_MARKUP = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
_COMMENT_END = re.compile(r"--!?>")
_IN_TAG = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class _Ends:
    """Where tags end: at the first ">" outside quotes or, of tags with a quote that never ends, at the first one.

    No stretch of the page is searched twice in vain: a search that found nothing, and the places from which
    quotes led to the end of the page, are remembered. So the time is in proportion to the page.
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.known: dict[str, tuple[int, int]] = {}
        self.vain: set[int] = set()

    def _next(self, what: str, at: int) -> int:
        """The next of ">", or of ">" and quotes (what: ""), or the page's size."""
        start, found = self.known.get(what, (0, -1))
        if not start <= at <= found:
            if what:
                found = self.page.find(what, at)
            else:
                m = _IN_TAG.search(self.page, at)
                found = m.start() if m else -1
            found = self.size if found < 0 else found
            self.known[what] = at, found
        return found

    def after(self, at: int) -> int:
        """The place of the next ">", or the page's size."""
        return self._next(">", at)

    def of(self, at: int) -> int:
        """The place of the ">" that ends the tag whose name ends at `at`; some ">" must follow."""
        opened: list[int] = []
        q = at
        while True:
            q = self._next("", q)
            if q == self.size or q in self.vain:
                break
            if self.page[q] == ">":
                return q
            opened.append(q)
            q = self.page.find(self.page[q], q + 1) + 1
            if not q:
                break
        self.vain.update(opened)
        return self._next(">", at)


class _Open:
    """The open elements, and where those of each name stand."""

    def __init__(self, root: Node):
        self.stack, self.at, self.deepest = [root], {}, 1

    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)
        self.deepest = max(self.deepest, len(self.stack))

    def cut(self, k: int) -> None:
        """Close the k-th element (never the first) and all inside it."""
        while len(self.stack) > max(1, k):
            self.at[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost of these; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> Node:
    """The tree of a page. Text is str; unclosed and misnested tags are closed where the standard implies."""
    return _parsed(page)[0]


def _parsed(page: str) -> tuple[Node, int]:
    """The tree, and its depth."""
    root = Node("html", {})
    stack, ends = _Open(root), _Ends(page)
    at = begin = 0
    n = len(page)

    def text(stop: int) -> None:
        value = page[begin:stop]
        if value:
            if stack.top().tag == "head" and not value.isspace():
                stack.cut(len(stack.stack) - 1)
            stack.top().children.append(html.unescape(value) if "&" in value else value)

    while True:
        at = page.find("<", at)
        if at >= 0 and ends.after(at) == n:  # no tag ends any more; a comment or the like hides what follows it
            at = min((k for k in (page.find("<!", at), page.find("<?", at)) if k >= 0), default=-1)
        if at < 0:
            break
        found = _MARKUP.match(page, at)
        if not found:
            at += 1
            continue
        tag = (found["tag"] or "").lower()
        if not tag:
            text(at)
            if found["comment"]:
                empty = next((x for x in (">", "->") if page.startswith(x, at + 4)), None)
                m = None if empty else _COMMENT_END.search(page, at + 4)
                at = at + 4 + len(empty) if empty else m.end() if m else n
            else:
                at = page.find(">", at) + 1 or n
            begin = at
            continue
        end = ends.of(found.end())
        text(at)
        rest = page[found.end() : end]
        at = begin = end + 1
        if found["end"]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        if tag == "html":
            continue
        node = Node(tag, _attributes(rest) if rest and not rest.isspace() else {})
        stack.top().children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at : m.start() if m else n]))
            elif tag in ("xmp", "plaintext"):
                node.children.append(page[at : m.start() if m else n])
            at = begin = m.end() if m else n
        elif not rest.endswith("/") or tag in BLOCK:
            stack.push(node)
    text(n)
    return root, stack.deepest


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _imply(stack: _Open, tag: str) -> None:
    """Close what the start tag implies the end of, and open what it implies the start of."""
    if stack.top().tag == "head" and tag not in HEAD:
        stack.cut(len(stack.stack) - 1)
    if tag in CLOSES_P:
        _close(stack, "p", only_open=True)
    if tag in IMPLIED_END:
        ends, until = IMPLIED_END[tag]
        edge = stack.last(until)
        while (k := stack.last(ends)) > edge:
            stack.cut(k)
            if tag not in ("tr", "tbody", "thead", "tfoot"):
                break
    if tag in ("tr", "td", "th") or tag in SECTIONS:
        _clear(stack, tag)
    if tag in ("td", "th") and stack.top().tag in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr", {})
        stack.top().children.append(row)
        stack.push(row)


def _clear(stack: _Open, tag: str) -> None:
    """Close what stands, open, between a part of a table and the part it belongs in, such as a form around rows."""
    at, open_ = stack.last(("table", "template")), stack.stack
    if not at or open_[at].tag != "table":
        return
    at += 1
    if tag not in SECTIONS and at < len(open_) and open_[at].tag in SECTIONS:
        at += 1
    if tag in ("td", "th") and at < len(open_) and open_[at].tag == "tr":
        at += 1
    stack.cut(at)


def _close(stack: _Open, tag: str, only_open: bool = False) -> None:
    k = stack.last((tag,))
    edge = 0 if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else stack.last(SCOPE)
    if k > edge:
        stack.cut(k)
        return
    if tag == "p" and not only_open:  # an end tag without its start is an empty paragraph
        stack.top().children.append(Node("p", {}))
    if tag == "br":
        stack.top().children.append(Node("br", {}))


def _style(node: Node, name: str) -> str | None:
    """The last value that the element's own style gives the property."""
    found = [m[2].lower() for m in _STYLE.finditer(node.attributes.get("style", "")) if m[1].lower() == name]
    return found[-1] if found else None


def _visible(node: Node) -> bool:
    """Whether the element is laid out at all."""
    if node.tag in UNSEEN:
        return False
    if not node.attributes:
        return not (node.tag == "dialog")
    a = node.attributes
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return _style(node, "display") != "none"


def _seen(node: Node, outside: bool) -> bool:
    """Whether the element's own text can be seen: visibility is inherited, and a visible part of a hidden one is seen."""
    value = _style(node, "visibility") if "style" in node.attributes else None
    return outside if value in (None, "inherit", "unset") else value not in ("hidden", "collapse")


def _width(text: str) -> int:
    """Columns of a text: wide letters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines as they are laid out: a pending line, and whether space or an empty line is due before more text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.first = self.rest = ""  # what stands before the next line, and before each further one
        self.space = self.gap = False

    def text(self, value: str) -> None:
        words = _SPACE.sub(" ", value)
        if words == " ":
            self.space = self.space or bool(self.parts)
            return
        if words.startswith(" "):
            self.space, words = self.space or bool(self.parts), words[1:]
        if not words:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words.endswith(" ")
        self.parts.append(words.rstrip(" "))

    def line(self, keep: bool = False) -> None:
        """End the pending line, if it holds anything."""
        if self.parts or keep:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.lines.append((self.first + "".join(self.parts)).rstrip())
            self.first, self.gap = self.rest, False
        self.parts, self.space = [], False

    def apart(self) -> None:
        self.line()
        self.gap = True


def _chosen(node: Node) -> list[Node | str]:
    """What a closed details element, or a list of choices, shows of its children."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    if node.tag == "select":
        options: list[Node] = []
        waiting = list(reversed(node.children))
        while waiting:
            c = waiting.pop()
            if isinstance(c, Node) and c.tag == "option":
                options.append(c)
            elif isinstance(c, Node):
                waiting.extend(reversed(c.children))
        if "multiple" in node.attributes or node.attributes.get("size", "1") not in ("", "0", "1"):
            return options
        marked = [c for c in options if "selected" in c.attributes]
        return marked[-1:] or options[:1]
    return node.children


def _render(node: Node, page: _Page, lists: int, pre: bool, seen: bool) -> None:
    for child in _chosen(node):
        if isinstance(child, str):
            if not seen:
                continue
            if pre:
                head, *more = child.split("\n")
                if page.space and page.parts:
                    page.parts.append(" ")
                page.space = False
                page.parts.append(head)
                for x in more:
                    page.line(keep=True)
                    page.parts.append(x)
            else:
                page.text(child)
            continue
        if not _visible(child) or node.tag == "semantics" and child.tag.startswith("annotation"):
            continue
        tag, own = child.tag, _seen(child, seen)
        if node.tag in ("mfrac", "mtr", "mtable") or tag in CONTROLS:
            page.text(" ")
        if tag == "br":
            page.line(keep=True)
        elif tag == "hr":
            page.apart()
        elif tag == "img":
            if own and child.attributes.get("alt"):
                page.text(child.attributes["alt"])
        elif tag == "input":
            if own and child.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                page.text(child.attributes.get("value", ""))
        elif tag == "select":
            for option in _chosen(child):
                page.text(" ")
                _render(option, page, lists, False, _seen(option, own))
        elif tag == "table":
            page.apart()
            _table(child, page, own)
            page.apart()
        elif tag in ("ul", "ol", "menu", "dir"):
            page.line() if lists else page.apart()
            _list(child, page, lists, own)
            page.line() if lists else page.apart()
        elif tag == "svg":
            _drawing(child, page, lists, own)
        elif tag in BLOCK:
            page.apart() if tag in SPACED else page.line()
            _render(child, page, lists, pre or tag in ("pre", "xmp", "plaintext", "textarea"), own)
            page.apart() if tag in SPACED else page.line()
        elif tag in ("td", "th"):  # outside a table
            page.text(" ")
            _render(child, page, lists, pre, own)
            page.text(" ")
        else:
            _render(child, page, lists, pre or tag == "textarea", own)
        if tag in CONTROLS:
            page.text(" ")


def _drawing(node: Node, page: _Page, lists: int, seen: bool) -> None:
    """The texts of an SVG image, apart by spaces; HTML inside it is laid out as such."""
    for child in node.children:
        if isinstance(child, str) or child.tag in UNDRAWN or not _visible(child) or child.attributes.get("display") == "none":
            continue
        value = child.attributes.get("visibility")
        own = _seen(child, seen if value in (None, "inherit") else value not in ("hidden", "collapse"))
        if child.tag in ("text", "foreignobject"):
            page.text(" ")
            _render(child, page, lists, False, own)
            page.text(" ")
        else:
            _drawing(child, page, lists, own)


def _list(node: Node, page: _Page, lists: int, seen: bool) -> None:
    start = node.attributes.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    outer = page.first, page.rest
    for child in node.children:
        if isinstance(child, str):
            if seen:
                page.text(child)
        elif child.tag == "li" and _visible(child):
            page.line()
            own = _seen(child, seen)
            value = child.attributes.get("value", "")
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.first, page.rest = outer[1] + (mark if own else " " * len(mark)), outer[1] + " " * len(mark)
            _render(child, page, lists + 1, False, own)
            page.line()
            page.first, page.rest = outer[1], outer[1]
        elif _visible(child):
            wrap = Node("div", {})
            wrap.children = [child]
            _render(wrap, page, lists + 1, False, seen)
    page.first, page.rest = outer[1], outer[1]


def _rows(node: Node, seen: bool) -> list[tuple[Node, bool]]:
    """The rows of a table and its sections, and whether each can be seen."""
    found: list[tuple[Node, bool]] = []
    waiting = [(c, seen) for c in reversed(node.children)]
    while waiting:
        child, outside = waiting.pop()
        if isinstance(child, str) or not _visible(child):
            continue
        if child.tag == "tr":
            found.append((child, _seen(child, outside)))
        elif child.tag in SECTIONS:
            waiting.extend((c, _seen(child, outside)) for c in reversed(child.children))
    return found


def _loose(node: Node) -> list[Node | str]:
    """What a table or its sections hold beside rows; a browser shows it before the table, whether the section is hidden or not."""
    found: list[Node | str] = []
    waiting = list(reversed(node.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            found.append(child)
        elif child.tag in SECTIONS or child.tag == "colgroup":
            waiting.extend(reversed(child.children))
        elif child.tag not in ("tr", "col"):
            found.append(child)
    return found


def _cell(node: Node, seen: bool) -> list[str]:
    inner = _Page()
    _render(node, inner, 0, False, seen)
    inner.line()
    return [x for x in inner.lines if x] or [""]


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1")
    return max(1, int(value)) if re.fullmatch(r"\d{1,5}", value) else 1


def _table(node: Node, page: _Page, seen: bool) -> None:
    """Caption, stray text, then rows; a cell of several lines makes its row as high; spans leave cells empty."""
    loose = Node("div", {})
    loose.children = _loose(node)
    _render(loose, page, 0, False, seen)
    page.line()
    grid: list[dict[int, list[str]]] = []
    rows = _rows(node, seen)
    taken: list[list[tuple[int, int]]] = [[] for _ in rows]  # of each row the columns that cells above it reach into
    for r, (row, own) in enumerate(rows):
        cells: dict[int, list[str]] = {}
        column, spans = 0, sorted(taken[r], reverse=True)
        for cell in row.children:
            if isinstance(cell, str):
                if cell.isspace() or not cell:
                    continue
                wrap = Node("td", {})
                wrap.children = [cell]
                cell = wrap
            if not _visible(cell):
                continue
            while spans and spans[-1][0] <= column:
                column = max(column, spans.pop()[1])
            cells[column] = _cell(cell, _seen(cell, own))
            wide, high = min(MAX_SPAN, _span(cell, "colspan")), min(_span(cell, "rowspan"), len(rows) - r)
            for i in range(1, high):
                taken[r + i].append((column, column + wide))
            column += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells.items():
            widths[column] = max(widths.get(column, 0), *(min(MAX_COLUMN, _width(x)) for x in lines))
    columns = sorted(widths)
    for cells in grid:
        for k in range(max(map(len, cells.values()), default=0)):
            out = []
            for column in columns:
                lines = cells.get(column, [])
                value = lines[k] if k < len(lines) else ""
                out.append(value + " " * (widths[column] - _width(value)))
            page.parts = ["  ".join(out).rstrip()]
            page.line(keep=True)


def render(page: str) -> str:
    """The visible text of a page, laid out; empty for a page without any."""
    out = _Page()
    root, depth = _parsed(page)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2_000 + 4 * depth))
    _render(root, out, 0, False, True)
    out.line()
    lines = out.lines
    while lines and not lines[0]:
        lines.pop(0)
    kept = [x for k, x in enumerate(lines) if x or (k + 1 < len(lines) and lines[k + 1])]
    return "\n".join(kept)


def extract_text(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """Adds the laid-out visible text of each page; null of a null page, empty of one without text.

    Every row stays, and all other columns pass unchanged; an existing column of that name is replaced.
    Whole pages are read, of any length and depth.
    """
    frame = pages.drop(text) if text != html_column else pages.withColumnRenamed(html_column, "_html")
    source = html_column if text != html_column else "_html"
    at = frame.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else render(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], [*batch.schema.names, text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
    out = frame.mapInArrow(run, ", ".join([*fields, f"`{text}` string"]))
    return out if source == html_column else out.drop("_html")


