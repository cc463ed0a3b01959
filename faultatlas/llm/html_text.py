"""All visible text of web pages, laid out as a browser would lay it out.

A tree is built from the tags, with the end tags and wrappers that HTML implies; what
stands in a table outside its cells comes in front of the table, as in browsers;
rules decide which elements are seen; the visible tree is rendered to text in which
blocks stand on lines of their own, lists have their marks, and table cells are
aligned in columns.  Nothing visible is judged to be boilerplate and left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset(
    "head script style template noscript noembed noframes iframe object svg math canvas audio video datalist meta link base title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr article section".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# A start tag ends open elements of these names, up to the nearest of the bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "caption": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
# A paragraph is not looked for beyond these.
_P_BOUNDS = frozenset("table td th caption button object template html body li dd".split())
# Tables hold only these; anything else that stands in them outside cells goes in front of the table.
_TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
_IN_TABLES = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
# What a start tag may stand in directly.
_HOLDERS = {
    "caption": {"table"}, "colgroup": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"},
    "tr": _TABLE_PARTS - {"tr"}, "td": _TABLE_PARTS, "th": _TABLE_PARTS,
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs = name, attrs
        self.children: list[Node | str] = []


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def build(page: str) -> Node:
    """Tree of a page.  Any input gives a tree; unknown and unfinished tags do no harm."""
    root = Node("#root", {})
    open_: list[Node] = [root]
    at = 0

    def table_place() -> int:
        """Place of the table whose part is open and not a cell; 0 if there is none."""
        if open_[-1].name in _TABLE_PARTS:
            for place in range(len(open_) - 1, 0, -1):
                if open_[place].name not in _TABLE_PARTS:
                    break
                if open_[place].name == "table":
                    return place
        return 0

    def add(child: Node | str) -> None:
        """Append to the open element, or in front of the table if that cannot hold it."""
        blank = not child.strip(" \t\n\r\f") if isinstance(child, str) else child.name in _IN_TABLES
        place = 0 if blank else table_place()
        if place:
            open_[place - 1].children.insert(-1, child)  # an open table is the last child
        else:
            open_[-1].children.append(child)

    def text(raw: str) -> None:
        if raw:
            add(html.unescape(raw) if "&" in raw else raw)

    def close_upto(place: int) -> None:
        del open_[place:]

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            text(page[at:])
            break
        found = _TAG.match(page, less)
        if found is None:
            text(page[at : less + 1])
            at = less + 1
            continue
        text(page[at:less])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            for place in range(len(open_) - 1, 0, -1):
                if open_[place].name == name:
                    close_upto(place)
                    break
                if open_[place].name in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if name in CLOSES_P:
            for place in range(len(open_) - 1, 0, -1):
                if open_[place].name == "p":
                    close_upto(place)
                    break
                if open_[place].name in _P_BOUNDS:
                    break
        if name in IMPLIED:
            gone, bounds = IMPLIED[name]
            last = None
            for place in range(len(open_) - 1, 0, -1):
                if open_[place].name in bounds or open_[place].name == "template":
                    break
                if open_[place].name in gone:
                    last = place
            if last is not None:
                close_upto(last)
        if name in _HOLDERS:
            # Leaves what stands in front of the table, up to the part that holds this one.
            for place in range(len(open_) - 1, 0, -1):
                if open_[place].name in _HOLDERS[name]:
                    close_upto(place + 1)
                    break
                if open_[place].name in ("td", "th", "caption", "template"):
                    break
        elif name == "table" and table_place():
            close_upto(table_place())
        elif name == "form" and table_place():
            continue
        if name in ("td", "th") and open_[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            open_[-1].children.append(row)
            open_.append(row)
        node = Node(name, attributes(found["attrs"]) if found["attrs"].strip(" /\t\n") else {})
        add(node)
        if name in VOID or name == "colgroup":
            continue
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at)
            body = page[at : stop.start()] if stop else page[at:]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = stop.end() if stop else len(page)
            continue
        open_.append(node)
    return root


def visible(node: Node) -> bool:
    """Whether an element is seen, by its name, its attributes and its inline style."""
    a = node.attrs
    if node.name in HIDDEN or "hidden" in a:
        return False
    if node.name == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.name == "dialog" and "open" not in a:
        return False
    if a.get("aria-hidden", "").strip().lower() == "true":
        return False
    return not ("style" in a and _UNSEEN.search(a["style"]))


class Page:
    """Lines of rendered text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = False

    def inline(self, text: str) -> None:
        if self.line.endswith((" ", " ")) or not self.line:
            text = text.lstrip(" ")
        self.line += text

    def end(self) -> None:
        """End the line, if it has anything."""
        line = self.line.rstrip(" ")
        self.line = ""
        if line.strip():
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += line.split("\n")

    def space(self) -> None:
        self.end()
        self.gap = True

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def width(text: str) -> int:
    """Columns a text takes: wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_rows(node: Node) -> list[list[tuple[str, int]]]:
    """Visible cells of a table's rows, as text and the columns they span.

    Nested tables are part of their cell.
    """
    rows = []
    stack: list[Node] = [node]
    while stack:
        part = stack.pop()
        for child in reversed(part.children) if part.name != "tr" else ():
            if isinstance(child, Node) and child.name in ("tbody", "thead", "tfoot", "tr") and visible(child):
                stack.append(child)
        if part.name == "tr":
            cells = []
            for child in part.children:
                if isinstance(child, Node) and child.name in ("td", "th") and visible(child):
                    span = child.attrs.get("colspan", "1")
                    cells.append((render(child), min(int(span), 1000) if span.isdecimal() and int(span) else 1))
            rows.append(cells)
    return rows


def table_lines(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows with the cells of a column below each other; a cell may have several lines."""
    wide: dict[int, int] = {}
    for row in rows:
        column = 0
        for text, span in row:
            if span == 1:
                wide[column] = max(wide.get(column, 0), *(width(line) for line in text.split("\n")))
            column += span
    lines = []
    for row in rows:
        parts = [text.split("\n") for text, _ in row]
        for k in range(max(map(len, parts), default=0)):
            line, column = "", 0
            for (_, span), part in zip(row, parts, strict=True):
                cell = part[k] if k < len(part) else ""
                room = sum(wide.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                line += cell + " " * max(0, room - width(cell)) + " | "
                column += span
            lines.append(line.rstrip(" |") if not line.strip(" |") else line[:-3].rstrip())
    return [line for line in lines if line.strip()]


def render(root: Node) -> str:
    """Visible text below an element.  Works with a stack, so nesting has no limit but tables in tables."""
    page = Page()
    # Entries: a node to open, a string, or a call for what follows the children.
    stack: list = list(reversed(root.children))
    marks: list[list] = []  # open lists: kind and next number
    pre = 0
    while stack:
        item = stack.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            if pre:
                page.line += item
            else:
                page.inline(_SPACE.sub(" ", item))
            continue
        if not visible(item):
            continue
        name = item.name
        if name == "br":
            page.line = page.line.rstrip(" ")
            if page.line.strip():
                page.end()
            elif page.lines:
                page.gap = True
            continue
        if name == "img":
            if item.attrs.get("alt", "").strip():
                page.inline(_SPACE.sub(" ", item.attrs["alt"]))
            continue
        if name == "input":
            shown = item.attrs.get("value") or item.attrs.get("placeholder", "")
            if item.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file") and shown:
                page.inline(shown)
            continue
        if name == "hr":
            page.space()
            continue
        if name == "table":
            page.space()
            for child in item.children:
                if isinstance(child, Node) and child.name == "caption" and visible(child):
                    page.line = render(child)
                    page.end()
            for line in table_lines(table_rows(item)):
                page.line = line
                page.end()
            page.space()
            continue
        block, spaced = name in BLOCK, name in SPACED
        if spaced and not (name in ("ul", "ol", "dl") and marks):
            page.space()
        elif block:
            page.end()
        if name in ("ul", "ol", "menu", "dir"):
            start = item.attrs.get("start", "1")
            marks.append([name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif name == "li":
            kind = marks[-1] if marks else ["ul", 1]
            page.line = "  " * max(0, len(marks) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
            kind[1] += 1
        elif name == "dd":
            page.line = "    "
        elif name == "pre":
            pre += 1

        def after(name: str = name, block: bool = block, spaced: bool = spaced) -> None:
            nonlocal pre
            if name == "pre":
                pre -= 1
            if name in ("ul", "ol", "menu", "dir") and marks:
                marks.pop()
            if name == "li" and page.line.strip() in ("-", ""):
                page.line = ""
            if spaced and not (name in ("ul", "ol", "dl") and marks):
                page.space()
            elif block:
                page.end()

        stack.append(after)
        stack.extend(reversed(item.children))
    return page.text()


def visible_text(page: str | None) -> str | None:
    """Text of a page; null for a null page, empty for one that shows nothing."""
    return None if page is None else render(build(page))


def extract(pages: DataFrame, page_html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``page_html`` in the column ``text`` in its place.

    All other columns and all rows stay, repeated ones too; null gives null; a table
    nested very deeply in tables is shown as one run of text.
    """

    @F.pandas_udf("string")
    def shown(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for one in column:
            yield one.map(_safe)

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (page_html, text)]
    return pages.select(*rest, shown(F.col(f"`{page_html}`")).alias(text))


def _safe(page: str | None) -> str | None:
    try:
        return visible_text(page)
    except RecursionError:
        without = re.sub(r"</?(?:table|tbody|thead|tfoot|tr|td|th|caption)\b[^>]*>", " ", page, flags=re.I)
        return visible_text(without)
