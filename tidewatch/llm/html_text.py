"""Layout-aware text of HTML pages.

A tree builder reads the page, with the end tags that HTML lets authors leave out; a
renderer walks the tree and writes what a reader would see: what is hidden by itself, by
attributes or by the page's style elements is left out, blocks are set apart, lists are numbered and indented, the cells of a table are
aligned.  Both work through a page in time proportional to its length, without
recursion, whatever its tags are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import styles

# Fixed values of the language: which elements are void, hidden, set apart, or end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset(
    "head script style template title iframe noembed noframes datalist audio video canvas rp".split()
)
# Parts of pictures and formulas that only describe, or are shown where they are referred to.
FOREIGN_HIDDEN = frozenset(
    "title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation"
    " annotation-xml".split()
)
FOREIGN = frozenset(["svg", "math"])
# Elements of those that hold HTML, and HTML elements that end a picture or formula they stand in.
HOLDS_HTML = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr"
    " ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol menu dir dl figure hr".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup"
    " html legend li main nav optgroup option search section select summary tr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
LINES = BLOCKS | {"text", "foreignobject"}  # on lines of their own; the latter in pictures
CLOSES_P = (BLOCKS | SPACED) - frozenset("body caption html legend optgroup option select tr".split())
# element: (what it ends, where the search for that stops)
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["table"])), "th": (frozenset(["td", "th", "caption"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
CELL_SCOPE = frozenset(["table", "td", "th", "caption", "button", "object"])

DEEPEST_INDENT = 20  # list levels that are indented; deeper ones stay at that margin
DEEPEST_TABLE = 12  # tables in tables that are aligned; cells of deeper ones are lines
WIDEST_CELL = 60  # characters after which the text of a cell goes on in its next line

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\s*(?:!important\s*)?(?=;|$)", re.I)
_KEPT = frozenset("hidden style open start value colspan rowspan type display visibility class id media reversed".split())
# Inputs whose value is not shown as text, and the numbers of lists in Roman form.
UNSHOWN_INPUTS = frozenset("hidden checkbox radio password image file range color".split())
ROMAN = {1000: "m", 900: "cm", 500: "d", 400: "cd", 100: "c", 90: "xc", 50: "l", 40: "xl", 10: "x", 9: "ix", 5: "v", 4: "iv", 1: "i"}


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


class Builder:
    """Builds the tree of a page."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.open = Counter()
        self.styles: list[str] = []
        self.foreign: list[str] = []  # open pictures and formulas, and what in them holds HTML

    def build(self, page: str) -> Node:
        at = 0
        while at < len(page):
            sign = page.find("<", at)
            if sign < 0:
                self.text(page[at:])
                break
            if sign > at:
                self.text(page[at:sign])
            at = self.markup(page, sign)
        if self.styles:
            self.restyle(styles.Sheet(self.styles))
        return self.root

    def restyle(self, sheet: styles.Sheet) -> None:
        """Gives the elements that rules of the page match the style that results."""
        work = [self.root] if sheet.rules else []
        while work:
            node = work.pop()
            style = sheet.style(node.name, node.attributes)
            if style is not None:
                node.attributes = node.attributes | {"style": style}
            work.extend(child for child in node.children if isinstance(child, Node))

    def markup(self, page: str, at: int) -> int:
        """Takes what begins with the sign at ``at``; returns the place behind it.

        A comment, tag or raw element that never ends reaches to the end of the page.
        """
        rest = len(page)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            return rest if end < 0 else end + 3
        follows = page[at + 1:at + 2]
        if follows in ("!", "?") or (follows == "/" and not page[at + 2:at + 3].isalpha()):
            end = page.find(">", at)
            return rest if end < 0 else end + 1
        if not (follows == "/" or (follows.isascii() and follows.isalpha())):
            self.text("<")
            return at + 1
        found = _TAG.match(page, at)
        if not found:
            return rest
        name = found[2].lower()
        if found[1]:
            self.end(name)
            return found.end()
        raw = found[3]
        self.start(name, self.attributes(raw) if raw and not raw.isspace() else {})
        if raw.endswith("/") and self.in_foreign():
            if self.stack[-1].name == name:  # only there does the sign end an element
                self.pop()
            return found.end()
        if name not in RAW:
            return found.end()
        close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, found.end())
        inner = page[found.end():close.start() if close else rest]
        if name == "style" and styles.on_screen(self.stack[-1].attributes.get("media", "")):
            self.styles.append(inner)
        if name in ("textarea", "xmp"):
            self.text(inner, raw=name == "xmp")
        self.end(name)
        if not close:
            return rest
        end = page.find(">", close.end())
        return rest if end < 0 else end + 1

    @staticmethod
    def attributes(raw: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(raw):
            if (name := name.lower()) in _KEPT:
                out.setdefault(name, html.unescape("".join(values)))
        return out

    def text(self, text: str, raw: bool = False) -> None:
        if self.open["head"] and not text.isspace() and self.stack[-1].name == "head":
            self.end("head")
        top = self.stack[-1]
        if top.name in ("table", "thead", "tbody", "tfoot", "tr") and text.isspace():
            return
        top.children.append(text if raw else html.unescape(text))

    def in_foreign(self) -> bool:
        """Whether a picture or formula is nearer than HTML in it; its own tag counts."""
        last = self.foreign[-1] if self.foreign else ""
        return last in FOREIGN or (bool(last) and self.stack[-1].name == last)

    def push(self, name: str, attributes: dict[str, str]) -> None:
        if self.foreign:
            if name in FOREIGN_HIDDEN or attributes.get("display") == "none":
                attributes = attributes | {"hidden": ""}
            if "visibility" in attributes:
                attributes = attributes | {"style": f"visibility:{attributes['visibility']};{attributes.get('style', '')}"}
        if name in FOREIGN or (self.foreign and name in HOLDS_HTML):
            self.foreign.append(name)
        node = Node(name, attributes)
        self.stack[-1].children.append(node)
        if name not in VOID:
            self.stack.append(node)
            self.open[name] += 1

    def pop(self) -> None:
        name = self.stack.pop().name
        self.open[name] -= 1
        if self.foreign and self.foreign[-1] == name:
            self.foreign.pop()

    def close(self, names: frozenset[str], barrier: frozenset[str]) -> None:
        """Ends the innermost open element of ``names``, and all in it, unless ``barrier`` is nearer."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].name in barrier:
                return

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in ("html", "body", "head") and self.open[name]:
            return
        if self.open["head"] and name not in IN_HEAD and name != "head":
            self.end("head")
        while name in BREAKS_OUT and self.foreign and self.foreign[-1] in FOREIGN:
            self.pop()
        if name in CLOSES_P:
            self.close(frozenset(["p"]), CELL_SCOPE)
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.pop()
        if name in IMPLIED_ENDS:
            ends, barrier = IMPLIED_ENDS[name]
            if name in ("tr", "thead", "tbody", "tfoot"):
                self.close(frozenset(["td", "th"]), frozenset(["table"]))
                if name != "tr":
                    self.close(frozenset(["tr"]), frozenset(["table"]))
            self.close(ends, barrier)
        if name in ("td", "th") and self.open["table"] and self.stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", {})
        self.push(name, attributes)

    def end(self, name: str) -> None:
        if name == "br":
            self.push("br", {})
        elif name in HEADINGS:
            self.close(HEADINGS, CELL_SCOPE)
        elif name not in VOID and name not in ("body", "html"):  # what follows those still shows
            self.close(frozenset([name]), frozenset() if name in ("table", "td", "th", "tr", "head") else CELL_SCOPE - {name})


def hidden(node: Node, parent: Node | None) -> bool:
    """Whether an element and all in it is not displayed."""
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a or (node.name == "dialog" and "open" not in a):
        return True
    if "style" in a and _UNSEEN.search(a["style"]):
        return True
    return parent is not None and parent.name == "details" and "open" not in parent.attributes and node.name != "summary"


def visible(node: Node, inherited: bool) -> bool:
    """Whether text in an element is seen: its own visibility, or else that around it."""
    found = _VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else ()
    return found[-1].lower() in ("visible", "initial") if found else inherited


class Page:
    """Lines of text with blank lines between blocks that are set apart."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.indents: list[str] = []
        self.marker: str | None = None

    def write(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.now.append(text)

    def verbatim(self, text: str) -> None:
        first, *others = text.replace("\r\n", "\n").split("\n")
        if first:
            self.now.append(first)
        for line in others:
            self.line(keep=True)
            if line:
                self.now.append(line)

    def line(self, keep: bool = False) -> None:
        """Ends the line; an empty one shows only if ``keep``."""
        text = "".join(self.now).rstrip(" ").replace("\xa0", " ")
        self.now = []
        if not text:
            if keep and self.lines:
                self.gap = True
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.indents[:DEEPEST_INDENT])
        if self.marker is not None:
            indent, self.marker = indent[: max(0, len(indent) - len(self.marker))] + self.marker, None
        self.lines.append(indent + text)

    def blank(self) -> None:
        self.line()
        self.gap = True


class Table:
    """Rows of cells, each a list of lines."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.spans: dict[int, int] = {}  # column: rows that a cell above still reaches into

    def row(self) -> None:
        self.rows.append([])
        self.spans = {c: n - 1 for c, n in self.spans.items() if n > 1}

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        column = row[-1][0] + 1 if row else 0
        while column in self.spans:
            column += 1
        row.append((column, lines))
        if rows > 1:
            self.spans |= {c: rows for c in range(column, column + columns)}
        if columns > 1:  # the columns it reaches over hold nothing
            row.append((column + columns - 1, []))

    def lines(self) -> Iterator[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for column, cell in row:
                fits = [len(x) for x in cell if len(x) <= WIDEST_CELL]
                width[column] = max(width.get(column, 0), max(fits, default=0))
        shown = [c for c in sorted(width) if width[c]]
        for row in self.rows:
            cells = dict(row)
            for i in range(max((len(c) for c in cells.values()), default=0)):
                at = {c: cells[c][i] for c in cells if i < len(cells[c])}
                last = max(at)
                line = "  ".join(at.get(c, "").ljust(width[c]) for c in shown if c <= last)
                yield line if not set(at) - set(shown) else "  ".join([line, *(at[c] for c in at if c not in shown)]).strip()


def wrapped(lines: list[str]) -> list[str]:
    """Lines cut between words to the width of a cell; a longer word stays whole."""
    out = []
    for line in lines:
        now, length = [], 0
        for word in line.split(" ") if len(line) > WIDEST_CELL else [line]:
            if now and length + len(word) > WIDEST_CELL:
                out.append(" ".join(now))
                now, length = [], 0
            now.append(word)
            length += len(word) + 1
        out.append(" ".join(now))
    return out


def _number(text: str | None, default: int, most: int) -> int:
    return min(int(text), most) if text and text.isascii() and text.isdigit() and len(text) < 8 else default


def label(number: int, kind: str) -> str:
    """The number of an item in a list of a type: 1, a, A, i or I."""
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, letter = divmod(number - 1, 26)
            out = chr(97 + letter) + out
    elif kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, sign in ROMAN.items():
            out += sign * (number // value)
            number %= value
    else:
        return str(number)
    return out.upper() if kind.isupper() else out


def _first(node: Node) -> tuple[int, int, str] | None:
    """First number, step and type of an ordered list."""
    if node.name != "ol":
        return None
    a, back = node.attributes, "reversed" in node.attributes
    items = sum(isinstance(c, Node) and c.name == "li" for c in node.children) if back else 1
    return _number(a.get("start"), items, 10**7), -1 if back else 1, a.get("type", "1")


def render(root: Node) -> str:
    """What is seen of a tree."""
    pages, tables, counters = [Page()], [], []
    pre = 0
    work: list[tuple[Node | str, Node | None, bool, bool]] = [(root, None, False, True)]
    while work:
        node, parent, leaving, seen = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not seen or (parent is not None and parent.name == "details" and "open" not in parent.attributes):
                continue
            page.verbatim(node) if pre else page.write(node)
            continue
        name = node.name
        if leaving:
            if name in ("td", "th") and tables and tables[-1] is None:
                page.line()
            elif name in ("td", "th") and tables and len(pages) > 1:
                page.line()
                pages.pop()
                a = node.attributes
                cell = wrapped([x for x in page.lines if x])
                tables[-1].cell(cell, max(1, _number(a.get("colspan"), 1, 100)), max(1, _number(a.get("rowspan"), 1, 1000)))
            elif name == "table":
                table = tables.pop()
                for line in table.lines() if table is not None else ():
                    page.now = [line]
                    page.line()
            elif name in LISTS:
                page.line()
                counters.pop()
                page.indents.pop()
            elif name in ("li", "dd", "blockquote") and node.children is not None:
                page.line()
                if name != "li":
                    page.indents.pop()
                elif not counters:
                    page.indents.pop()
                page.marker = None
            elif name == "pre":
                pre -= 1
            if name in SPACED and not (name in LISTS and counters):
                page.blank()
            elif name in LINES:
                page.line()
            continue
        if parent is not None and hidden(node, parent):
            continue
        if name == "br":
            page.line(keep=True) if not page.now else page.line()
            continue
        if name in LISTS and counters:
            page.line()  # a list in a list is not set apart
        elif name in SPACED:
            page.blank()
        elif name in LINES:
            page.line()
        if name == "table":
            tables.append(Table() if len(tables) < DEEPEST_TABLE else None)
        elif name == "tr" and tables and tables[-1] is not None:
            tables[-1].row()
        elif name in ("td", "th") and tables:
            if tables[-1] is not None:
                pages.append(Page())
            else:
                page.line()
        elif name in LISTS:
            counters.append(_first(node))
            page.indents.append("   " if name == "ol" else "  ")
        elif name == "li":
            if counters and counters[-1] is not None:
                number, step, kind = counters[-1]
                number = _number(node.attributes.get("value"), number, 10**7)
                counters[-1] = number + step, step, kind
                page.marker = f"{label(number, kind)}. "
            else:
                page.marker = "- "
                if not counters:
                    page.indents.append("  ")
        elif name in ("dd", "blockquote"):
            page.indents.append("  ")
        elif name == "pre":
            pre += 1
        if name in VOID:
            if name == "hr":
                page.blank()
            elif name == "input" and visible(node, seen) and node.attributes.get("type", "").lower() not in UNSHOWN_INPUTS:
                page.write(f" {node.attributes.get('value', '')} ")
            continue
        work.append((node, parent, True, seen))
        seen = visible(node, seen)
        work.extend((child, node, False, seen) for child in reversed(node.children))
    pages[0].line()
    return "\n".join(pages[0].lines)


def text_of(page: str | None) -> str:
    return render(Builder().build(page or ""))


def extract(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """One row per page: key and text.

    A null or empty page, or one that shows nothing, has the empty text; malformed
    markup is read as far as it goes; a null or repeated key is carried through; an
    empty table gives no rows.  Other columns are not read.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"))
    schema = T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(value.as_py()) for value in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
