"""HTML extraction by layout-aware rendering.

A tokeniser feeds a tree builder that keeps the stack of open elements, closes those whose end tags may
be left out (p, li, dt, dd, tr, td, th, option and so on), supplies rows that tables leave out, and
ignores end tags that close nothing. Elements enter and leave a renderer as they open and close, so
neither depth nor length of a page costs recursion. The renderer emits all visible text: what browsers
don't show (head, scripts, styles, templates, hidden attributes, display:none, visibility:hidden, the
inside of closed details; of svg and math the definitions, descriptions and annotations) is left out. The
text of formulas and drawings is shown: parts of fractions, scripts and the like stand apart by a space. Blocks begin lines, and those with margins have an empty line
around them; white space is collapsed outside of pre; list items have their mark or number and are
indented; cells of a table row stand side by side, aligned by column. Text between a table's cells stands
before the table, as browsers put it; formatting elements carry no layout, so they need no repair. Padding and
indentation are bounded, so a page's text is of the order of its own length.

Defined cases. A null page gives a null text, an empty one or one without visible text an empty text.
Cut tags at the end of a page are text. Pages of any length and depth are rendered whole. Rows are
independent: repeated rows, empty tables and other columns need no rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import slices

#: A quote delimits a value only right after '='; elsewhere it is a letter like any other, as in HTML's tokeniser.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))"
_TOKEN = re.compile(
    r"<!--(.*?)(?:-->|$)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|(/)(?=>)|/|[^\s/>][^\s/>=]*+(?:%s)?)*+)>" % re.sub(r"(?<!\\)\((?!\?)", "(?:", _VALUE),
    re.S,
)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?")
_SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes noscript object audio video canvas datalist".split())
#: Where tags end with '/>', unless an element stands between whose content is HTML again.
FOREIGN = frozenset("svg math".split())
_HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
#: Their parts stand apart.
_PARTED = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr mtable svg".split())
#: HTML elements that end a formula or drawing.
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: With an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li main menu nav optgroup option search section summary caption".split())
_ENDS_P = (BLOCK | frozenset("hr table".split())) - {"option", "optgroup", "html", "body", "caption", "legend", "figcaption"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that opens closes such as these, unless a boundary stands between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: No end tag of something else closes past these.
_WALLS = frozenset("table td th caption".split())
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: Columns are padded to this width at most; longer cells run over. Cells beyond FARTHEST follow each other.
WIDEST, FARTHEST = 60, 1000
#: Items nested beyond so many characters of indentation are indented no further.
DEEPEST = 120


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Canvas:
    """Lines of text under a changing indentation."""

    __slots__ = ("lines", "current", "gap", "leads", "mark")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = False
        self.leads: list[str] = [""]  # indentation at each depth
        self.mark = ""  # of a list item, before its first line

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        if len(self.leads) > 1:
            lead = self.leads[-2] + self.mark if self.mark else self.leads[-1]
            self.mark, line = "", lead + line
        self.lines.append(line)

    def indent(self, by: int) -> None:
        lead = self.leads[-1]
        self.leads.append(lead + " " * by if len(lead) < DEEPEST else lead)

    def outdent(self) -> None:
        if len(self.leads) > 1:
            self.leads.pop()

    def flush(self) -> None:
        if self.current:
            line = "".join(self.current).strip(" ")
            self.current = []
            if line:
                self.put(line)

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[0] == " " and (not self.current or self.current[-1][-1] == " "):
            text = text[1:]
        if text:
            self.current.append(text)

    def line_break(self) -> None:
        if self.current:
            self.flush()
        elif self.lines and not self.gap:
            self.gap = True


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        """The rows with cells side by side."""
        placed, spans = [], []  # spans: blocks of columns that cells above still hold, in order, and up to which row
        for n, row in enumerate(self.rows):
            spans = [s for s in spans if s[2] > n]
            at, cells, new, k = 0, [], [], 0
            for lines, columns, deep in row:
                while k < len(spans) and spans[k][0] <= at:
                    at, k = max(at, spans[k][1]), k + 1
                cells.append((at, columns, lines))
                if deep > 1:
                    new.append((at, at + columns, n + deep))
                at += columns
            if new:
                spans = sorted(spans + new)
            placed.append(cells)
        width: dict[int, int] = {}  # of the columns in which a cell begins; others take no room
        for cells in placed:
            for at, columns, lines in cells:
                width[at] = min(WIDEST, max(width.get(at, 0), *map(len, lines))) if columns == 1 and lines else width.get(at, 0)
        starts, start = {}, 0
        for at in sorted(width):
            starts[at], start = min(start, FARTHEST), start + width[at] + 2
        out = []
        for cells in placed:
            for k in range(max([0, *(len(lines) for _, _, lines in cells)])):
                line = ""
                for at, _, lines in cells:
                    if k < len(lines) and lines[k]:
                        start = starts[at]
                        line = (line.ljust(start) if len(line) + 1 < start or not at else line + "  ") + lines[k]
                out.append(line.rstrip())
        return out


class _Page:
    """The tree builder's stack of open elements, and the renderer that they enter and leave."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.modes: list[bool] = []  # of the open elements: is their content a formula's or drawing's
        self.count: dict[str, int] = {}  # of open elements, by tag
        self.hidden = 0  # depth at which the outermost unseen element is open, 0 for none
        self.pre = 0
        self.canvas = _Canvas()
        self.saved: list[tuple] = []  # canvases around cells
        self.tables: list[_Table] = []
        self.lists: list[list] = []  # kind and number of the open lists
        self.cells: list[tuple[int, int]] = []

    # -- tree builder

    def foreign(self) -> bool:
        """Whether the content of a formula or drawing is read."""
        return bool(self.modes) and self.modes[-1]

    def open(self, tag: str, text: str, ended: bool = False) -> None:
        if self.foreign():
            if tag not in _BREAKS_OUT:
                self.push(tag, attributes(text))
                if ended:
                    self.pop()
                return
            while self.foreign():
                self.pop()
        if tag in _CLOSES:
            self.close_until(*_CLOSES[tag])
        elif tag in _ENDS_P:
            self.close_until({"p"}, _WALLS | {"button"})
            if tag in _HEADINGS and self.stack and self.stack[-1] in _HEADINGS:
                self.pop()
        if tag in ("li", "dt", "dd"):
            self.close_until({"p"}, _WALLS | {"ul", "ol", "dl", "menu"})
        if tag in ("td", "th") and self.count.get("table") and not self.in_row():
            self.push("tr", {})
        attrs = attributes(text) if text.strip(" /\n\t") else {}
        if tag in VOID:
            self.void(tag)
        else:
            self.push(tag, attrs)
            if ended and tag in FOREIGN:
                self.pop()

    def in_row(self) -> bool:
        for t in reversed(self.stack):
            if t == "tr":
                return True
            if t == "table":
                return False
        return False

    def close_until(self, closes, walls) -> None:
        """Closes the innermost run of open elements down to the outermost of `closes` inside the walls."""
        if not any(self.count.get(c) for c in closes):
            return
        at = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] in closes:
                at = i
            elif self.stack[i] in walls:
                break
            elif self.stack[i] == "table":
                break
        if at is not None:
            while len(self.stack) > at:
                self.pop()

    def close(self, tag: str) -> None:
        if tag == "p" and not self.count.get("p"):
            self.block(True)
            return
        if tag == "br":
            self.void("br")
            return
        if not any(self.count.get(t) for t in (_HEADINGS if tag in _HEADINGS else (tag,))):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].rstrip("!") == tag or (tag in _HEADINGS and self.stack[i] in _HEADINGS):
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i] in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and self.stack[i] != tag:
                return

    # -- renderer

    def block(self, spaced: bool) -> None:
        if not self.hidden:
            self.canvas.flush()
            if spaced and self.canvas.lines and not self.canvas.mark:
                self.canvas.gap = True

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        foreign = self.foreign()
        parted = foreign and (tag == "text" or self.stack[-1] in _PARTED)
        self.stack.append(tag)
        self.modes.append(tag in FOREIGN or (foreign and tag not in _HTML_AGAIN))
        self.count[tag] = self.count.get(tag, 0) + 1
        if self.hidden:
            return
        if tag in UNSEEN or "hidden" in attrs or _HIDING.search(attrs.get("style", "")) or (tag == "dialog" and "open" not in attrs):
            self.hidden = len(self.stack)
            return
        if foreign:
            if tag in _FOREIGN_UNSEEN or attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse"):
                self.hidden = len(self.stack)
            elif parted:
                self.canvas.inline(" ")
            return
        if len(self.stack) > 1 and self.stack[-2] == "details!" and tag != "summary":
            self.hidden = len(self.stack)
            return
        if tag == "details" and "open" not in attrs:
            self.stack[-1] = "details!"
        if tag in BLOCK:
            nested = tag in ("ul", "ol") and len(self.lists) > 0
            self.block(tag in SPACED and not nested)
        canvas = self.canvas
        if tag == "pre":
            self.pre += 1
        elif tag in ("ul", "ol", "menu", "dir"):
            start = attrs.get("start", "")
            self.lists.append(["ol" if tag == "ol" else "ul", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            if canvas.mark:  # an item that begins with a list keeps its own mark's line
                canvas.put("")
            canvas.mark = mark
            canvas.indent(len(mark))
        elif tag in ("dd", "blockquote"):
            canvas.indent(4 if tag == "dd" else 2)
        elif tag == "table":
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1].rows:
            span = lambda name, most: min(most, max(1, int(attrs[name]))) if re.fullmatch(r"\d{1,6}", attrs.get(name, "")) else 1
            self.cells.append((span("colspan", 1000), span("rowspan", 65534)))
            self.saved.append((canvas, self.lists, self.pre, len(self.stack)))
            self.canvas, self.lists, self.pre = _Canvas(), [], 0
        elif tag == "q":
            canvas.inline('"')

    def pop(self) -> None:
        depth, tag = len(self.stack), self.stack.pop()
        self.modes.pop()
        self.count[tag.rstrip("!")] -= 1
        if self.hidden:
            if self.hidden == depth:
                self.hidden = 0
            return
        canvas = self.canvas
        if self.foreign():
            if tag == "text":
                canvas.inline(" ")
            return
        if tag == "details!":
            tag = "details"
        if tag in ("td", "th") and self.saved and self.saved[-1][3] == depth:
            canvas.flush()
            lines = canvas.lines
            while lines and not lines[-1]:
                lines.pop()
            self.canvas, self.lists, self.pre, _ = self.saved.pop()
            self.tables[-1].rows[-1].append((lines, *self.cells.pop()))
            return
        if tag in BLOCK:
            nested = tag in ("ul", "ol") and len(self.lists) > 1
            self.block(tag in SPACED and not nested)
        if tag == "pre":
            self.pre -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            if self.lists:
                self.lists.pop()
        elif tag == "li":
            canvas.outdent()
            canvas.mark = ""
        elif tag in ("dd", "blockquote"):
            canvas.outdent()
        elif tag == "table" and self.tables:
            lines = self.tables.pop().lines()
            for line in lines:
                canvas.put(line)
            canvas.gap = bool(canvas.lines)
        elif tag == "q":
            canvas.inline('"')

    def void(self, tag: str) -> None:
        if self.hidden:
            return
        if tag == "br":
            self.canvas.line_break()
        elif tag == "hr":
            self.block(True)

    def text(self, text: str) -> None:
        if self.hidden or (self.stack and self.stack[-1] == "details!" and text.strip()):
            return
        if self.stack and self.stack[-1] in ("table", "tbody", "thead", "tfoot", "tr"):
            if not text.strip():
                return
        if not text:
            return
        if "&" in text:
            text = unescape(text)
        if self.pre:
            lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, line in enumerate(lines):
                if k:
                    self.canvas.put("".join(self.canvas.current).rstrip(" "))
                    self.canvas.current = []
                if line:
                    self.canvas.current.append(line)
        else:
            self.canvas.inline(text)


def render(page: str) -> str:
    """The visible text of a page."""
    out, at, size = _Page(), 0, len(page)
    match, last = _TOKEN.search, page.rfind(">")
    while at < size:
        m = match(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[0].startswith("<![CDATA[") and out.foreign():
                end = page.find("]]>", m.start())
                at = size if end < 0 else end + 3
                out.text(page[m.start() + 9 : size if end < 0 else end].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[2]:
            out.close(tag)
            continue
        foreign = tag in RAW and out.foreign()
        out.open(tag, m[4], m[5] is not None)
        if foreign:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            stop = end.start() if end else size
            if tag == "textarea" and stop > at:
                out.text(page[at:stop])
            at = stop
            if not end:
                break
        elif tag == "pre" and page.startswith("\n", at):
            at += 1
        elif tag == "plaintext":
            out.text(page[at:])
            break
    while out.stack:
        out.pop()
    out.canvas.flush()
    lines = [line.rstrip(" ") for line in out.canvas.lines]
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url and the text of pages(page_id, url, html). Map-only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [None if h is None else render(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string")
