"""HTML to text by layout-aware rendering.

A page is read token by token into a tree builder that keeps only the stack of open
elements: implied end tags close elements as HTML does (the head ends at the first text or
element that it cannot hold, a paragraph at the next block, an item at the next item, a cell at the next cell), void elements never open, raw
text elements run to their own end tag. The renderer emits all visible text: blocks start
new lines, paragraphs and headings keep a blank line, ``br`` breaks, ``pre`` keeps its
white space, list items carry their bullet or number and indent, and the cells of a table
are aligned in columns (a cell that spans columns leaves the next ones empty, one that spans
rows stands in its first) up to ``TABLE_WIDTH`` signs; rows wider than that have their cells
one after another. Lists count from ``start`` and by ``value``; buttons show their caption.

A select shows its selected or else its first option (as a list, all), svg and math their text.

Invisible are head matter, scripts, styles, templates, comments, closed dialogs, hidden
inputs, what media elements hold for browsers without them (object, audio, video, canvas,
iframe), titles, descriptions and definitions of svg, annotations of math, and elements with ``hidden``, ``aria-hidden=true``, ``display:none`` or
``visibility:hidden``.

Not read are style sheets (a class that a page's own ``<style>`` hides is shown), the state of
``details`` (its body is shown) and ``visibility:visible`` inside hidden elements. Widths are
counted in code points.

Cases: null or empty html gives empty text; text without tags is one block; unclosed and
misnested tags close where the tree rules say, stray end tags are dropped, stray quotes in a
tag are ordinary signs and a tag that the page's end cuts off is text; an unclosed
comment or raw element runs to the end; cells outside a table are lines of their own; items,
quotes and tables deeper than ``MAX_DEPTH`` are plain lines without indent, columns or bullet
(no text is lost, and what is hidden stays so at every depth); repeated rows are rendered each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from medoidlab.llm.common import table

MAX_DEPTH = 200

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas".split())
# Not shown inside svg and math.
FOREIGN_UNSEEN = frozenset("desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
# White space around them inside svg and math, as the layout sets them apart.
APART = frozenset("text mtd mtr mfrac".split())
# What a head may hold; anything else ends it.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table ul tr caption legend search".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
# What a start tag closes implicitly, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("html body table td th caption li dd dt button object template".split())

# A quote counts straight after "=" only, and if it is closed. Possessive and without limit:
# attributes run to the next ">" or to the end of the page, in one pass.
_VALUE = r"""\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_NAME = r"[^\s/>][^\s/>=]*+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_VALUE})?+)*+)(>?)|<[!?/][^>]*>?", re.S
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_WHITE = re.compile(r"[ \t\r\n\f]+")
# Signs up to which table columns are padded, and the most columns a cell takes.
TABLE_WIDTH, WIDEST_SPAN = 400, 50
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Lines:
    """Text of one block context: finished lines and the line being filled."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False  # white space seen since the last word
        self.mark = ""  # bullet waiting for the first line
        self.blank = False

    def words(self, text: str) -> None:
        if not text:
            return
        parts = _WHITE.sub(" ", text)
        if parts[0] == " ":
            self.gap = True
            parts = parts[1:]
        if not parts:
            return
        if self.gap and self.line:
            self.line.append(" ")
        self.gap = parts[-1] == " "
        self.line.append(parts[:-1] if self.gap else parts)

    def end(self) -> None:
        text = "".join(self.line)
        if text:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.done.append(self.mark + text)
            self.mark = " " * len(self.mark)
        self.line, self.gap = [], False

    def space(self) -> None:
        self.end()
        self.blank = True

    def add(self, lines: list[str]) -> None:
        """Lines of an inner context."""
        self.end()
        if lines:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.done += [(self.mark if i == 0 else " " * len(self.mark)) + x if x else x for i, x in enumerate(lines)]
            self.mark = " " * len(self.mark)


def number(text: str | None, default: int) -> int:
    """An attribute's integer (of at most nine digits), or the default."""
    found = re.fullmatch(r"\s*([+-]?\d{1,9})(?!\d).*", text or "", re.S)
    return int(found[1]) if found else default


class Open:
    """An open element."""

    __slots__ = ("name", "unseen", "out", "rows", "count", "ordered", "pre", "foreign", "label", "all", "shown", "flat", "span")

    def __init__(self, name: str, unseen: bool, out: Lines, pre: bool):
        self.name, self.unseen, self.out, self.pre = name, unseen, out, pre
        self.rows: list[list[list[str]]] | None = None
        self.count, self.ordered, self.foreign, self.flat, self.span = 0, False, False, False, 1
        self.label, self.all = "", False  # of an option: its label, and whether it is selected; of a select: whether it lists all
        self.shown: list[str] = []  # what a select shows


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Cells as columns, padded to each column's widest line, parted by two spaces. Cells
    wider than ``TABLE_WIDTH`` widen no column, and a row whose columns would start beyond
    it has its cells one after another, so the text stays linear in the page."""
    rows = [r for r in rows if any(r)]
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            width = max((n for n in map(len, cell) if n <= TABLE_WIDTH), default=0)
            if i == len(widths):
                widths.append(width)
            else:
                widths[i] = max(widths[i], width)
    out = []
    for row in rows:
        filled = max(i for i, cell in enumerate(row) if cell) + 1
        fits = sum(widths[: filled - 1]) + 2 * filled <= TABLE_WIDTH
        if not fits or any(len(line) > TABLE_WIDTH for cell in row[: filled - 1] for line in cell):
            out += [line for cell in row for line in cell]
            continue
        for at in range(max(map(len, row))):
            cells = [(c[at] if at < len(c) else "").ljust(w) for c, w in zip(row[:filled], widths)]
            out.append("  ".join(cells).rstrip())
    return out


class Renderer:
    def __init__(self):
        self.root = Open("", False, Lines(), False)
        self.stack = [self.root]
        self.at: dict[str, list[int]] = {}  # depths of the open elements of each name

    def last(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element with one of the names, or 0."""
        return max((at[-1] for n in names if (at := self.at.get(n))), default=0)

    def text(self, raw: str) -> None:
        if self.stack[-1].name == "head" and raw.strip(" \t\n\f\r"):
            self.end_head()
        top = self.stack[-1]
        if top.unseen:
            return
        text = unescape(raw) if "&" in raw else raw
        if top.name in ("table", "tr", "tbody", "thead", "tfoot") and not text.strip():
            return
        if not top.pre:
            top.out.words(text)
            return
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        top.out.line.append(first)
        for line in rest:
            if top.out.line and "".join(top.out.line):
                top.out.end()
            elif top.out.done and not top.out.blank:
                top.out.done.append("")
            top.out.line = [line]

    def close(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.at[e.name].pop()
            if e.unseen:
                continue
            if e.flat:
                e.out.end()
            elif e.name in ("td", "th"):
                e.out.end()
                table = self.stack[self.last(["table"])]
                if table.rows is not None:
                    if not table.rows:
                        table.rows.append([])
                    table.rows[-1].append(e.out.done)
                    table.rows[-1] += [[] for _ in range(e.span - 1)]
                else:
                    self.stack[-1].out.add(e.out.done)
            elif e.name == "table":
                parent = self.stack[-1].out
                parent.space()
                e.out.end()
                parent.add(e.out.done)
                parent.add(aligned(e.rows or []))
                parent.space()
            elif e.name == "li" or e.name == "blockquote":
                e.out.end()
                self.stack[-1].out.add(e.out.done)
            elif e.name == "option":
                self.option(e)
            elif e.name == "select":
                parent = self.stack[-1].out
                if e.all:
                    parent.add(e.shown)
                else:
                    parent.words(f" {' '.join(e.shown)} ")
            elif e.foreign and e.name in APART:
                e.out.gap = True
            elif e.name == "q":
                e.out.words('"')
            elif e.name in SPACED:
                nested = e.name in LISTS and bool(self.at.get("li"))
                e.out.end() if nested else e.out.space()
            elif e.name in BLOCK:
                e.out.end()

    def option(self, e: Open) -> None:
        """A list shows every option, a closed select the last selected or else the first."""
        depth = self.last(["select"])
        e.out.end()
        if not depth:
            self.stack[-1].out.add(e.out.done)
            return
        select = self.stack[depth]
        text = e.label or " ".join(e.out.done)
        if select.all:
            select.shown.append(text)
        elif e.all or not select.count:
            select.shown = [text]
            select.count = 1

    def end_head(self) -> None:
        while self.stack[-1].name == "head":
            self.close(len(self.stack) - 1)

    def start(self, name: str, attributes: str) -> None:
        stack = self.stack
        if stack[-1].name == "head" and name not in IN_HEAD:
            self.end_head()
        if name in CLOSES:
            targets, bounds = CLOSES[name]
            bound = self.last(bounds)
            depths = (self.at.get(n, []) for n in targets)
            found = min((at[bisect_right(at, bound)] for at in depths if at and at[-1] > bound), default=0)
            if found:
                self.close(found)
        if name in BLOCK and name not in ("html", "body"):
            depth = self.last(["p"])
            if depth and depth > self.last(SCOPE):
                self.close(depth)
        if name in HEADINGS and stack[-1].name in HEADINGS:
            self.close(len(stack) - 1)
        if name in BLOCK or name in ("input", "select", "textarea"):  # no select holds them
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "select":
                    self.close(i)
                    break
                if stack[i].name not in ("option", "optgroup"):
                    break
        top = stack[-1]
        if name == "br":
            if not top.unseen:
                if top.out.line:
                    top.out.end()
                elif top.out.done:
                    top.out.blank = True
            return
        if name == "hr" and not top.unseen:
            top.out.space()
        if name in VOID:
            if name == "img" and not top.unseen:
                top.out.words(unescape(self.values(attributes).get("alt", "")))
            if name == "input" and not top.unseen and attributes and not self.hidden(name, attributes):
                found = self.values(attributes)
                if found.get("type", "").strip().lower() in ("submit", "button", "reset"):
                    top.out.words(f" {unescape(found.get('value', ''))} ")
            return
        hidden = top.unseen or name in UNSEEN or (bool(attributes) and self.hidden(name, attributes))
        hidden = hidden or (top.foreign and name in FOREIGN_UNSEEN)
        e = Open(name, hidden, top.out, top.pre or name == "pre")
        e.foreign = name in ("svg", "math") or (top.foreign and name != "foreignobject")
        if not hidden:
            if name == "option" or name == "select":
                found = self.values(attributes)
                e.out, e.pre, e.label = Lines(), False, unescape(found.get("label", ""))
                size = found.get("size", "")
                e.all = "selected" in found if name == "option" else "multiple" in found or (size.isdecimal() and int(size) > 1)
            elif e.foreign and name in APART:
                top.out.gap = True
            elif len(stack) > MAX_DEPTH and name in ("td", "th", "table", "li", "blockquote"):
                top.out.end()
                e.flat = True
            elif name in ("td", "th"):
                e.out = Lines()
                if attributes:
                    e.span = min(max(number(self.values(attributes).get("colspan"), 1), 1), WIDEST_SPAN)
            elif name == "table":
                e.out, e.rows = Lines(), []
            elif name == "tr":
                table = stack[self.last(["table"])]
                if table.rows is not None:
                    table.rows.append([])
            elif name == "li":
                top.out.end()
                e.out = Lines()
                owner = stack[self.last(LISTS)]
                owner.count += 1
                if owner.ordered and attributes:
                    owner.count = number(self.values(attributes).get("value"), owner.count)
                e.out.mark = f"{owner.count}. " if owner.ordered else "- "
            elif name == "blockquote":
                top.out.space()
                e.out = Lines()
                e.out.mark = "  "
            elif name in SPACED:
                nested = name in LISTS and bool(self.at.get("li"))
                top.out.end() if nested else top.out.space()
                e.ordered = name == "ol"
                if e.ordered and attributes:
                    e.count = number(self.values(attributes).get("start"), 1) - 1
            elif name in BLOCK:
                top.out.end()
            elif name == "q":
                top.out.words('"')
        self.at.setdefault(name, []).append(len(stack))
        stack.append(e)
        if e.foreign and self.empty(attributes):
            self.close(len(stack) - 1)

    @staticmethod
    def empty(attributes: str) -> bool:
        """Whether the tag ends with "/>" (in svg and math it then has no content)."""
        if not attributes.endswith("/"):
            return False
        return all(m.end() < len(attributes) for m in _ATTRIBUTE.finditer(attributes))

    @staticmethod
    def values(attributes: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
        return found

    def hidden(self, name: str, attributes: str) -> bool:
        lower = attributes.lower()
        if not ("hidden" in lower or "none" in lower or "collapse" in lower or name == "dialog"):
            return False
        found = self.values(attributes)
        return (
            "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or bool(_NO_DISPLAY.search(found.get("style", "")))
            or (name == "dialog" and "open" not in found)
        )

    def finish(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        depth = self.last(HEADINGS if name in HEADINGS else [name])
        bound = 0
        if name not in BLOCK and name not in SCOPE:
            bound = self.last(SCOPE)
        if name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
            bound = max(bound, self.last(("td", "th", "table")))
        if depth and depth >= bound:
            self.close(depth)
            return
        if bound:
            return
        if name == "p" and not self.stack[-1].unseen:
            self.stack[-1].out.space()


def render(html: str) -> str:
    """Visible text of a page."""
    r, at, n = Renderer(), 0, len(html)
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            r.text(html[at:])
            break
        if m.start() > at:
            r.text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if not m[5]:  # the page ends inside the tag
            r.text(html[m.start() :])
            break
        name = name.lower()
        if m[1]:
            r.finish(name)
            continue
        r.start(name, m[3])
        if name in RAW and r.stack[-1].name == name:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            end = stop.start() if stop else n
            if end > at:
                r.text(html[at:end])
            at = end
    r.close(1)
    r.root.out.end()
    return "\n".join(line.rstrip() for line in r.root.out.done)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of pages (page_id, html): one pass over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [render(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    rows = pages.selectExpr("cast(page_id as bigint) as page_id", "html")
    return rows.mapInArrow(run, "page_id long, text string")


def op7_html_text(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
