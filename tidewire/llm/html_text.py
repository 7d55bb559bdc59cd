"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a text layout.

All visible text comes out: blocks on lines of their own, paragraphs and headings set off by blank lines, list items
with bullets or numbers, preformatted text as it stands, table cells in aligned columns. Nothing is judged to be
boilerplate. Hidden are head matter, scripts, styles, templates, comments, elements with the attribute
``hidden`` or a style of ``display:none``, closed dialogs and what a closed ``details`` folds away; what has the style ``visibility:hidden`` (or
``collapse``), but for elements in it that are ``visible`` again. Of several declarations the last counts.
A cell before others in its row is broken at blanks into lines of about 60 characters, so that the columns behind it stay aligned; the last cell of a row is not.
Formulas (``math``) come out but for their annotations, and of drawings (``svg``) what their text elements and foreign objects show.

Defined results: null html gives null text and a null title; empty html gives empty text; elements nested deeper than 200
belong to the one at that depth; unknown and unclosed tags are tolerated; repeated rows are each rendered; other
columns of the input are left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, WIDEST = 200, 60
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
DECLARED = {k: re.compile(rf"(?<![\w-]){k}\s*:\s*([a-z-]+)", re.I) for k in ("display", "visibility")}

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("head script style template title meta link iframe noembed noframes object audio video canvas datalist noscript mphantom".split())
HEAD_ONLY = set("base link meta script style title template noscript".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul xmp".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
SPACED = set("p blockquote h1 h2 h3 h4 h5 h6 dl figure fieldset pre table ul ol menu dir xmp".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
#: Start tags that close an open element of these names, looked for up to the fence.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: Not drawn themselves; titles, styles and scripts are in ``NEVER``.
SVG_HIDDEN = set("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
ANNOTATIONS = {"annotation", "annotation-xml"}
#: Elements of drawings and formulas whose content is HTML again, and start tags that end a drawing or formula elsewhere.
HTML_INSIDE = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FENCE = {"table", "td", "th", "caption", "button", "object", "template", "html"}


#: Rows of a cell that reaches to the end of its part of the table.
END_OF_PART = 65_534


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw else {}


class Tree:
    """Open elements on a stack; ``root`` holds the document."""

    def __init__(self, source: str):
        self.root = Node("html", {})
        self.open = [self.root]
        self.any_foreign = False
        at, end = 0, len(source)
        for_raw: re.Match | None = None
        while at < end:
            m = TOKEN.search(source, at)
            self.text(source[at : m.start() if m else end])
            if not m:
                break
            at = max(m.end(), m.start() + 1)
            close, start, rest = m.group(1), m.group(2), m.group(3)
            if close:
                self.end(close.lower())
            elif start:
                tag = start.lower()
                self.start(tag, attributes(rest.rstrip(">/")))
                if self.any_foreign and rest.endswith("/>") and self.open[-1].tag == tag and self.foreign(len(self.open) - 1 + (tag in ("svg", "math"))):
                    self.open.pop()
                elif tag in RAW:
                    for_raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    stop = for_raw.start() if for_raw else end
                    raw = source[at:stop]
                    if raw:
                        self.open[-1].children.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
                    self.end(tag)
                    at = for_raw.end() if for_raw else end

    def text(self, s: str) -> None:
        if not s:
            return
        if self.open[-1].tag == "head" and s.strip():
            self.pop("head")
        self.open[-1].children.append(html.unescape(s) if "&" in s else s)

    def foreign(self, end: int | None = None) -> int:
        """Place of the open drawing or formula whose own elements come next, or 0."""
        for i in range((len(self.open) if end is None else end) - 1, 0, -1):
            if self.open[i].tag in ("svg", "math"):
                return i
            if self.open[i].tag in HTML_INSIDE:
                return 0
        return 0

    def pop(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def imply(self, names: set[str], fence: set[str]) -> None:
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in fence:
                break
            if self.open[i].tag in names:
                last = i
        if last is not None:
            del self.open[last:]

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("svg", "math"):
            self.any_foreign = True
        elif self.any_foreign and tag in BREAKOUT:
            while at := self.foreign():
                del self.open[at:]
        if tag in ("html", "body"):
            self.pop("head")
            if tag == "html" or any(n.tag == "body" for n in self.open):
                return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self.pop("head")
        if tag in CLOSES_P:
            self.imply({"p"}, FENCE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED:
            self.imply(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {})
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name == tag or (tag in HEADINGS and name in HEADINGS):
                del self.open[i:]
                return
            if name in FENCE and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "form", "html"):
                break
        if tag == "p":
            self.start("p", {})
            self.open.pop()


def hidden(n: Node) -> bool:
    a = n.attrs
    if n.tag in NEVER:
        return True
    if not a:
        return n.tag == "dialog"
    return "hidden" in a or (n.tag == "dialog" and "open" not in a) or (n.tag == "input" and a.get("type", "").lower() == "hidden") or declared(n, "display") == "none"


def declared(n: Node, name: str) -> str | None:
    """The value of a property in an element's style."""
    style = n.attrs.get("style")
    found = DECLARED[name].findall(style) if style else None
    return found[-1].lower() if found else None


def seen(n: Node, shown: bool) -> bool | None:
    """Whether an element's own text is visible, where its parent's is or not; None where nothing in it is."""
    own = declared(n, "visibility")
    shown = shown if own is None or own in ("inherit", "unset") else own not in ("hidden", "collapse")
    if shown:
        return True
    stack = list(n.children)
    while stack:
        c = stack.pop()
        if isinstance(c, Node):
            if declared(c, "visibility") in ("visible", "initial"):
                return False
            stack += c.children
    return None


class Layout:
    """Lines of text; blank runs collapse across elements of a line."""

    def __init__(self, cell: bool = False, shown: bool = True) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent, self.mark = "", ""
        self.cell, self.shown = cell, shown

    def words(self, s: str) -> None:
        if not self.shown:
            return
        core = BLANKS.sub(" ", s)
        body = core.strip(" ")
        if not body:
            self.space = self.space or bool(core)
            return
        if self.line and (self.space or core[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.space = core[-1] == " "

    def put(self, s: str) -> None:
        if self.gap and self.lines and not self.cell:
            self.lines.append("")
        self.gap = False
        head = self.indent
        if self.mark:
            head, self.mark = head[: -len(self.mark)] + self.mark, ""
        self.lines.append((head + s).rstrip(" "))

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def margin(self) -> None:
        self.end_line()
        self.gap = True

    def children(self, n: Node, pre: bool) -> None:
        number, step = 1, 1
        if n.tag == "ol":
            if "reversed" in n.attrs:
                number, step = sum(isinstance(c, Node) and c.tag == "li" for c in n.children), -1
            number = whole(n.attrs.get("start"), number)
        folded = n.tag == "details" and "open" not in n.attrs
        for c in n.children:
            if isinstance(c, str):
                if folded:
                    continue
                if pre:
                    if self.shown:
                        first, *more = c.replace("\r\n", "\n").split("\n")
                        self.line.append(first)
                        for x in more:
                            self.end_line(force=True)
                            self.line.append(x)
                else:
                    self.words(c)
            elif not hidden(c) and not (folded and c.tag != "summary") and not (n.tag == "semantics" and c.tag in ANNOTATIONS):
                if c.tag == "li":
                    number = whole(c.attrs.get("value"), number) if n.tag == "ol" else number
                    mark = f"{number}. " if n.tag == "ol" else "- "
                    number += step
                shown = seen(c, self.shown)
                if shown is None:
                    continue
                before, self.shown = self.shown, shown
                self.item(c, mark, pre) if c.tag == "li" else self.node(c, pre)
                self.shown = before

    def item(self, n: Node, mark: str, pre: bool) -> None:
        self.end_line()
        before = self.indent
        self.indent, self.mark = before + " " * len(mark), self.mark + mark  # a mark without text of its own stands before the next
        self.children(n, pre)
        self.end_line()
        self.indent, self.mark = before, ""

    def drawing(self, n: Node, shown: bool = False) -> None:
        """What a drawing's text elements show, each a word or more of its own."""
        for c in n.children:
            if isinstance(c, str):
                if shown:
                    self.words(c)
            elif hidden(c) or c.tag in SVG_HIDDEN or c.attrs.get("display") == "none" or c.attrs.get("visibility") in ("hidden", "collapse") or seen(c, True) is not True:
                continue
            elif c.tag == "foreignobject" or (c.tag == "text" and not shown):
                self.space = True
                self.children(c, False) if c.tag == "foreignobject" else self.drawing(c, True)
                self.space = True
            else:
                self.drawing(c, shown)

    def node(self, n: Node, pre: bool) -> None:
        tag = n.tag
        if tag == "br":
            self.end_line(force=self.shown)
        elif tag == "hr":
            self.end_line()
            if self.shown:
                self.put("----")
        elif tag == "table":
            self.margin()
            self.table(n)
            self.gap = True
        elif tag == "svg":
            if self.shown:
                self.drawing(n)
        elif tag == "input":
            if n.attrs.get("type", "").lower() in ("submit", "button", "reset") and n.attrs.get("value"):
                self.words(n.attrs["value"])
        elif tag in BLOCK:
            wide = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.indent)
            self.margin() if wide else self.end_line()
            before = self.indent
            if tag in ("blockquote", "dd"):
                self.indent += "    "
            self.children(n, pre or tag in ("pre", "xmp"))
            self.end_line()
            self.indent = before
            self.gap = self.gap or wide
        else:
            self.children(n, pre or tag == "textarea")

    def table(self, n: Node) -> None:
        rows: list[list[tuple[int, list[str], int]]] = []  # cells: column, lines, columns that the cell spans
        after: list[Node] = []

        def collect(part: Node, shown: bool) -> None:
            taken: dict[int, int] = {}  # columns that cells of earlier rows of this part reach into, and for how many rows yet
            for c in part.children:
                if isinstance(c, str):
                    if c.strip():
                        self.words(c)
                elif hidden(c) or (own := seen(c, shown)) is None:
                    continue
                elif c.tag in ("thead", "tbody", "tfoot"):
                    collect(c, own)
                elif c.tag == "tr":
                    cells, at, later = [], 0, {}
                    for d in c.children:
                        if isinstance(d, str) or d.tag not in ("td", "th"):
                            if isinstance(d, str) and not d.strip() or not isinstance(d, str) and hidden(d):
                                continue
                            holder = Node("td", {})
                            holder.children.append(d)
                            d = holder
                        if not hidden(d):
                            span, deep = (d.attrs.get(k, "1") for k in ("colspan", "rowspan"))
                            wide = min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,6}", span) else 1
                            tall = (int(deep) or END_OF_PART) if re.fullmatch(r"\d{1,6}", deep) else 1
                            while at in taken:
                                at += 1
                            visible = seen(d, own)  # what isn't visible keeps its place
                            cells.append((at, [] if visible is None else lines_of(d, visible), wide))
                            if tall > 1:
                                later.update(dict.fromkeys(range(at, at + wide), tall))
                            at += wide
                    rows.append([(k, wrapped(t) if k != cells[-1][0] else t, w) for k, t, w in cells])
                    taken = {k: v - 1 for k, v in (taken | later).items() if v > 1}
                elif c.tag not in ("col", "colgroup"):
                    if own:
                        after.append(c) if rows else self.node(c, False)

        collect(n, self.shown)
        self.end_line()
        widths: dict[int, int] = {}
        for at, text, span in (cell for cells in rows for cell in cells):
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, text), default=0))
        columns = max((at + 1 for cells in rows for at, _, _ in cells), default=0)
        place = [0]
        for k in range(columns):
            place.append(place[-1] + widths.get(k, 0) + 2)
        for cells in rows:
            for k in range(max((len(t) for _, t, _ in cells), default=0)):
                line = ""
                for at, text, _ in cells:
                    if k < len(text):
                        line = line.ljust(max(place[at], len(line) + 2 if line else 0)) + text[k]
                self.put(line)
        for c in after:
            self.node(c, False)


def lines_of(n: Node, shown: bool = True) -> list[str]:
    """The lines of a cell, without blank ones at its ends and between blocks."""
    inner = Layout(cell=True, shown=shown)
    inner.children(n, False)
    inner.end_line()
    lines = inner.lines
    while lines and not lines[-1]:
        lines.pop()
    return lines[next((k for k, x in enumerate(lines) if x), 0) :]


def wrapped(lines: list[str], most: int = WIDEST) -> list[str]:
    """Lines broken at blanks so that they have ``most`` characters, or one longer word."""
    out = []
    for x in lines:
        while len(x) > most and (at := x.rfind(" ", 1, most + 1) if x.rfind(" ", 1, most + 1) > 0 else x.find(" ", most)) > 0 and x[:at].strip():
            out.append(x[:at].rstrip())
            x = x[at + 1 :].lstrip()
        out.append(x)
    return out


def whole(value: str | None, other: int) -> int:
    return int(value) if value is not None and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value) else other


def title_of(n: Node) -> str:
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag == "title":
            return BLANKS.sub(" ", "".join(c for c in x.children if isinstance(c, str))).strip()
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and c.tag not in ("svg", "template")]
    return ""


def render(source: str) -> tuple[str, str]:
    """Visible text and title."""
    tree = Tree(source)
    page = Layout()
    page.children(tree.root, False)
    page.end_line()
    return "\n".join(page.lines).strip("\n"), title_of(tree.root)


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, title, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render(x.as_py()) if x.is_valid else (None, None) for x in b.column(1)]
            texts = [t for t, _ in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for _, t in done], pa.string()), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())], names=["page_id", "title", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
