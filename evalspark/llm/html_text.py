"""HTML to the text a reader sees: a tree with implied tags, visibility rules, and a layout in lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import given_id, row_id

# Fixed values of HTML: which elements are void, raw, hidden, blocks, and which start tags end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title template noscript noframes noembed iframe object audio video canvas datalist meta link base"
    " desc metadata defs symbol annotation annotation-xml".split()  # the second line: of drawings and formulas
)
UNREAD = frozenset("hidden password checkbox radio file color range image".split())  # inputs whose value is no text
GAP = {t: 2 for t in "p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split()} | {
    t: 1
    for t in (
        "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup"
        " html legend li main menu nav optgroup option search section summary tbody td text tfoot th thead tr"
    ).split()
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul dd dt li".split()
)
CELL = frozenset(("td", "th"))
SECTION = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
WALL = frozenset(("table", "td", "th", "caption", "html", "template", "button", "object"))
#: start tag -> (open elements that it ends, elements beyond which it does not look)
IMPLIED = {
    "li": (frozenset(("li",)), WALL | {"ul", "ol", "menu", "dir"}),
    "dt": (frozenset(("dt", "dd")), WALL | {"dl"}),
    "dd": (frozenset(("dt", "dd")), WALL | {"dl"}),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "datalist"))),
    "td": (CELL, frozenset(("table", "tr"))),
    "th": (CELL, frozenset(("table", "tr"))),
    "tr": (CELL | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "thead": (CELL | SECTION | {"tr"}, frozenset(("table",))),
    "tbody": (CELL | SECTION | {"tr"}, frozenset(("table",))),
    "tfoot": (CELL | SECTION | {"tr"}, frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)
PRINT = re.compile(r"@media[^{}]*\bprint\b[^{}]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", re.I)
SIMPLE = re.compile(r"^(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*$")
SPACES = re.compile(r"[ \t\n\r\f]+")
INDENT_LEVELS = 12  # deeper lists and quotes keep their marks, but stay at this indent
PAD = 120  # a longer line of a cell stands over its column's edge, and does not widen it


class Flow:
    """Lines of one block of layout: the page, a list item, a quote, a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.marks: list[str] = []  # of deep items whose text is still to come

    def text(self, words: str, keep: bool = False) -> None:
        if keep:
            first, *rest = words.split("\n")
            self._put(first)
            for line in rest:
                self.line()
                self._put(line)
            return
        words = SPACES.sub(" ", words)
        if words[:1] == " " and (not self.parts or self.parts[-1][-1:] == " "):
            words = words[1:]
        self._put(words)

    def _put(self, words: str) -> None:
        if not words:
            return
        if not self.parts and self.gap:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        self.parts += [*self._marked(), words]

    def _marked(self) -> list[str]:
        marks, self.marks = self.marks, []
        return marks

    def line(self) -> None:
        self.lines.append("".join(self.parts).rstrip(" "))
        self.parts = []

    def block(self, gap: int) -> None:
        if self.parts:
            self.line()
        if self.lines:
            self.gap = max(self.gap, gap)

    def add(self, lines: list[str], gap: int) -> None:
        if lines:
            self.block(gap)
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.lines += ["".join(self._marked()) + lines[0], *lines[1:]]
            self.gap = gap

    def done(self) -> list[str]:
        if self.parts:
            self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        start = 0
        while start < len(self.lines) and not self.lines[start]:
            start += 1
        return self.lines[start:]


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


def _declared(style: str) -> dict[str, str]:
    """The last value of `display` and of `visibility`."""
    return {name.lower(): value.lower() for name, value in DECLARED.findall(style)}


def sheet_rules(sheet: str) -> list[tuple]:
    """(specificity, parts of the selector, declared) of the rules with a simple selector (tag, .class, #id and their
    compounds) that say whether something is seen; rules for print alone do not count."""
    found = []
    for names, body in RULE.findall(PRINT.sub("", re.sub(r"/\*.*?\*/", "", sheet, flags=re.S))):
        if declared := _declared(body):
            for name in map(str.strip, names.split(",")):
                if name and SIMPLE.match(name):
                    parts = re.findall(r"[.#]?[^.#]+", name)
                    weight = tuple(sum(p[0] == c for p in parts) for c in "#.") + (sum(p[0] not in "#.*" for p in parts),)
                    found.append((weight, parts, declared))
    return found


def _matches(parts: list[str], tag: str, names: dict[str, str]) -> bool:
    classes = names.get("class", "").split()
    return all(
        p[1:] in classes if p[0] == "." else p[1:] == names.get("id") if p[0] == "#" else p in ("*", tag)
        for p in parts
    )


def _seen(tag: str, names: dict[str, str], rules: list[tuple], visible: bool) -> tuple[bool, bool]:
    """Whether an element is left out of the layout, and whether it is visible, as its parent is unless it says so."""
    gone = tag in HIDDEN or "hidden" in names or (tag == "dialog" and "open" not in names)
    said: dict[str, str] = {}
    for _, parts, declared in rules:  # by specificity, then order
        if _matches(parts, tag, names):
            said.update(declared)
    if "style" in names:
        said.update(_declared(names["style"]))
    if said:
        gone |= said.get("display") == "none"
        visible = {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility", ""), visible)
    return gone, visible


def events(html: str) -> Iterator[tuple]:
    """The tree in document order: ("open", tag, attributes), ("close", tag), ("text", text). Tags that HTML
    leaves out are implied, unmatched end tags are ignored, everything open is closed at the end."""
    stack: list[str] = []
    count: Counter = Counter()
    at = 0

    def pop_to(depth):
        while len(stack) > depth:
            count[stack[-1]] -= 1
            yield "close", stack.pop()

    def find(tags, walls):
        if not any(count[t] for t in tags):
            return None
        for d in range(len(stack) - 1, -1, -1):
            if stack[d] in tags:
                return d
            if stack[d] in walls:
                return None
        return None

    while True:
        low = html.find("<", at)
        m = TOKEN.match(html, low) if low >= 0 else None
        if low < 0:
            if at < len(html):
                yield "text", html[at:]
            break
        if low > at:
            yield "text", html[at:low]
        if m is None:
            yield "text", "<"
            at = low + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br"
            elif count[tag]:
                walls = frozenset() if tag in ("html", "body", "table") else frozenset(("table",)) if tag in IMPLIED else WALL - {tag}
                if (d := find((tag,), walls)) is not None:
                    yield from pop_to(d)
            continue
        if count["head"] and tag not in IN_HEAD and (d := find(("head",), frozenset())) is not None:
            yield from pop_to(d)
        if tag in IMPLIED and (d := find(*IMPLIED[tag])) is not None:
            # of a nest of cells, rows and sections the outermost ends
            tags, walls = IMPLIED[tag]
            while d > 0 and stack[d - 1] in tags and stack[d - 1] not in walls:
                d -= 1
            yield from pop_to(d)
        if tag in ENDS_P and count["p"] and (d := find(("p",), WALL)) is not None:
            yield from pop_to(d)
        names = attributes(m[3] or m[6] or "") if (m[3] or m[6]) else {}
        yield "open", tag, names
        if tag in VOID:
            yield "close", tag
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if raw := html[at : end.start() if end else len(html)]:
                yield "raw", raw
            at = html.find(">", end.end()) + 1 if end and html.find(">", end.end()) >= 0 else len(html)
            yield "close", tag
        else:
            stack.append(tag)
            count[tag] += 1
    yield from pop_to(0)


def _places(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """Rows of (column, lines, columns): a cell over several rows occupies its columns in the next ones, empty there."""
    out, below = [], []  # below: (column, columns, rows left)
    for row in rows:
        taken = [(c, [], span) for c, span, _ in below]
        placed, c, k = [], 0, 0
        after = [(c, span, left - 1) for c, span, left in below if left > 1]
        for lines, span, tall in row:
            while k < len(taken) and taken[k][0] <= c:
                c = max(c, taken[k][0] + taken[k][2])
                k += 1
            placed.append((c, lines, span))
            if tall > 1:
                after.append((c, span, tall - 1))
            c += span
        out.append(sorted(placed + taken, key=lambda p: p[0]))
        below = sorted(after)
    return out


def _align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells of a table in columns, each padded to its widest line of up to `PAD` characters."""
    placed, width = _places(rows), {}
    for row in placed:
        for c, lines, span in row:
            if span == 1:
                width[c] = max([width.get(c, 0), *(n for n in map(len, lines) if n <= PAD)])
    out = []
    for row in placed:
        # a row of cells from above alone has no line of its own
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            parts = [(lines[k] if k < len(lines) else "").ljust(width[c] if span == 1 else 0) for c, lines, span in row]
            out.append(" | ".join(parts).rstrip())
    return out


def _span(names: dict[str, str], which: str, most: int) -> int:
    """The columns or rows of a cell; 0 rows are all that follow."""
    text = names.get(which, "1").strip()
    number = int(text) if re.fullmatch(r"\d{1,5}", text) else 1
    return min(number or (most if which == "rowspan" else 1), most)


class Element:
    """An open element: its tag, whether its content is left out or invisible, and the flows open below it."""

    __slots__ = ("tag", "gone", "visible", "depth", "folded", "marked")

    def __init__(self, tag: str, gone: bool, visible: bool, depth: int, folded: bool):
        self.tag, self.gone, self.visible, self.depth = tag, gone, visible, depth
        self.folded = folded  # closed details: all but the first summary is out of sight
        self.marked = False


def render(html: str | None) -> str:
    """All visible text of a page. Blocks stand on lines of their own, paragraphs, headings, lists and tables
    are set off by blank lines, list items carry bullets or numbers and indents, table cells are aligned.

    Not visible: what HTML hides (heads, scripts, closed dialogs, closed details but for their summary, values of
    check boxes and the like, options that no `selected` marks unless the whole list is shown), `hidden`, and
    `display` or `visibility` by a style or a simple rule; a visible child of an invisible element is seen."""
    if not html:
        return ""
    flows: list[Flow] = [Flow()]
    rules: list[tuple] = []
    lists: list[list] = []  # kind and last number
    tables: list[list] = []
    choices: list[bool] = []  # open selects: whether all options are shown
    gone = pre = 0
    opened = [Element("", False, True, 1, False)]
    for kind, what, *more in events(html.replace("\r\n", "\n").replace("\x00", "�")):
        top, flow = opened[-1], flows[-1]
        if kind == "text" or kind == "raw":
            if top.tag == "style" and kind == "raw":
                rules = sorted(rules + sheet_rules(what), key=lambda r: r[0])
            elif not gone and top.visible and not top.folded and top.tag not in ("select", "optgroup"):
                flow.text(unescape(what) if "&" in what else what, pre > 0)
            continue
        if kind == "open":
            names = more[0]
            hide, visible = _seen(what, names, rules, top.visible)
            if top.folded:
                hide |= what != "summary" or top.marked
                top.marked |= what == "summary"
            if what == "option" and choices and not choices[-1]:
                hide |= "selected" not in names
            here = Element(what, hide, visible, len(flows), what == "details" and "open" not in names)
            opened.append(here)
            gone += hide
            if gone:
                continue
            if what == "br":
                flow.line()
                continue
            flow_gap = GAP.get(what, 0)
            if what == "hr" and visible:
                flow.add(["---"], 1)
            elif what == "img" or what == "input":
                kind_of = names.get("type", "").lower() if what == "input" else "image"
                if visible:
                    flow.text(names.get("alt", "") if kind_of == "image" else "" if kind_of in UNREAD else names.get("value", ""))
            elif what == "select":
                size = names.get("size", "")
                choices.append("multiple" in names or (size.isascii() and size.isdigit() and int(size[:9]) > 1))
            elif what == "option" and choices and not choices[-1]:
                pass  # stands in the line, as its select does
            elif what in ("ul", "ol", "menu", "dir"):
                flow.block(1 if lists else 2)
                start = names.get("start", "")
                lists.append([what, int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0])
            elif what in ("li", "blockquote", "dd"):
                flow.block(flow_gap)
                if len(flows) <= INDENT_LEVELS:
                    flows.append(Flow())
                elif what != "dd" and visible:
                    flow.marks.append(_mark(what, lists))
                    here.marked = True
            elif what == "table":
                flow.block(2)
                tables.append([])
            elif what == "tr" and tables:
                tables[-1].append([])
            elif what in CELL and tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append([[], _span(names, "colspan", 1000), _span(names, "rowspan", 65534)])
                flows.append(Flow())
            elif flow_gap:
                flow.block(flow_gap)
            if what in ("pre", "textarea"):
                pre += 1
            elif what == "q" and visible:
                flow.text('"')
            continue
        here = opened.pop()
        was_gone, gone = gone, gone - here.gone
        if was_gone:
            continue
        if what in ("pre", "textarea"):
            pre -= 1
        if len(flows) > here.depth and what in ("li", "blockquote", "dd"):
            lines = flows.pop().done()
            mark = _mark(what, lists) if here.visible else "  "
            rest = mark if what == "blockquote" else " " * len(mark)
            flows[-1].add([(rest if i else mark) + line if line else line for i, line in enumerate(lines)], GAP[what])
        elif what in CELL and len(flows) > here.depth:
            tables[-1][-1][-1][0] = flows.pop().done()
        elif what == "table" and tables:
            flows[-1].add(_align([[tuple(c) for c in row] for row in tables.pop()]), 2)
        elif what in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.block(1 if lists else 2)
        elif what == "q" and here.visible:
            flow.text('"')
        elif what == "select":
            choices.pop()
        elif what == "option" and choices and not choices[-1]:
            pass
        elif what in GAP:
            flow.block(GAP[what])
            if here.marked and flow.marks and what in ("li", "blockquote"):
                flow.marks.pop()  # an item without text
    while len(flows) > 1:
        lines = flows.pop().done()
        flows[-1].add(lines, 1)
    return "\n".join(flows[0].done())


def _mark(tag: str, lists: list[list]) -> str:
    """What stands before an item; numbers go on."""
    if tag != "li":
        return "> " if tag == "blockquote" else "  "
    if lists and lists[-1][0] == "ol":
        lists[-1][1] += 1
        return f"{lists[-1][1]}. "
    return "- "


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = A.ids(batch.column("id"))
        texts, at, size = [], 0, 0
        for k, html in enumerate(batch.column("html")):
            texts.append(render(html.as_py()))
            size += len(texts[-1])
            if size > 1 << 22 or k == len(ids) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : k + 1]), pa.array(texts, pa.string())], names=["id", "text"])
                texts, at, size = [], k + 1, 0


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and text. Null and empty pages give empty text; text without markup comes through
    as it is, with white space collapsed. Rows that share an id are rendered each; a null id comes back as
    null. Malformed markup never fails: what cannot be a tag is text."""
    rows = pages.select(row_id(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "id long, text string").select(given_id("id").alias(id_col), "text")
