"""Visible text of HTML pages, laid out: blocks apart, lists marked, table cells aligned.

``events`` builds the element tree as a well-formed stream, adding the end tags that HTML implies;
``render`` walks it with the rules of visibility and layout. Neither recurses, and open elements are found by their
name, so depth is no limit. What layout adds is bounded by the page: quotes, lists and tables are drawn to a depth of
``DEEPEST``, deeper ones as that one, and a table whose padding would exceed ``PADDING`` times its source is not padded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element groups of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript iframe noembed noframes object audio video canvas datalist title".split())
#: Elements of svg and math that are not drawn, and HTML elements that end svg and math, but in these places.
UNDRAWN = set("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
HTML_WITHIN = {"foreignobject", "desc", "title", "annotation-xml", "mtext", "mi", "mn", "mo", "ms"}
BLOCKS = set(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table ul".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
CLOSES_P = BLOCKS - {"body", "html", "dd", "dt", "li"}
#: A start tag ends these open elements, unless one of the others stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()), "input": ({"select"}, set()), "textarea": ({"select"}, set()), "select": ({"select"}, set()),
}
#: Levels of quotes, lists and nested tables that are drawn apart, and characters of a padded table by one of its source.
DEEPEST, PADDING = 16, 32
# fixed values: the largest spans of cells that HTML knows
MOST_COLUMNS, MOST_ROWS = 1000, 65534
HEAD = set("base link meta title style script noscript template head html".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z|(?:^|\s)[^\s=\"']+/\s*\Z")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)", re.IGNORECASE)
_BLANK = re.compile(r"[ \t\n\f\r]+")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


def attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in reversed(_ATTRIBUTE.findall(raw))}


def _number(text: str | None, otherwise: int) -> int:
    found = _NUMBER.match(text or "")
    return int(found[1]) if found else otherwise


class _Open:
    """The open elements, with the places of each name, so that none is searched for."""

    def __init__(self):
        self.tags: list[str] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, name: str) -> None:
        self.places[name].append(len(self.tags))
        self.tags.append(name)

    def pop(self) -> str:
        name = self.tags.pop()
        self.places[name].pop()
        return name

    def last(self, names: set[str]) -> int:
        """Place of the innermost open element of ``names``, -1 without one."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def outermost(self, names: set[str], fence: set[str]) -> int | None:
        """Place of the outermost open element of ``names`` inside the innermost element of ``fence``."""
        held = [self.places[n] for n in names if self.places[n]]
        if not held:
            return None
        after = self.last(fence)
        inside = [p[i] for p in held if (i := bisect_right(p, after)) < len(p)]
        return min(inside, default=None)


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("start", tag, attributes), ("text", text, "") and ("end", tag, ""), every start with its end."""
    opened = _Open()
    tags, places = opened.tags, opened.places
    foreign: list[int] = []  # places of svg and math among the open elements
    at, n = 0, len(html)

    def down_to(place: int):
        while len(tags) > place:
            yield "end", opened.pop(), ""
        while foreign and foreign[-1] >= place:
            foreign.pop()

    while at < n:
        tag = _TAG.search(html, at)
        begin = tag.start() if tag else n
        if begin > at:
            if tags and tags[-1] == "head" and html[at:begin].strip():
                yield from down_to(len(tags) - 1)
            yield "text", unescape(html[at:begin]), ""
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if tag[1]:
            if places.get(name):
                place = places[name][-1]
                if name in ("table", "body", "html") or opened.last({"table"}) < place:
                    yield from down_to(place)
            elif name in ("br", "p"):
                yield "start", name, ""
                yield "end", name, ""
            continue
        if name in ("html", "body", "head") and places[name]:
            continue
        if foreign and name in BREAKS_OUT and opened.last(HTML_WITHIN) < foreign[-1]:
            yield from down_to(foreign[0])
        if places["head"] and name not in HEAD:
            yield from down_to(places["head"][0])
        if name in CLOSES_P and (place := opened.outermost({"p"}, {"table", "td", "th", "button", "object"})) is not None:
            yield from down_to(place)
        if name in IMPLIED and (place := opened.outermost(*IMPLIED[name])) is not None:
            yield from down_to(place)
        yield "start", name, tag[3]
        if name in VOID or ((foreign or name in ("svg", "math")) and _CLOSED.search(tag[3])):
            yield "end", name, ""
            continue
        if name in ("svg", "math"):
            foreign.append(len(tags))
        opened.push(name)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", unescape(html[at:stop]) if name in ("textarea", "title") else html[at:stop], ""
            at = stop
    yield from down_to(0)


class _Flow:
    """Lines of text: white space collapses, and between blocks the largest wanted gap stands."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank, self.quotes, self.mark = 0, False, 0, ""

    def text(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._add(first)
            for more in rest:
                self.newline()
                self._add(more)
            return
        words = _BLANK.sub(" ", text)
        if words == " " or not words:
            self.blank = self.blank or bool(words)
            return
        if self.line and (self.blank or words[0] == " "):
            self.line.append(" ")
        self._add(words.strip(" "))
        self.blank = words[-1] == " "

    def _add(self, text: str) -> None:
        if text:
            if not self.line:
                self._open()
            self.line.append(text)

    def _open(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.line.append("> " * min(self.quotes, DEEPEST) + self.mark)
        self.mark = " " * len(self.mark)

    def newline(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def block(self, gap: int) -> None:
        if self.line:
            self.newline()
        self.blank = False
        self.gap = max(self.gap, gap)

    def done(self) -> str:
        self.block(0)
        return "\n".join(self.lines).strip("\n")


@dataclass
class _Cell:
    columns: int
    rows: int
    lines: list[str] = field(default_factory=list)
    column: int = 0


@dataclass
class _Table:
    """A table being read: ``below`` is the flow that it stands in, ``begun`` the size of the page before it."""

    below: _Flow
    begun: int
    flat: bool
    rows: list[list[_Cell]] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)


def width(text: str) -> int:
    """Places that a text takes: two a wide character, none a combining one."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class _TooWide(Exception):
    """The layout of a table would take more than its budget."""


class _Budget:
    def __init__(self, left: int):
        self.left = left

    def take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise _TooWide


def _place(rows: list[list[_Cell]], budget: _Budget) -> None:
    """Give each cell its first column, beside cells of earlier rows that span it."""
    spans: list[tuple[int, int, int]] = []  # first column, column after, row after
    for y, row in enumerate(rows):
        spans = [s for s in spans if s[2] > y]
        budget.take(len(spans))
        column, at, new = 0, 0, []
        for cell in row:
            while at < len(spans) and spans[at][0] <= column:
                column, at = max(column, spans[at][1]), at + 1
            cell.column = column
            column += cell.columns
            if cell.rows > 1:
                new.append((cell.column, column, y + cell.rows))
        if new:
            spans = sorted(spans + new)


def _columns(rows: list[list[_Cell]], budget: _Budget) -> list[int]:
    """Where each column begins: as wide as its widest cell and two blanks; one without text takes no place."""
    widths: list[int] = []
    wide = []
    for row in rows:
        for cell in row:
            budget.take(cell.columns)
            widths += [0] * (cell.column + cell.columns - len(widths))
            if cell.columns == 1:
                widths[cell.column] = max([widths[cell.column], *map(width, cell.lines)])
            else:
                wide.append(cell)
    for cell in sorted(wide, key=lambda c: c.columns):
        parts = [w for w in widths[cell.column : cell.column + cell.columns] if w]
        last = cell.column + cell.columns - 1
        gap = 2 * (len(parts) - (widths[last] > 0))
        missing = max(map(width, cell.lines), default=0) - sum(parts) - gap
        widths[last] += max(0, missing)
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + (w + 2 if w else 0))
    return starts


def _padded(rows: list[list[_Cell]], budget: _Budget) -> list[str]:
    """The rows, each cell at its column; a cell over several rows goes on beside the next ones."""
    _place(rows, budget)
    starts = _columns(rows, budget)
    out: list[str] = []
    spanning: list[tuple[int, int, list[str]]] = []  # last row, column, lines
    for y, row in enumerate(rows):
        here = spanning + [(y + cell.rows - 1, cell.column, cell.lines) for cell in row]
        budget.take(len(here))
        last = y + 1 == len(rows)
        height = max([1, *(len(lines) for end, _, lines in here if end <= y or last)])
        here.sort(key=lambda c: c[1])
        for i in range(height):
            line, at = [], 0
            for _, column, lines in here:
                if i < len(lines) and lines[i]:
                    gap = starts[column] - at
                    gap = 2 if line and gap < 2 else max(gap, 0)  # spans that overlap
                    budget.take(gap + len(lines[i]))
                    line += [" " * gap, lines[i]]
                    at = max(at + gap, starts[column]) + width(lines[i])
            budget.take(len(here))
            out.append("".join(line))
        spanning = [(end, column, lines[height:]) for end, column, lines in here if end > y]
    return out


def _laid(rows: list[list[_Cell]], budget: int) -> list[str]:
    """Lines of a table: cells padded to their columns or, where that takes too much, two blanks apart."""
    try:
        return _padded(rows, _Budget(budget))
    except _TooWide:
        return [line for row in rows for line in "  ".join("\n".join(c.lines) for c in row).split("\n")]


def _looks(own: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether an element takes no place, and whether it says that its text is seen."""
    style = {k.lower(): v.lower() for k, v in _STYLE.findall(own["style"])} if own.get("style") else {}
    away = style["display"] == "none" if "display" in style else "hidden" in own
    return away, style["visibility"] not in ("hidden", "collapse") if "visibility" in style else None


def render(html: str) -> str:
    """All visible text of a page. White space alone, or nothing visible, gives an empty text.

    What stands in a table but in no cell or caption goes before the table, as in a browser. A table of one line
    within a cell stands in the line of that cell.
    """
    counts: list[int] = []
    text = _render(html, counts, None)
    # a reversed list begins at the number of its items, which only its end tells
    return _render(html, [], counts) if "reversed" in html.lower() else text


def _render(html: str, counts: list[int], known: list[int] | None) -> str:
    """``counts`` takes the items of each list of the page; ``known`` are those of an earlier walk."""
    flows, lists, tables, selects = [_Flow()], [], [], []
    unseen, kept, foreign, size = 0, 0, 0, 0
    hidden: list[bool] = []
    veils: list[tuple[int, bool]] = []  # depth of elements that say whether text is seen
    folded: list[list] = []  # depth of closed details, whether their summary has come
    for kind, name, raw in events(html):
        flow, depth = flows[-1], len(hidden)
        size += 1
        seen = not veils or veils[-1][1]
        if kind == "text":
            size += len(name)
            if unseen or not seen or (folded and folded[-1][0] == depth):
                continue
            if not (tables and tables[-1].below is flow and not name.strip()):
                flow.text(name, keep=kept > 0)
            continue
        if kind == "start":
            own = attributes(raw) if raw and raw.strip("/ \n\t") else {}
            size += len(raw)
            foreign += name in ("svg", "math")
            away, says = _looks(own) if own else (False, None)
            hide = away or name in UNSEEN or (foreign and name in UNDRAWN) or (name == "dialog" and "open" not in own)
            if folded and folded[-1][0] == depth:
                if name == "summary" and not folded[-1][1]:
                    folded[-1][1] = True
                else:
                    hide = True
            if name not in VOID:
                hidden.append(bool(hide))
                unseen += bool(hide)
                if says is not None:
                    veils.append((depth, says))
                    seen = says
                if name == "details" and "open" not in own:
                    folded.append([depth + 1, False])
            if unseen or (hide and name in VOID):
                continue
            if name == "br":
                if flow.line:
                    flow.newline()
                else:
                    flow.lines.append("")
            elif name == "input":
                if seen and says is not False and own.get("type", "text").lower() in ("text", "submit", "button", "reset") and own.get("value"):
                    flow.text(f" {own['value']} ")
            elif name == "hr":
                flow.block(0)
                if seen and says is not False:
                    flow.text("-" * 20)
                flow.block(0)
            elif name == "table":
                tables.append(_Table(flow, size, len(tables) >= DEEPEST))
            elif name == "tr" and tables:
                if tables[-1].flat:
                    flow.block(0)
                else:
                    tables[-1].rows.append([])
            elif name in ("td", "th") and tables:
                if tables[-1].flat:
                    flow.text(" ")
                    continue
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                columns, rows = _number(own.get("colspan"), 1), _number(own.get("rowspan"), 1)
                tables[-1].rows[-1].append(_Cell(min(max(columns, 1), MOST_COLUMNS), min(max(rows, 0) or MOST_ROWS, MOST_ROWS)))
                flows.append(_Flow())
            elif name == "caption" and tables:
                if not tables[-1].flat:
                    flows.append(_Flow())
            elif name == "select":
                several = "multiple" in own or _number(own.get("size"), 1) > 1
                selects.append((several and seen, [], seen))
                flows.append(_Flow())
            elif name == "option" and selects:
                selects[-1][1].append([own.get("label", ""), "selected" in own, "disabled" in own])
                flows.append(_Flow())
            elif name == "optgroup" and selects:
                if selects[-1][0] and own.get("label"):
                    selects[-1][1].append([own["label"], False, True])
            elif foreign and name == "text":
                flow.block(0)
            elif name in BLOCKS:
                flow.block(1 if name in SPACED and not (name in ("ul", "ol") and lists) else 0)
                if name in ("ul", "ol", "menu"):
                    back = name == "ol" and "reversed" in own
                    first = known[len(counts)] if back and known else 1
                    lists.append([name, _number(own.get("start"), first), -1 if back else 1, len(counts)])
                    counts.append(0)
                elif name == "li":
                    indent = "  " * min(max(0, len(lists) - 1), DEEPEST)
                    numbered = lists and lists[-1][0] == "ol"
                    if numbered:
                        lists[-1][1] = _number(own.get("value"), lists[-1][1])
                        counts[lists[-1][3]] += 1
                    flow.mark = indent + (f"{lists[-1][1]}. " if numbered else "- ")
                    if numbered:
                        lists[-1][1] += lists[-1][2]
                elif name == "dd":
                    flow.mark = "    "
                elif name == "blockquote":
                    flow.quotes += 1
                elif name == "pre":
                    kept += 1
            continue
        foreign -= name in ("svg", "math")
        if name not in VOID:
            was = not unseen
            unseen -= hidden.pop()
            if veils and veils[-1][0] == len(hidden):
                veils.pop()
            if folded and folded[-1][0] == len(hidden) + 1:
                folded.pop()
            if not was:
                continue
        if name in ("td", "th", "caption") and tables:
            if tables[-1].flat:
                flow.block(0) if name == "caption" else flow.text(" ")
            elif name == "caption":
                tables[-1].titles.append(flows.pop().done())
            else:
                tables[-1].rows[-1][-1].lines = [line for line in flows.pop().done().split("\n") if line.strip()]
        elif name == "option" and selects:
            shown = _BLANK.sub(" ", flows.pop().done())
            selects[-1][1][-1][0] = selects[-1][1][-1][0] or shown
        elif name == "select" and selects:
            several, options, drawn = selects.pop()
            flows.pop()
            if several:
                for label, _, _ in options:
                    flows[-1].block(0)
                    flows[-1].text(label)
                flows[-1].block(0)
            elif drawn:
                shown = [o for o in options if o[1]][-1:] or [o for o in options if not o[2]][:1]
                for label, _, _ in shown:
                    flows[-1].text(f" {label} ")
        elif foreign and name == "text":
            flow.block(0)
        elif name == "table" and tables:
            table = tables.pop()
            below = table.below
            if table.flat:
                below.block(0)
                continue
            lines = [line for line in _laid([r for r in table.rows if r], PADDING * (size - table.begun)) if line.strip()]
            if tables and len(lines) == 1 and not table.titles:
                below.text(f" {lines[0]} ")
                continue
            below.block(1)
            for title in table.titles:
                below.text(title)
                below.block(0)
            for line in lines:
                below.text(line, keep=True)
                below.block(0)
            below.block(1)
        elif name in BLOCKS:
            flow.block(1 if name in SPACED and not (name in ("ul", "ol") and len(lists) > 1) else 0)
            if name in ("ul", "ol", "menu") and lists:
                lists.pop()
            elif name in ("li", "dd"):
                flow.mark = ""
            elif name == "blockquote":
                flow.quotes -= 1
            elif name == "pre":
                kept -= 1
    return flows[0].done()


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, html): page_id, text, n_chars.

    Null and empty pages give an empty text. Broken mark-up never fails: what is no tag is text, and open
    elements end with the page. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h) if h else "" for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, text string, n_chars long")
