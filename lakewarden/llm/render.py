"""Text of web pages as they are laid out.

A scanner splits markup into tags and text; a tree builder opens and closes
elements with the implied end tags of HTML (a new ``li`` ends the last one, a
block ends a paragraph, a cell ends a cell, and so on) and drops end tags that
match nothing; the layout writes all text that is visible.

Visibility is that of the cascade (:mod:`styles`): all style sheets of the page
hold for all of it, by importance, specificity and order, with compound, child
and descendant selectors; then the element's own style, and below both its
``hidden``. Never rendered are ``head``, ``script``, ``template`` and others. A
``details`` that is not open shows its summary alone, a ``dialog`` that is not
open nothing. ``display:none`` hides all that is inside of an element;
``visibility:hidden`` what is not ``visible`` again.

Blocks begin on lines of their own, with a blank line around paragraphs,
headings, lists, quotes and tables; list items get ``-`` or their number and
are indented by depth, up to :data:`MOST_INDENT` columns; ``pre`` keeps its
white space; the columns of a table line up. All spaces that line columns up
are at most :data:`MOST_PADDING` times the page's length: a table that needs
more than is left has its cells two spaces apart instead, and the cells of tables in
more than :data:`MOST_NESTED` others are blocks. Everything is driven by
stacks, and takes time in proportion to the page.

Defined results: null and empty pages have empty text; text outside any tag is
rendered; a tag that never ends hides what follows, as in browsers; a quote in
a tag that never ends is a character like others. Repeated rows get equal
results; columns of any name are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm import store, styles, textvec

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head title script style template noscript iframe noembed noframes object datalist audio video canvas svg math map".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer header hgroup html legend li main nav option search section summary tbody td tfoot th thead tr caption optgroup".split())
#: A start tag of the key ends the nearest open element among the first set, unless one of the second lies between.
_SCOPES = frozenset("table td th caption html template object".split())
_LISTS = _SCOPES | {"ul", "ol", "menu", "dl"}
IMPLIED = {
    "li": (frozenset({"li"}), _LISTS),
    "dt": (frozenset({"dt", "dd"}), _LISTS),
    "dd": (frozenset({"dt", "dd"}), _LISTS),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"table"})),
    "th": (frozenset({"td", "th"}), frozenset({"table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
_PARAGRAPH = (frozenset({"p"}), _SCOPES | {"button"})
_HEAD = frozenset("head title meta link style script base template noscript html".split())

#: An attribute: its name, then perhaps a value in quotes, or one without, in which quotes are characters like others.
_NAMED = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>)))?+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAMED})*+)>")
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>)))?+")
#: Columns beyond which lists and quotes are not indented, and spaces of tables for each character of a page.
MOST_INDENT, MOST_PADDING = 64, 8
#: Tables within tables beyond which cells are blocks of the cell around them.
MOST_NESTED = 32
_SPACE = re.compile(r"[ \t\n\r\f]+")


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """Events ("text", text, ""), ("start", tag, attributes) and ("end", tag, "")."""
    at, no_comment_end = 0, False
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        if page.startswith("<!--", begin):
            end = -1 if no_comment_end else page.find("-->", begin + 4)
            no_comment_end = end < 0
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = len(page) if end < 0 else end + 1
            continue
        tag = _TAG.match(page, begin)
        if not tag and _OPENS.match(page, begin):
            return  # a tag that never ends
        if not tag:
            nxt = page.find("<", begin + 1)
            nxt = len(page) if nxt < 0 else nxt
            yield "text", page[begin:nxt], ""
            at = nxt
            continue
        name = tag[2].lower()
        at = tag.end()
        if tag[1]:
            yield "end", name, ""
            continue
        yield "start", name, tag[3]
        if name in RAW:
            found = re.compile(f"</{name}", re.I | re.A).search(page, at)
            end = found.start() if found else len(page)
            if end > at:
                yield "text", page[at:end], ""
            at = end


def attributes(raw: str) -> dict[str, str]:
    if not raw.strip(" /"):
        return {}
    return {name.lower(): html.unescape(value[1:-1] if value[:1] in ("'", '"') else value) for name, value in reversed(_ATTRIBUTE.findall(raw))}


def build(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Balanced events: the tree, in document order. Text events carry their text as the name."""
    open_tags: list[str] = []
    places: dict[str, list[int]] = {}  # of open elements by tag

    def nearest(tags: frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def closing(ends: frozenset, bars: frozenset) -> int:
        """The place from which elements close, or the stack's height."""
        end = nearest(ends)
        return end if end >= 0 and end > nearest(bars - ends) else len(open_tags)

    for kind, name, raw in scan(page):
        if kind == "text":
            yield "text", name, {}
            continue
        if kind == "end":
            bars = frozenset({"table"}) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else (_SCOPES - {name} if name != "table" else frozenset())
            cut = closing(frozenset({name}), bars)
        else:
            cut = len(open_tags)
            if name in BLOCK and name not in IMPLIED:
                cut = closing(*_PARAGRAPH)
            if name in IMPLIED:
                cut = closing(*IMPLIED[name])
            elif places.get("head") and name not in _HEAD:
                cut = min(cut, places["head"][0])
        while len(open_tags) > cut:
            places[open_tags[-1]].pop()
            yield "end", open_tags.pop(), {}
        if kind == "start":
            found = attributes(raw)
            yield "start", name, found
            if name in VOID:
                yield "end", name, {}
            else:
                places.setdefault(name, []).append(len(open_tags))
                open_tags.append(name)
    while open_tags:
        yield "end", open_tags.pop(), {}


@dataclass
class Flow:
    """Lines of one block container (the page, or a cell)."""

    lines: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)  # of the line that is being filled
    blank: bool = False  # a blank line is due before the next line
    space: bool = False
    marker: str = ""
    indent: int = 0

    def text(self, value: str) -> None:
        """Adds inline text, its white space collapsed."""
        body = _SPACE.sub(" ", value)
        if not body.strip(" "):
            self.space |= bool(body) and bool(self.words)
            return
        if (body[0] == " " or self.space) and self.words:
            self.words.append(" ")
        self.words.append(body.strip(" "))
        self.space = body[-1] == " "

    def line(self) -> None:
        """Ends the line, if it holds anything."""
        if self.words:
            self.put("".join(self.words))
        self.words, self.space = [], False

    def put(self, body: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = min(self.indent, MOST_INDENT)
        pad = " " * indent
        if self.marker:
            pad, self.marker = " " * max(0, indent - len(self.marker)) + self.marker, ""
        self.lines.append((pad + body).rstrip())

    def gap(self) -> None:
        self.line()
        self.blank = True


@dataclass
class Table:
    rows: list[list[tuple[list[str], int, int]]] = field(default_factory=list)  # of each cell its lines, columns and rows


class Spent(Exception):
    """More spaces, or more work for them, than is left."""


@dataclass
class Room:
    """Spaces that are left for all tables of a page; what a table has used, be it for nothing, is gone."""

    left: int

    def take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            self.left = 0
            raise Spent


def _gridded(table: Table, room: Room) -> list[list[tuple[list[str], int, int]]]:
    """The rows with each cell's column: (lines, first column, columns). Columns that a cell above reaches into are taken."""
    busy: list[tuple[int, int, int]] = []  # first column, the column behind the last one, rows that they are still taken for
    out = []
    for row in table.rows:
        room.take(len(busy))
        line: list[tuple[list[str], int, int]] = []
        at, k, fresh = 0, 0, []
        for lines, columns, rows in row:
            while k < len(busy) and busy[k][0] <= at:
                at = max(at, busy[k][1])
                k += 1
            line.append((lines, at, columns))
            if rows > 1:
                fresh.append((at, at + columns, rows - 1))
            at += columns
        if busy or fresh:
            busy = sorted([(a, b, n - 1) for a, b, n in busy if n > 1] + fresh)
        out.append(line)
    return out


def aligned(table: Table, room: Room) -> list[str]:
    """The lines of a table, each column beginning where the widest cell of the one before ends; a cell over several columns counts for none of them. Where there is no room for that, cells are two spaces apart."""
    try:
        rows = _gridded(table, room)
        widths: dict[int, int] = {}
        for row in rows:
            for lines, at, span in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
        columns = sorted(widths)
        begins = [0, *accumulate(widths[c] + 2 for c in columns)]
        return [one for row in rows for one in _lines([(lines, begins[bisect_left(columns, at)]) for lines, at, _ in row], room)]
    except Spent:
        return [one for row in table.rows for one in _lines([(lines, 0) for lines, _, _ in row], None)]


def _lines(cells: list[tuple[list[str], int]], room: Room | None) -> Iterator[str]:
    """The lines of a row of cells, which begin at given columns or two spaces behind the text before them."""
    held: dict[int, list[tuple[str, int]]] = {}
    for lines, begin in cells:
        for k, text in enumerate(lines):
            if text.strip():
                held.setdefault(k, []).append((text, begin))
    for k in range(max((len(lines) for lines, _ in cells), default=0)):
        parts, size = [], 0
        for text, begin in held.get(k, ()):
            pad = max(begin - size, 2 if size else 0)
            if room is not None:
                room.take(pad)
            parts += [" " * pad, text]
            size += pad + len(text)
        yield "".join(parts).rstrip()


def _span(said: str, most: int) -> int:
    """How many columns or rows a cell takes; fixed values of HTML: the most there may be."""
    return max(1, min(most, int(said))) if said.isascii() and said.isdigit() and len(said) < 9 else 1


def sheets(page: str) -> str:
    """The style sheets of a page that hold on a screen, one after the other."""
    if "<style" not in page and "<style" not in page.lower():
        return ""
    found, inside, takes = [], 0, False
    for kind, name, own in build(page):
        if kind == "text":
            if takes and not inside:
                found.append(name)
        elif kind == "start":
            inside += name in NEVER and name not in ("head", "style")
            takes = name == "style" and styles.applies(own.get("media", ""))
        else:
            inside -= name in NEVER and name not in ("head", "style")
            takes = False
    return "\n".join(found)


def rendered(page: str) -> str:
    """The visible text of a page."""
    flows, tables, lists = [Flow()], [], []
    hidden = 0  # elements that are open inside of a hidden one, and that one
    pre = deep = 0
    sheet, room = styles.Sheet(sheets(page)), Room(MOST_PADDING * len(page))
    unseen: list[bool] = [False]  # of each open element that is laid out: whether its text is invisible
    closed: list[int] = [0]  # of each: 1 for details that are not open, 2 once their summary came
    states = [sheet.start]
    for kind, name, found in build(page):
        flow = flows[-1]
        if kind == "text":
            if not hidden and not unseen[-1] and not closed[-1]:
                value = html.unescape(name).replace("\xa0", " ")
                if pre:
                    first, *rest = value.split("\n")
                    flow.words.append(first)
                    for part in rest:
                        flow.put("".join(flow.words))
                        flow.words = [part]
                else:  # text of a table that is in no cell comes before it
                    flow.text(value)
            continue
        if kind == "start":
            if hidden:
                hidden += 1
                continue
            state, display, own = sheet.entered(states[-1], name, found)
            usual = "none" if "hidden" in found or (name == "dialog" and "open" not in found) else "shown"
            folded = closed[-1] == 2 or (closed[-1] == 1 and name != "summary")
            if name in NEVER or folded or (display or usual) == "none" or (name == "input" and found.get("type", "").lower() == "hidden"):
                hidden = 1
                continue
            if closed[-1]:
                closed[-1] = 2
            states.append(state)
            closed.append(int(name == "details" and "open" not in found))
            unseen.append(unseen[-1] if own in ("", "inherit") else own == "hidden")
            if name == "br":
                if flow.words:
                    flow.line()
                elif not pre:
                    flow.blank = bool(flow.lines)
            elif name == "table":
                flow.gap()
                deep += len(tables) >= MOST_NESTED
                if not deep:
                    tables.append((Table(), flow, len(lists)))
            elif tables and name == "tr" and not deep:
                tables[-1][0].rows.append([])
            elif tables and name in ("td", "th") and not deep:
                if not tables[-1][0].rows:
                    tables[-1][0].rows.append([])
                tables[-1][0].rows[-1].append(([], _span(found.get("colspan", "1"), 1000), _span(found.get("rowspan", "1"), 65534)))
                flows.append(Flow())
            elif name in ("ul", "ol", "menu"):
                flow.gap() if not lists else flow.line()
                start = found.get("start", "1")
                lists.append([name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                flow.indent += 2 if name != "ol" else 3
            elif name == "li":
                flow.line()
                if lists and lists[-1][0] == "ol":
                    flow.marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    flow.marker = "- "
                if unseen[-1]:
                    flow.marker = ""
            elif name in ("dd", "blockquote"):
                flow.gap() if name == "blockquote" else flow.line()
                flow.indent += 2
            elif name in SPACED:
                flow.gap()
            elif name in BLOCK:
                flow.line()
            pre += name == "pre"
            continue
        if hidden:
            hidden -= 1
            continue
        unseen.pop()
        closed.pop()
        states.pop()
        if name == "pre":
            pre -= 1
        if name in ("td", "th") and tables and len(flows) > 1 and not deep:
            cell = flows.pop()
            cell.line()
            tables[-1][0].rows[-1][-1][0].extend(cell.lines)
        elif name == "table" and deep:
            flow.gap()
            deep -= 1
        elif name == "table" and tables:
            table, below, depth = tables.pop()
            below.gap()
            for one in aligned(table, room):
                below.put(one)
            below.blank = True
        elif name in ("ul", "ol", "menu") and lists:
            flow.line()
            flow.marker = ""
            lists.pop()
            flow.indent = max(0, flow.indent - (2 if name != "ol" else 3))
            if not lists:
                flow.blank = True
        elif name in ("dd", "blockquote"):
            flow.gap() if name == "blockquote" else flow.line()
            flow.indent = max(0, flow.indent - 2)
        elif name in SPACED:
            flow.gap()
        elif name in BLOCK:
            flow.line()
    flows[0].line()
    return "\n".join(flows[0].lines)


def render(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Puts ``text`` in place of the markup (and of a column of that name, if there is one)."""
    others = [c for c in pages.columns if c not in ("text", markup)]
    raw = "__markup"
    while raw in others:
        raw += "_"
    ready = pages.select(*(pages[c] for c in others), F.coalesce(pages[markup], F.lit("")).alias(raw))
    schema = T.StructType([*ready.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            texts = [rendered(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return store.mapped(ready, run, schema)
