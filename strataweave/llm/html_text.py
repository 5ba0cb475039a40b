"""Visible text of HTML pages by layout-aware rendering.

A tree builder adds what the markup leaves out (ends of paragraphs, list items, table rows and
cells, options; rows around bare cells) and a renderer walks the tree. All visible text is
emitted: blocks stand on lines of their own, paragraphs and headings with a blank line around
them, list items behind their bullet or number and indented by depth, table cells in aligned
columns, preformatted text as it is, and other white space as one space. The text of math and
inline svg is inline (without titles, descriptions, metadata, annotations, and what svg shows
by reference only: defs, symbols, masks and the like). What a browser does
not show is left out: head, scripts, styles, templates, media fallbacks, hidden inputs,
elements with ``hidden`` or a style of ``display:none`` (blocks: ``content-visibility:hidden``), the closed part of details, and
text under ``visibility:hidden`` except where it is made visible again. Styles are an element's own and those of
the page's style elements whose selectors are of one element (tag, classes, id, or all); selectors
that look at other elements or states, and rules under a condition but ``@media screen``, are not applied.

Both passes are loops with explicit stacks, so nesting may have any depth. Time and text are linear in the
page: a gap within a table row is PAD columns at most, an indent INDENT, and tables nested deeper
than TABLES are plain blocks; beyond these bounds text is there whole but not aligned.
Columns are counted as a terminal shows them (wide characters take two).

Defined results for odd input: a null or empty page has empty text; markup that ends early is
closed at its end; repeated rows give repeated rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.shared import bounded, lean, with_small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = frozenset("head script style template noscript iframe object embed audio video canvas datalist title meta link base param source track area map noembed noframes".split())
#: Elements of svg and math that are never shown where they stand; the text of others is inline.
NOT_SHOWN_FOREIGN = frozenset("title desc metadata defs symbol clippath mask pattern marker annotation annotation-xml style script".split())
#: Elements of svg and math whose content is HTML again; start tags of HTML that end svg and math elsewhere.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike"
    " sub sup table tt u ul var".split()
)
#: Parts of svg and math that stand apart from the text beside them.
APART = frozenset("text foreignobject mtr mtd".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp tr caption thead tbody tfoot td th".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " main menu nav ol p pre search section summary table ul".split()
)
#: Start tag -> open elements that it ends, and elements beyond which it doesn't look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Start tags that head may hold; any other ends it, as text does.
IN_HEAD = frozenset("base link meta title style script noscript noframes template".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th".split())
WALLS = frozenset("table td th caption html template button marquee object applet".split()) | INTEGRATION
#: End tags that close something outside of a table cell.
ENDS_FROM_CELLS = TABLE_PARTS | {"body", "html"}
BULLET = "- "
#: Bounds of a gap within a table row, of a column's width that is aligned, of an indent, and of nested tables that are aligned.
PAD, WIDEST, INDENT, TABLES = 80, 60, 40, 8
TAG_BEGINS = re.compile("<[a-zA-Z/!?]")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Parts of a style: comments, strings, addresses and escapes are whole, so that a semicolon in them ends nothing.
STYLE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|url\(\s*[^"'\s)](?:[^)\\]|\\.)*\)?|\\.|[^"'/\\u;()\[\]{}]+|.""", re.S)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
BRACE = re.compile(r"[{}]")
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*\Z|@layer\b[^{]*\Z")
#: A selector of one element, and its parts.
SIMPLE = re.compile(r"[#.]?(?:[\w-]|[^\x00-\x7f])+|\*")
COMPOUND = re.compile(r"(?:\*|(?:[\w-]|[^\x00-\x7f])+)?(?:[#.](?:[\w-]|[^\x00-\x7f])+)*")
IMPORTANT = re.compile(r"!\s*important\s*\Z")
#: Values that the properties take; a declaration with another is as if it were not there.
AS_PARENT = frozenset("inherit unset revert revert-layer".split())
VALUES = {
    "visibility": frozenset("visible hidden collapse initial".split()) | AS_PARENT,
    "content-visibility": frozenset("visible auto hidden initial".split()) | AS_PARENT,
    "display": frozenset(
        "none contents block inline inline-block flow flow-root run-in flex inline-flex -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex grid inline-grid grid-lanes inline-grid-lanes"
        " list-item ruby ruby-base ruby-text ruby-base-container ruby-text-container math table inline-table table-row-group table-header-group table-footer-group"
        " table-row table-cell table-column-group table-column table-caption initial".split()
    )
    | AS_PARENT,
}


class Node:
    __slots__ = ("attrs", "children", "foreign", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        #: Whether the element is one of svg or math, not of HTML.
        self.foreign = tag in ("svg", "math") or (parent is not None and parent.foreign and parent.tag not in INTEGRATION)
        self.children: list[Node | str] = []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        #: Depths of the open elements by tag, so that no search walks over what is between.
        self.open: dict[str, list[int]] = {}
        self.depth = 0
        self.sheets: list[str] = []

    def push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.depth += 1
            self.open.setdefault(tag, []).append(self.depth)

    def pop(self) -> None:
        self.open[self.at.tag].pop()
        self.depth -= 1
        self.at = self.at.parent

    def pop_to(self, depth: int) -> None:
        while self.depth >= depth:
            self.pop()

    def innermost(self, tags) -> int:
        """Depth of the innermost open element of ``tags``, or 0."""
        return max((d[-1] for t in tags if (d := self.open.get(t))), default=0)

    def parse_comment(self, i: int, report: bool = True) -> int:
        # A page is fed whole: a comment without an end goes to the end of the page, and nothing looks for one again.
        return super().parse_comment(i, report) if self.rawdata.find("-->", i + 4) >= 0 or self.rawdata.find("--!>", i + 4) >= 0 else len(self.rawdata)

    def end_implied(self, ended: set | frozenset, walls: set | frozenset) -> None:
        """Closes up to the outermost of ``ended`` that is open within the walls."""
        if not any(self.open.get(t) for t in ended):
            return
        wall = self.innermost(walls)
        inside = [d[at] for t in ended if (d := self.open.get(t)) and (at := bisect_right(d, wall)) < len(d)]
        if inside:
            self.pop_to(min(inside))

    def in_foreign(self) -> bool:
        return self.at.foreign and self.at.tag not in INTEGRATION

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS_OUT:
            while self.in_foreign():
                self.pop()
        if self.in_foreign():
            self.push(tag, {k: v or "" for k, v in attrs})
            return
        if tag in ENDS_P:
            self.end_implied({"p"}, WALLS)
        if tag in IMPLIED:
            self.end_implied(*IMPLIED[tag])
        if tag in ("td", "th") and self.at.tag in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", {})
        if self.at.tag == "head" and tag not in IN_HEAD:
            self.pop()
        self.push(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.foreign and self.at.tag == tag:
            self.pop()  # a slash means nothing in HTML, but ends elements of svg and math

    def handle_endtag(self, tag: str) -> None:
        if self.at.tag == "head" and tag in ("br", "p"):
            self.pop()
        if tag == "br":
            self.push("br", {})
        elif tag == "p" and not self.open.get("p"):
            self.push("p", {})
            self.pop()
        elif own := self.open.get(tag):
            if tag not in ENDS_FROM_CELLS and self.innermost(("td", "th", "table")) > own[-1]:
                return  # an end tag in a cell closes nothing outside it
            self.pop_to(own[-1])

    def handle_data(self, data: str) -> None:
        if self.at.tag == "style" and not self.at.foreign:
            self.sheets.append(data)
        if self.at.tag == "head" and SPACE.sub("", data):
            self.pop()
        self.at.children.append(data)


def parse(html: str) -> tuple[Node, Sheet]:
    own = TreeBuilder()
    # A tag that the page's end cuts short is not shown; without it nothing is tried again at each of many.
    cut = TAG_BEGINS.search(html, html.rfind(">") + 1)
    own.feed(html[: cut.start()] if cut else html)
    own.close()
    return own.root, Sheet(own.sheets)


class Lines:
    """Collects text with collapsed spaces into lines; blocks ask for line ends and blank lines."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.prefix = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.expandtabs(8).split("\n")
            self._add(first)
            for x in rest:
                self.end(True)
                self._add(x)
            return
        words = SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space = True
        if words.strip(" "):
            self._add(words.strip(" "))
            self.space = words[-1] == " "

    def _add(self, s: str) -> None:
        if s:
            if self.space and self.line:
                self.line.append(" ")
            self.space = False
            self.line.append(s)

    def end(self, force: bool = False) -> None:
        """Ends the line; an empty one counts only by ``force``."""
        if self.line or force:
            if self.blank and self.out:
                self.out.append("")
            self.blank = False
            own = "".join(self.line)
            self.out.append((self.prefix + own).rstrip() if own else "")
            if self.prefix.strip():
                self.prefix = " " * len(self.prefix)
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def whole(self, lines: list[str]) -> None:
        for x in lines:
            self.line = [x] if x else []
            self.end(True)

    def result(self) -> list[str]:
        self.end()
        while self.out and not self.out[-1]:
            self.out.pop()
        first = next((k for k, x in enumerate(self.out) if x), 0)
        if first:
            del self.out[:first]
        return self.out


def declarations(style: str) -> Iterator[str]:
    own, depth = [], 0
    for x in STYLE.findall(style):
        if x == ";" and not depth:
            yield "".join(own)
            own = []
            continue
        depth = max(0, depth + (x in "([{") - (x in ")]}"))
        own.append(" " if x.startswith("/*") else x)
    yield "".join(own)


def properties(style: str) -> tuple[dict[str, str], dict[str, str]]:
    """The properties of VALUES that declarations give, the last valid ones; plain ones and important ones."""
    out, important = {}, {}
    if "display" not in style and "visibility" not in style:
        return out, important
    for own in declarations(style):
        name, _, value = own.partition(":")
        plain = IMPORTANT.sub("", value.strip())
        name, words = name.strip(), plain.split()
        if name in VALUES and words and VALUES[name].issuperset(words) and (len(words) == 1 or name == "display"):
            (out if plain == value.strip() else important)[name] = " ".join(words)
    return out, important


class Sheet:
    """The rules of style elements, by the rarest of the ids, classes and tags that their selector names."""

    def __init__(self, texts: list[str]):
        #: (ids, classes, tag) of a selector -> for each property and force the weight of the last rule and its value.
        self.rules: dict[tuple[frozenset, frozenset, str | None], dict[tuple[str, bool], tuple]] = {}
        self.n = 0
        for text in texts:
            self._read(CSS_COMMENT.sub(" ", text))
        #: Part -> the selectors under it; those without an id depend on tag and classes alone.
        self.plain: dict[str, list[tuple]] = {}
        self.by_id: dict[str, list[tuple]] = {}
        often: dict[str, int] = {}
        for selector in self.rules:
            for part in self._parts(*selector):
                often[part] = often.get(part, 0) + 1
        for selector in self.rules:
            part = min(self._parts(*selector), key=lambda x: (often[x], x), default="*")
            (self.by_id if selector[0] else self.plain).setdefault(part, []).append(selector)
        self.ids = {i for selector in self.rules for i in selector[0]}
        self.known: dict[tuple, dict[tuple, tuple]] = {}

    @staticmethod
    def _parts(ids, classes, tag: str | None) -> list[str]:
        return [*("#" + i for i in ids), *("." + c for c in classes), *([tag] if tag else [])]

    def _read(self, text: str) -> None:
        """One scan over the braces: conditions that hold open a group of rules, other at-rules are passed over."""
        at = begin = depth = groups = 0
        head = ""
        for m in BRACE.finditer(text):
            if depth:
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    self._rule(head, text[begin : m.start()])
                    at = m.end()
            elif m[0] == "{":
                head = text[at : m.start()].rpartition(";")[2].strip().lower()
                at = begin = m.end()
                if SCREEN.match(head):
                    groups += 1
                else:
                    depth = 1
            elif groups:
                groups -= 1
                at = m.end()
        if depth:
            self._rule(head, text[begin:])

    def _rule(self, head: str, body: str) -> None:
        plain, important = ({}, {}) if head.startswith("@") else properties(body.lower())
        if not plain and not important:
            return
        for selector in head.split(","):
            selector = selector.strip()
            if not COMPOUND.fullmatch(selector):
                continue
            parts = SIMPLE.findall(selector)
            ids, classes = [x[1:] for x in parts if x[0] == "#"], [x[1:] for x in parts if x[0] == "."]
            tag = next((x for x in parts if x[0] not in "#.*"), None)
            self.n += 1
            weight = len(ids), len(classes), bool(tag), self.n
            values = self.rules.setdefault((frozenset(ids), frozenset(classes), tag), {})
            for force, given in ((False, plain), (True, important)):
                for name, value in given.items():
                    values[name, force] = max(values.get((name, force), (weight, value)), (weight, value))

    def _met(self, by: dict[str, list[tuple]], parts: list[str], tag: str, classes: set[str], own_id: str) -> dict[tuple, tuple]:
        best: dict[tuple, tuple] = {}
        for part in parts:
            for selector in by.get(part, ()):
                ids, wanted, only = selector
                if only in (None, tag) and wanted <= classes and ids <= {own_id}:
                    for name, found in self.rules[selector].items():
                        best[name] = max(best.get(name, found), found)
        return best

    def of(self, node: Node) -> tuple[dict[str, str], dict[str, str]]:
        """What the rules give an element: plain properties and important ones."""
        if not self.rules:
            return {}, {}
        tag, named, own_id = node.tag, node.attrs.get("class", "").lower(), node.attrs.get("id", "").lower()
        classes = set(named.split())
        parts = ["*", tag, *("." + c for c in classes)]
        if (tag, named) not in self.known:
            self.known[tag, named] = self._met(self.plain, parts, tag, classes, "")
        best = self.known[tag, named]
        if own_id in self.ids:
            best = dict(best)
            for name, found in self._met(self.by_id, [*parts, "#" + own_id], tag, classes, own_id).items():
                best[name] = max(best.get(name, found), found)
        return tuple({name: value for (name, force), (_, value) in best.items() if force == strong} for strong in (False, True))


def style_of(node: Node, sheet: Sheet) -> dict[str, str]:
    """The properties of VALUES: attributes of svg and math, rules, the element's own style; important ones last, in the same order."""
    marks = {k: node.attrs[k].lower() for k in ("display", "visibility") if node.foreign and k in node.attrs}
    plain, important = sheet.of(node)
    own, own_important = properties(node.attrs.get("style", "").lower())
    first = properties("".join(f"{k}:{v};" for k, v in marks.items()))[0]
    return first | plain | own | important | own_important


def shown(node: Node, style: dict[str, str]) -> bool:
    if node.tag in (NOT_SHOWN_FOREIGN if node.foreign else NOT_SHOWN) or "hidden" in node.attrs or style.get("display") == "none":
        return False
    if style.get("content-visibility") == "hidden" and node.tag in BLOCK - TABLE_PARTS:
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    up = node.parent
    return not (up is not None and up.tag == "details" and "open" not in up.attrs and node.tag != "summary")


def number(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"\s*-?[0-9]{1,6}\s*", s) else default


class Table:
    """Rows of cells (lines, columns, rows spanned; 0 for all of the row group's), and the rows at which a row group begins."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.groups: set[int] = set()


class Columns:
    """Which columns cells from above occupy, as the free runs between, in order; each change touches few runs."""

    def __init__(self):
        self.free: list[tuple[int, float]] = [(0, math.inf)]
        #: (row at which it ends, number, run) of what was taken; runs that lay on occupied ones and wait for them.
        self.ends: list[tuple[float, int, tuple[int, int]]] = []
        self.waiting: list[tuple[int, int, float]] = []
        self.n = 0

    def first(self, at: int) -> int:
        """The first free column from ``at`` on."""
        k = bisect_right(self.free, (at, math.inf)) - 1
        if k < 0 or self.free[k][1] <= at:
            k += 1
        return max(at, self.free[k][0])

    def take(self, begin: int, end: int, until: float) -> None:
        """Occupies what is free between; the rest waits until it is given back, if that is before ``until``."""
        k = max(bisect_right(self.free, (begin, math.inf)) - 1, 0)
        at, new, last = begin, [], k
        while last < len(self.free) and self.free[last][0] < end:
            a, b = self.free[last]
            last += 1
            low, high = max(a, begin), min(b, end)
            if low >= high:
                new.append((a, b))
                continue
            if at < low:
                self.waiting.append((at, low, until))
            if a < low:
                new.append((a, low))
            if high < b:
                new.append((high, b))
            self.n += 1
            heappush(self.ends, (until, self.n, (low, high)))
            at = high
        if at < end:
            self.waiting.append((at, end, until))
        self.free[k:last] = new

    def give(self, row: int) -> None:
        """Frees what ends before ``row``."""
        while self.ends and self.ends[0][0] <= row:
            begin, end = heappop(self.ends)[2]
            at = bisect_left(self.free, (begin, 0))
            if at < len(self.free) and self.free[at][0] == end:
                end = self.free.pop(at)[1]
            if at and self.free[at - 1][1] == begin:
                at -= 1
                begin = self.free.pop(at)[0]
            self.free.insert(at, (begin, end))
            if self.waiting:
                self.waiting = [w for w in self.waiting if w[2] > row]
                mine = [w for w in self.waiting if w[0] < end and w[1] > begin]
                for w in mine:
                    self.waiting.remove(w)
                for w in sorted(mine, key=lambda w: -w[2]):
                    self.take(*w)


def placed(table: Table) -> Iterator[list[tuple[int, list[str], int]]]:
    """Each row's cells as (first column, lines, columns): a cell stands right of those that reach down from above."""
    above = Columns()
    for r, row in enumerate(table.rows):
        if r in table.groups:
            above = Columns()
        above.give(r)
        out, at = [], 0
        for lines, span, down in row:
            at = above.first(at)
            out.append((at, lines, span))
            if down != 1 and span:
                above.take(at, at + span, r + down if down else math.inf)
            at += span
        yield out


def shown_width(line: str) -> int:
    """Columns that a line takes: two for a wide character, none for a combining one."""
    if line.isascii():
        return len(line)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in line)


def grid(table: Table) -> list[str]:
    """Lines of a table: cells of a column begin at the same place, two spaces apart; a cell may span columns and lines.

    Only columns at which some cell begins or ends count. Beyond a bounded width of a column or of a gap cells stand
    two spaces apart, so the padding is in proportion to the cells.
    """
    rows = list(placed(table))
    edges = sorted({x for row in rows for at, _, span in row for x in (at, at + span)})
    where = {x: k for k, x in enumerate(edges)}
    widths = [0] * (len(edges) + 1)
    for row in rows:
        for at, lines, span in row:
            k = where[at]
            if where[at + span] == k + 1:
                widths[k] = max(widths[k], min(WIDEST, max(map(shown_width, lines), default=0)))
    begins = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for row in rows:
        left, k = [(begins[where[at]], lines) for at, lines, _ in row], 0
        while left := [x for x in left if len(x[1]) > k]:
            parts, width = [], 0
            for begin, lines in left:
                if lines[k]:
                    gap = min(PAD, max(begin - width, 2 if width else 0))
                    parts += [" " * gap, lines[k]]
                    width += gap + shown_width(lines[k])
            out.append("".join(parts).rstrip())
            k += 1
    return out


class State:
    """What an open element hands down to its content."""

    __slots__ = ("depth", "kind", "lines", "pre", "visible")

    def __init__(self, lines: Lines, pre: bool, visible: bool, depth: int, kind: str):
        self.lines, self.pre, self.visible = lines, pre, visible
        #: Lists around, and the tag of the innermost.
        self.depth, self.kind = depth, kind


def render(root: Node, sheet: Sheet) -> str:
    top = Lines()
    tables: list[Table] = []
    counters: list[list[int]] = []
    stack: list[tuple] = [("node", root, State(top, False, True, 0, ""))]
    while stack:
        kind, node, state = stack.pop()
        if kind == "close":
            _close(node, state, tables, counters)
            continue
        if isinstance(node, str):
            if state.visible:
                state.lines.text(node, state.pre)
            continue
        style = style_of(node, sheet)
        if not shown(node, style):
            continue
        inner = State(state.lines, state.pre or node.tag in ("pre", "textarea", "listing", "xmp", "plaintext"), state.visible, state.depth, state.kind)
        if style.get("visibility", "inherit") not in AS_PARENT:
            inner.visible = style["visibility"] in ("visible", "initial")
        _open(node, state, inner, tables, counters)
        if node.tag in ("br", "hr", "input", "img", "wbr", "col") and not node.foreign:
            continue
        stack.append(("close", node, (state, inner)))
        shut = node.tag == "details" and "open" not in node.attrs
        stack.extend(("node", child, inner) for child in reversed(node.children) if not shut or not isinstance(child, str))
    return "\n".join(top.result())


def indent(depth: int) -> str:
    return " " * min(2 * max(depth, 0), INDENT)


def _open(node: Node, state: State, inner: State, tables: list, counters: list) -> None:
    tag, lines = node.tag, state.lines
    if tag in ("thead", "tbody", "tfoot") and tables and tables[-1] is not None:
        tables[-1].groups.add(len(tables[-1].rows))
    if node.foreign:
        lines.space |= tag in APART
    elif tag == "br":
        lines.end(True)
    elif tag == "hr":
        lines.gap()
    elif tag == "input":
        if node.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number") and inner.visible:
            lines.text(node.attrs.get("value", ""), False)
    elif tag == "table":
        lines.gap()
        tables.append(Table() if len(tables) < TABLES else None)
        if tables[-1] is not None:
            inner.lines, inner.depth, inner.kind = Lines(), 0, ""
    elif tables and tables[-1] is None and tag in ("tr", "td", "th"):
        lines.end()
    elif tag == "tr" and tables:
        tables[-1].rows.append([])
    elif tag in ("td", "th") and tables:
        inner.lines = Lines()
    elif tag in ("ul", "ol", "menu", "dir"):
        (lines.end if state.depth else lines.gap)()
        counters.append([number(node.attrs.get("start"), 1)])
        inner.depth, inner.kind = state.depth + 1, tag
    elif tag == "li":
        lines.end()
        mark = BULLET
        if state.kind == "ol" and counters:
            counters[-1][0] = number(node.attrs.get("value"), counters[-1][0])
            mark = f"{counters[-1][0]}. "
            counters[-1][0] += 1
        lines.prefix = indent(state.depth - 1) + mark
    elif tag == "dd":
        lines.end()
        lines.prefix = "  "
    elif tag == "q":
        lines.text("“", False)
    elif tag in BLOCK:
        (lines.gap if tag in SPACED else lines.end)()


def _close(node: Node, states: tuple, tables: list, counters: list) -> None:
    tag, (state, inner) = node.tag, states
    lines = state.lines
    if tag in ("thead", "tbody", "tfoot") and tables and tables[-1] is not None:
        tables[-1].groups.add(len(tables[-1].rows))
    if node.foreign:
        lines.space |= tag in APART
    elif tag == "table":
        if (table := tables.pop()) is not None:
            own = inner.lines.result()  # captions and stray text stand above
            lines.whole(own + grid(table))
        lines.gap()
    elif tables and tables[-1] is None and tag in ("tr", "td", "th"):
        lines.end()
    elif tag in ("td", "th") and tables:
        cell = inner.lines.result()
        if tables[-1].rows:
            span, down = number(node.attrs.get("colspan"), 1), number(node.attrs.get("rowspan"), 1)
            tables[-1].rows[-1].append((cell, min(max(1, span), 1000), min(down, 65534) if down >= 0 else 1))
        else:
            lines.whole(cell)
    elif tag in ("ul", "ol", "menu", "dir"):
        (lines.end if state.depth else lines.gap)()
        counters.pop()
        lines.prefix = indent(state.depth)
    elif tag in ("li", "dd"):
        lines.end()
        lines.prefix = ""
    elif tag == "q":
        lines.text("”", False)
    elif tag in BLOCK:
        (lines.gap if tag in SPACED else lines.end)()


def text_of(html: str | None) -> str:
    return render(*parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines and text_sha256 of each page."""
    names = ["page_id", "text", "n_chars", "n_lines", "text_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = [text_of(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([t.count("\n") + bool(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ],
                names=names,
            )

    with_small_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"page_id {kind}, text string, n_chars long, n_lines long, text_sha256 string")
