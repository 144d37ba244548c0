"""Layout-aware text of HTML pages.

A tree builder with implied tags (an ``li`` ends an open ``li``, a block ends an open ``p``, cells get their row) feeds a
renderer that emits all visible text: scripts, heads, hidden elements and closed details are left out; blocks start lines,
paragraphs, headings, lists and tables stand apart by a blank line, list items carry their marks and indents, and the
cells of a table are aligned in columns.  Of SVG the text elements and embedded HTML are shown, of MathML all but
annotations and phantoms; of inputs the values of all types that show theirs, of list boxes all options.  What ``visibility``
hides is left out, but elements inside may show themselves again; ``display: none`` hides all inside.

Nothing recurses over the depth of the page, and broken tags, unclosed quotes and deep nesting take time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
NAME = re.compile(r"</?[a-zA-Z]")
#: Tags without a ``<`` inside, nearly all; others are read step by step.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><\"']*+)(?=[\s/>])((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)
PRE_STYLE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|pre-wrap|break-spaces)\b", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas noembed noframes datalist title meta link rp".split())
#: Elements of SVG and MathML that are not rendered where they stand.
FOREIGN_UNSEEN = frozenset("script style title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter "
                           "annotation annotation-xml mphantom".split())
#: HTML inside SVG and MathML stands in these; elsewhere the tags of BREAKOUT end the foreign element.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
                     "ruby s small span strong strike sub sup table tt u ul var".split())
#: The parts of these formulas stand above, below or beside each other; in the text a space sets them apart.
PARTS = frozenset("mfrac msup msub msubsup munder mover munderover mroot mmultiscripts mtr mtable mlabeledtr".split())
#: Inputs without a text of their own; all other types, unknown ones too, show their value.
VALUELESS = frozenset("hidden checkbox radio password file image color range".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu fieldset form details".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address li dt dd figcaption caption summary legend "
                          "tr td th thead tbody tfoot center dialog search hgroup option optgroup".split())
ENDS_P = (BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup".split()))
#: A start tag ends the open elements of the second entry, up to one of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption", "colgroup"), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
}
#: An end tag does not reach beyond these.
SCOPE = frozenset("html td th caption table template".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
#: Tables inside tables beyond this depth are laid out as blocks.
TABLE_DEPTH = 20


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: bool = False):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for m in ATTRIBUTE.finditer(raw):
            out.setdefault(m[1].lower(), unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


class _Next:
    """Where a pattern comes next; a repeated question about the same stretch is not searched again."""

    def __init__(self, pattern: str, text: str):
        self.search, self.text, self.low, self.found = re.compile(pattern).search, text, 0, -1

    def __call__(self, at: int) -> int:
        if not self.low <= at <= self.found:
            m = self.search(self.text, at)
            self.low, self.found = at, m.start() if m else len(self.text)
        return self.found


class _Tags:
    """Tags of a page.  A tag that never ends is text; the places it was read through are not read again."""

    def __init__(self, html: str):
        self.html = html
        self.name_end, self.special = _Next(r"[\s/>]", html), _Next("[>\"']", html)
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def read(self, at: int) -> tuple[bool, str, str, int] | None:
        """(end tag, name, raw attributes, place after it) of the tag at a ``<``."""
        m = PLAIN_TAG.match(self.html, at)
        if m:
            return bool(m[1]), m[2].lower(), m[3], m.end()
        if not NAME.match(self.html, at):
            return None
        end = self.html[at + 1] == "/"
        start = at + 1 + end
        attributes = now = self.name_end(start)
        trail = []
        while True:
            now = self.special(now)
            if now == len(self.html) or now in self.dead:
                break
            if self.html[now] == ">":
                return end, self.html[start:attributes].lower(), self.html[attributes:now], now + 1
            trail.append(now)
            if self.last[self.html[now]] == now:
                break
            now = self.html.index(self.html[now], now + 1) + 1
        self.dead.update(trail)
        return None


class _Builder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.roots: list[tuple[int, Node]] = []
        #: Places of the open elements of each tag, and of those that HTML inside SVG and MathML stands in.
        self.places: dict[str, list[int]] = {}

    def _add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.foreign and node.tag in INTEGRATION:
            self.places.setdefault("#integration", []).append(len(self.open))
        self.open.append(node)

    def _end_from(self, place: int) -> None:
        while len(self.open) > place:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.foreign and node.tag in INTEGRATION:
                self.places["#integration"].pop()

    def _innermost(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0 if there is none."""
        most = 0
        for tag in tags:
            held = self.places.get(tag)
            if held and held[-1] > most:
                most = held[-1]
        return most

    def foreign(self) -> bool:
        """Whether the next element is one of SVG or MathML."""
        while self.roots and (self.roots[-1][0] >= len(self.open) or self.open[self.roots[-1][0]] is not self.roots[-1][1]):
            self.roots.pop()
        return bool(self.roots) and self._innermost(("#integration",)) < self.roots[-1][0]

    def _close(self, tags, until=(), scope=SCOPE) -> None:
        """Ends the innermost open element of ``tags`` and what is inside it, unless one of ``until`` or ``scope`` comes first."""
        if self.open[-1].tag in tags and len(self.open) > 1:
            self._end_from(len(self.open) - 1)
            return
        place = self._innermost(tags)
        if place and place >= self._innermost(until) and place >= self._innermost(scope):
            self._end_from(place)

    def text(self, value: str) -> None:
        if self.open[-1].tag == "head" and value.strip(" \t\n\r\f"):
            self._end_from(len(self.open) - 1)
        self.open[-1].children.append(value)

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        foreign = self.foreign()
        if foreign and tag in BREAKOUT:
            while self.foreign():
                self._end_from(self.roots[-1][0])
            foreign = False
        if foreign:
            self._enter(tag, attributes, True, closed)
            return
        if tag in ("html", "body"):
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._end_from(len(self.open) - 1)
        if tag in ENDS_P:
            self._close(("p",), ("button", "object"))
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            self._close(ends, until, ("table",))
            # Table rows and bodies end the cells in them.
            if tag == "tr":
                self._close(("tr",), (), ("table",))
            elif tag in ("tbody", "thead", "tfoot"):
                table = self._innermost(("table",))
                parts = [x[bisect_right(x, table)] for x in map(self.places.get, ("tr", "tbody", "thead", "tfoot")) if x and x[-1] > table]
                if parts:
                    self._end_from(min(parts))
            elif tag in ("td", "th"):
                table = self._innermost(("table",))
                if table and table > self._innermost(("tr",)):
                    self._push(Node("tr", {}))
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.open[-1].tag):
            self._end_from(len(self.open) - 1)
        self._enter(tag, attributes, tag in ("svg", "math"), closed)

    def _enter(self, tag: str, attributes: dict[str, str], foreign: bool, closed: bool) -> None:
        node = Node(tag, attributes, foreign)
        self.open[-1].children.append(node)
        if not closed and (foreign or tag not in VOID):
            if foreign and tag in ("svg", "math"):
                self.roots.append((len(self.open), node))
            self._add(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self._add(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Node("p", {}))
            return
        tags = ("h1", "h2", "h3", "h4", "h5", "h6") if re.fullmatch("h[1-6]", tag) else (tag,)
        self._close(tags, ("ul", "ol") if tag == "li" else (), ("html", "table", "template") if tag in TABLE_PARTS or tag == "table" else SCOPE)


def parse(html: str) -> Node:
    """The element tree of a page; any text gives one."""
    builder, tags, at = _Builder(), _Tags(html), 0
    while at < len(html):
        begin = html.find("<", at)
        comment = found = None
        while begin >= 0:
            comment = COMMENT.match(html, begin) if html.startswith(("<!", "<?"), begin) else None
            found = None if comment else tags.read(begin)
            if comment or found:
                break
            begin = html.find("<", begin + 1)
        if begin < 0:
            builder.text(unescape(html[at:]))
            break
        if begin > at:
            builder.text(unescape(html[at:begin]))
        if comment:
            at = comment.end()
            if html.startswith("<![CDATA[", begin) and builder.foreign():
                stop = html.find("]]>", begin)
                builder.text(html[begin + 9 : stop if stop >= 0 else len(html)])
                at = stop + 3 if stop >= 0 else len(html)
            continue
        ends, tag, raw_attributes, at = found
        if ends:
            builder.end(tag)
            continue
        closed = raw_attributes.endswith("/") and (tag in ("svg", "math", "path") or builder.foreign())
        builder.start(tag, _attributes(raw_attributes), closed)
        if tag in RAW and not closed:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            raw = html[at : stop.start() if stop else len(html)]
            builder.text(unescape(raw) if tag in ("textarea", "title") else raw)
            at = stop.start() if stop else len(html)
    return builder.root


def hidden(node: Node) -> bool:
    """Whether the element and all inside it is left out."""
    a = node.attributes
    if node.foreign:
        if node.tag in FOREIGN_UNSEEN or a.get("display") == "none" or "hidden" in a:
            return True
    elif node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return True
    if "style" not in a:
        return False
    return HIDING.search(a["style"]) is not None or (node.tag in TABLE_PARTS and node.tag not in ("td", "th") and _visibility(node) == "collapse")


def _visibility(node: Node) -> str | None:
    """The element's own visibility; the last declaration counts."""
    found = VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else []
    return found[-1].lower() if found else node.attributes.get("visibility") if node.foreign else None


def seen_in(node: Node, sight: bool) -> bool:
    """Whether text right inside the element is visible, where ``sight`` says so of its parent."""
    own = _visibility(node) if node.foreign or "style" in node.attributes else None
    return sight if own not in ("hidden", "collapse", "visible", "initial") else own in ("visible", "initial")


class _Box:
    """Lines of one flow of text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark: str | None = None

    def _begin(self) -> None:
        if self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def line(self) -> None:
        if self.now:
            self._begin()
            text = "".join(self.now)
            head = "".join(self.indent)
            if self.mark is not None:
                head = "".join(self.indent[:-1]) + self.mark
                self.mark = None
            self.lines.append((head + text).rstrip(" "))
            self.now = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.line()
        if self.mark is None:
            self.gap = max(self.gap, 2 if apart else 1)

    def text(self, value: str) -> None:
        if not value:
            return
        if value[0] in " \t\n\r\f":
            self.space = True
        for word in SPACE.split(value):
            if word:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(word)
                self.space = True
        self.space = value[-1] in " \t\n\r\f"

    def raw(self, value: str) -> None:
        parts = value.replace("\r\n", "\n").expandtabs(8).split("\n")
        for i, part in enumerate(parts):
            if i:
                if self.now:
                    self.line()
                elif self.lines and not self.gap:
                    self.lines.append("")
            if part:
                self.now.append(part)

    def whole(self, lines: list[str]) -> None:
        """Finished lines, such as a table's."""
        for x in lines:
            self.now = [x] if x else []
            if x:
                self.line()
            elif self.lines:
                self._begin()
                self.lines.append("")

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def columns(text: str) -> int:
    """Terminal columns of a line; wide East Asian characters take two."""
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


def _table(node: Node, depth: int, sight: bool) -> tuple[list[object], list[str], int]:
    """(what stands before the table, its lines, number of cells)."""
    before: list[object] = []
    rows: list[tuple[Node, bool]] = []
    todo = [(x, sight) for x in reversed(node.children)]
    while todo:
        x, sight = todo.pop()
        if isinstance(x, str):
            if x.strip():
                before.append(x)
        elif hidden(x) or x.tag in ("colgroup", "col"):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo.extend((y, seen_in(x, sight)) for y in reversed(x.children))
        elif x.tag == "tr":
            rows.append((x, seen_in(x, sight)))
        else:
            before.append(x)  # captions, and what a browser moves out of the table
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}
    cells = 0
    for row, sight in rows:
        line: dict[int, tuple[list[str], int]] = {}
        at, fresh = 0, {}
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if isinstance(cell, str) and not cell.strip():
                    continue
                before.append(cell)
                continue
            if hidden(cell):
                continue
            while taken.get(at, 0) > 0:
                at += 1
            across = min(max(_number(cell.attributes.get("colspan"), 1), 1), 1000)
            down = min(max(_number(cell.attributes.get("rowspan"), 1), 1), 65534)
            line[at] = (_flow(cell.children, depth + 1, seen_in(cell, sight))[0], across)
            cells += 1
            if down > 1:
                for k in range(at, at + across):
                    fresh[k] = down
            at += across
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | {k: n - 1 for k, n in fresh.items()}
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for at, (text, across) in line.items():
            if across == 1:
                widths[at] = max([widths.get(at, 0), *map(columns, text)])
    for line in grid:
        for at, (text, across) in line.items():
            if across > 1:
                own = [k for k in range(at, at + across) if k in widths] or [at]
                need = max([0, *map(columns, text)]) - sum(widths.get(k, 0) for k in own) - 2 * (len(own) - 1)
                if need > 0:
                    widths[own[-1]] = widths.get(own[-1], 0) + need
    used = sorted(k for k, w in widths.items() if w)
    left, x = {}, 0
    for k in used:
        left[k] = x
        x += widths[k] + 2
    out: list[str] = []
    for line in grid:
        high = max([0, *(len(text) for text, _ in line.values())])
        for i in range(high):
            made = ""
            width = 0
            for at, (text, across) in sorted(line.items()):
                if i < len(text) and text[i]:
                    where = left.get(at, next((left[k] for k in used if k >= at), width))
                    made += " " * (where - width) + text[i]
                    width = max(width, where) + columns(text[i])
            out.append(made.rstrip(" "))
    return before, out, cells


def _flow(children: list[object], depth: int = 0, sight: bool = True) -> tuple[list[str], dict[str, int]]:
    """Lines of a list of nodes, and how many blocks, list items, tables and cells they show."""
    box = _Box()
    seen = {"blocks": 0, "items": 0, "tables": 0, "cells": 0}
    pre = 0
    lists: list[tuple[str, int, int]] = []
    todo: list[tuple] = [("enter", x) for x in reversed(children)]
    while todo:
        what, node = todo.pop()
        if what == "leave":
            tag, extra = node
            if extra == "pre":
                pre -= 1
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                box.line()
                box.indent.pop()
                if tag == "li":
                    box.mark = None
            if tag in BLOCK:
                box.block(tag in APART and not (tag in ("ul", "ol", "menu") and lists))
            continue
        if what == "sight":
            sight = node
            continue
        if what == "table":
            box.block(True)
            box.whole(node)
            box.block(True)
            continue
        if isinstance(node, str):
            if sight:
                (box.raw if pre else box.text)(node)
            continue
        if hidden(node):
            continue
        own = seen_in(node, sight)
        if own != sight:
            todo.append(("sight", sight))
            sight = own
        tag, a = node.tag, node.attributes
        if node.foreign:
            # Labels of a picture and parts of a formula are set apart by a space.
            if tag == "svg":
                todo.extend((("enter", " "), ("sight", sight)))
                for label, around in reversed(_labels(node, sight)):
                    todo.extend((("enter", label), ("enter", " "), ("sight", around)))
                continue
            inner = node.children
            if tag in PARTS:
                inner = [x for y in inner for x in ((y,) if isinstance(y, str) else (y, " "))]
            todo.extend(("enter", x) for x in reversed(inner))
            continue
        if tag == "br":
            if box.now:
                box.line()
            elif box.lines:
                box.gap = max(box.gap, 2)
            continue
        if tag == "wbr":
            continue
        if tag == "input":
            if a.get("type", "text").strip().lower() not in VALUELESS and a.get("value") and sight:
                box.text(a["value"])
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "hr":
            box.block(True)
            continue
        if tag == "table" and depth < TABLE_DEPTH:
            before, lines, cells = _table(node, depth, sight)
            seen["tables"] += 1
            seen["cells"] += cells
            todo.append(("table", lines))
            todo.extend(("enter", x) for x in reversed(before))
            box.block(True)
            continue
        children = node.children
        if tag == "select":
            options = [x for x in _inside(node) if x.tag == "option" and not hidden(x)]
            chosen = [x for x in options if "selected" in x.attributes] or options[:1]
            children = options if "multiple" in a or _number(a.get("size"), 1) > 1 else chosen
        if tag == "details" and "open" not in a:
            children = [x for x in node.children if not isinstance(x, str) and x.tag == "summary"][:1]
        extra = None
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and bool(lists)
            box.block(tag in APART and not nested)
            seen["blocks"] += 1
        if tag in ("ul", "ol", "menu"):
            lists.append(("ol" if tag == "ol" else "ul", _number(a.get("start"), 1), len(lists)))
        if tag == "li":
            seen["items"] += 1
            kind, number, level = lists[-1] if lists else ("ul", 1, 0)
            number = _number(a.get("value"), number)
            mark = f"{number}. " if kind == "ol" else "- "
            if lists:
                lists[-1] = (kind, number + 1, level)
            box.mark = mark if sight else None
            box.indent.append(" " * len(mark))
        elif tag == "dd":
            box.indent.append("    ")
        elif tag == "blockquote":
            box.indent.append("  ")
        if tag in ("pre", "textarea", "xmp", "listing") or ("style" in a and PRE_STYLE.search(a["style"])):
            pre += 1
            extra = "pre"
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
        if tag in ("td", "th"):
            box.text(" ")
        todo.append(("leave", (tag, extra)))
        todo.extend(("enter", x) for x in reversed(children))
    return box.done(), seen


def _labels(svg: Node, sight: bool) -> list[tuple[Node, bool]]:
    """The text elements and embedded HTML of a picture, in order, and whether what they stand in is visible."""
    out, todo = [], [(x, sight) for x in reversed(svg.children)]
    while todo:
        x, sight = todo.pop()
        if isinstance(x, str) or hidden(x):
            continue
        if x.tag in ("text", "foreignobject"):
            out.append((x, sight))
        else:
            todo.extend((y, seen_in(x, sight)) for y in reversed(x.children))
    return out


def _inside(node: Node) -> list[Node]:
    """Elements below a node, in order."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if not isinstance(x, str):
            out.append(x)
            todo.extend(reversed(x.children))
    return out


def render(html: str | None) -> tuple[str, dict[str, int]]:
    """Visible text of a page and counts of what it shows; null is an empty page."""
    lines, seen = _flow([parse(html or "")])
    return "\n".join(lines), seen


ADDED = {"text": T.StringType(), "n_chars": T.LongType(), "n_lines": T.LongType(), "n_blocks": T.LongType(),
         "n_list_items": T.LongType(), "n_tables": T.LongType(), "n_cells": T.LongType()}


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the html) with the visible text and its counts.

    A null or empty page gives an empty text and zeros; broken markup gives the text that the tree builder recovers;
    columns that clash with an added one are replaced; repeated rows each give a row.
    """
    names = [c for c in (pages.columns if keep is None else keep) if c not in ADDED and c != html]
    rows = pages.select(*names, F.col(html).alias("__html"))
    schema = T.StructType([*rows.select(*names).schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [render(x) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[: len(names)], pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t, _ in done], pa.int64()),
                    *(pa.array([s[k] for _, s in done], pa.int64()) for k in ("blocks", "items", "tables", "cells"))], names=[*names, *ADDED])

    return rows.mapInArrow(run, schema)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, visible text and counts of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
