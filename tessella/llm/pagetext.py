"""HTML extraction: layout-aware rendering of all visible text.

A tokenizer feeds a tree builder that implies missing end and start tags; visibility rules drop what a reader
wouldn't see; the renderer keeps block spacing, list markers with their nesting, preformatted text, and sets
table cells, with their column and row spans, into aligned columns. Each step takes time in proportion to the page,
and no step recurses, so nesting has no limit.

Visibility: elements that are never shown, the ``hidden`` attribute, closed ``details`` (but for their summary) and
closed dialogs, and ``display`` and ``visibility`` from ``style`` attributes and from those rules of ``style``
elements whose selectors are a tag, classes and an id. ``visibility`` is inherited, so a visible child of a hidden
element is shown. Of a ``select`` the chosen options are shown, of text fields and buttons their value.

Defined cases: null or empty html gives an empty text. Markup that never closes ends with the document. A quoted value
that never closes, or holds ``>`` and is followed by a letter, ends at the first ``>``. Lists and quotes nested over
``INDENTS`` deep are indented no further. Cells after one of a width over ``ALIGNED`` follow it by two spaces. Repeated rows are
rendered each.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import named, portions, strings

INDENTS, ALIGNED = 40, 100
#: What the standard takes spans beyond for.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(?P<quote>[\"'])|([^\s>\"'][^\s>]*+))?)?)?")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never rendered, with all they hold.
HIDDEN = frozenset("head title script style template noscript iframe object embed svg canvas audio video noembed noframes datalist rp annotation meter progress".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table ul caption tr td th thead tbody tfoot textarea xmp".split())
#: Set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr form fieldset xmp".split())
#: A start tag ends these open elements, searched up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "textarea"}
SCOPE = frozenset("td th table caption html button object template".split())
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
#: Inputs whose value is shown.
SHOWN_INPUTS = frozenset("text search email url tel number date time month week datetime-local button submit reset".split())

Attributes = dict[str, str]
NONE: Attributes = {}
#: What only end tags of their own table end.
STRUCTURE = frozenset("tr td th thead tbody tfoot caption".split())


class Node:
    __slots__ = ("attrs", "children", "holds_parts", "tag")

    def __init__(self, tag: str, attrs: Attributes | None = None):
        self.tag, self.attrs, self.children = tag, attrs or NONE, []
        #: Whether rows, cells or a caption of the table around stand below.
        self.holds_parts = False


class Scanner:
    """Start tags of a source, read from left to right."""

    def __init__(self, source: str):
        self.source, self.closes = source, {'"': True, "'": True}

    def attributes(self, at: int) -> tuple[Attributes, int]:
        """The attributes from a place on, and the place after the tag's end."""
        source, found = self.source, {}
        while True:
            m = ATTRIBUTE.match(source, at)
            at, name = m.end(), m[1]
            if name is None:
                return found, at + 1  # at '>' or the document's end
            value = m[3] or ""
            if m["quote"]:
                value, at = self.quoted(m["quote"], at)
            found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)

    def quoted(self, quote: str, at: int) -> tuple[str, int]:
        """A value in quotes, and the place after it."""
        source = self.source
        end = source.find(quote, at) if self.closes[quote] else -1
        self.closes[quote] = end >= 0
        if end < 0 or source.find(">", at, end) >= 0 and source[end + 1 : end + 2].strip("/> \t\n\r\f"):
            end = source.find(">", at)
            end = len(source) if end < 0 else end
            return source[at:end], end
        return source[at:end], end + 1


class Open:
    """The open elements; by tag, their places, so that the last one of some tags is found at once."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)
        self.places[root.tag].append(0)

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def first_after(self, tags, place: int) -> int | None:
        found = [own[k] for t in tags if (own := self.places[t]) and (k := bisect_right(own, place)) < len(own)]
        return min(found, default=None)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def build(source: str) -> Node:
    """The tree of a document, with implied tags."""
    root = Node("html")
    stack, scanner = Open(root), Scanner(source)
    at, end = 0, len(source)

    def text(x: str) -> None:
        if x:
            if stack.nodes[-1].tag == "head" and x.strip():
                stack.cut(len(stack.nodes) - 1)
            stack.nodes[-1].children.append(entities.unescape(x) if "&" in x else x)

    def add(node: Node) -> None:
        stack.nodes[-1].children.append(node)
        if node.tag in STRUCTURE:
            k = len(stack.nodes) - 1
            while k > 0 and stack.nodes[k].tag != "table" and not stack.nodes[k].holds_parts:
                stack.nodes[k].holds_parts = True
                k -= 1

    def close(tag: str) -> None:
        if tag == "p" and not stack.places["p"]:
            add(Node("p"))
        elif tag == "br":
            add(Node("br"))
        elif stack.places[tag]:
            place = stack.places[tag][-1]
            bound = () if tag in ("table", "body", "html") else ("table",) if tag in STRUCTURE else ("table", "td", "th", "caption")
            if place and place > stack.last(bound):
                stack.cut(place)

    def start(tag: str) -> None:
        if stack.nodes[-1].tag == "head" and tag not in IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSES_P and stack.places["p"] and stack.places["p"][-1] > stack.last(SCOPE):
            stack.cut(stack.places["p"][-1])
        if tag in IMPLIED:
            ended, bound = IMPLIED[tag]
            low = stack.first_after(ended, stack.last(bound))
            if low:
                stack.cut(low)
        if tag in ("td", "th") and stack.nodes[-1].tag in ("table", "thead", "tbody", "tfoot"):
            add(row := Node("tr"))
            stack.push(row)

    written = 0
    while at < end:
        open_at = source.find("<", at)
        if open_at < 0:
            break
        at = open_at + 1
        first = source[at : at + 1]
        is_end = first == "/"
        name = NAME.match(source, at + is_end)
        if not name and not is_end and first not in ("!", "?"):
            continue  # text
        text(source[written:open_at])
        if name:
            tag = name[0].lower()
            attrs, at = scanner.attributes(name.end())
            if is_end:
                close(tag)
            elif tag not in ("html", "body") or tag == "body" and not stack.places["body"]:
                start(tag)
                node = Node(tag, attrs)
                add(node)
                if tag in RAW:
                    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    inside = source[at : m.start() if m else end]
                    node.children.append(entities.unescape(inside) if tag in ("textarea", "title") else inside)
                    at = scanner.attributes(m.end())[1] if m else end
                elif tag not in VOID and not (tag in ("svg", "math") and source[at - 2 : at] == "/>"):
                    stack.push(node)
        elif source.startswith("!--", at):
            at += 3
            m = COMMENT_END.search(source, at)
            short = next((len(x) for x in (">", "->") if source.startswith(x, at)), 0)
            at = at + short if short else m.end() if m else end
        else:
            at = source.find(">", at) + 1 or end
        written = at
    text(source[written:end])
    return root


DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
AT_RULE, BRACE = re.compile(r"@([\w-]++)([^{};@]*+)([{;])"), re.compile(r"[{}]")
SELECTOR = re.compile(r"\s*((?:[a-zA-Z][\w-]*|\*)?)((?:[.#][\w-]+)*)\s*")


class Styles:
    """What decides on display and visibility: rules of style elements by tag, class or id, and style attributes."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        order = 0
        for sheet in sheets:
            for rule in self.plain(sheet).split("}"):
                before, _, body = rule.rpartition("{")
                selectors, declared = before.rpartition("{")[2], DECLARATION.findall(body)
                for selector in selectors.split(",") if declared else ():
                    m = SELECTOR.fullmatch(selector)
                    if not m or not (m[1] or m[2]):
                        continue
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    tag = "" if m[1] == "*" else m[1].lower()
                    need = frozenset([*marks, *([tag] if tag else [])])
                    weight = sum(100 if x[0] == "#" else 10 for x in marks) + bool(tag)
                    for name, value, important in declared:
                        order += 1
                        self.rules[marks[0] if marks else tag].append((need, name.lower(), (bool(important), weight, order), value.lower()))

    @staticmethod
    def plain(sheet: str) -> str:
        """A sheet without comments and blocks of at-rules, but for those for screens."""
        sheet, out, at = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S), [], 0
        for m in AT_RULE.finditer(sheet):
            if m.start() < at:
                continue
            out.append(sheet[at : m.start()])
            at, depth = m.end(), m[3] == "{"
            if depth:
                stop = len(sheet)
                for brace in BRACE.finditer(sheet, at):
                    depth += 1 if brace[0] == "{" else -1
                    if not depth:
                        stop = brace.end()
                        break
                if m[1].lower() == "media" and m[2].strip().lower() in ("screen", "all", ""):
                    out.append(sheet[at : stop - 1])
                at = stop
        return "".join([*out, sheet[at:]])

    def of(self, node: Node) -> tuple[str, str]:
        """display and visibility as declared for a node; empty where nothing is."""
        own, best = node.attrs.get("style", ""), {}
        if self.rules:
            marks = {node.tag, *("." + x for x in node.attrs.get("class", "").split()), *(["#" + node.attrs["id"]] if "id" in node.attrs else [])}
            for mark in {*marks, ""}:
                for need, name, weight, value in self.rules.get(mark, ()):
                    if need <= marks and weight >= best.get(name, ((False, -1, 0), ""))[0]:
                        best[name] = weight, value
        for k, (name, value, important) in enumerate(DECLARATION.findall(own) if own else ()):
            weight = bool(important), 1 << 30, k
            if weight >= best.get(name.lower(), ((False, -1, 0), ""))[0]:
                best[name.lower()] = weight, value.lower()
        return best.get("display", (0, ""))[1], best.get("visibility", (0, ""))[1]


def sheets(root: Node) -> list[str]:
    """The texts of all style elements, in order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "style":
            found += [x for x in node.children if isinstance(x, str)]
        else:
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]
    return found


def width(text: str) -> int:
    """Columns that a line takes: wide characters take two."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines: text is added with collapsed spaces; breaks and gaps are kept apart; open lists and quotes indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        #: By open list item or quote, what stands before its first line (taken when used) and before the others.
        self.indents: list[list[str]] = []

    def inline(self, text: str) -> None:
        x = SPACE.sub(" ", text)
        if x == " " or not x:
            self.space |= bool(self.parts) and bool(x)
            return
        if x[0] == " ":
            self.space |= bool(self.parts)
            x = x[1:]
        if self.space:
            self.parts.append(" ")
        self.space = x[-1] == " "
        self.parts.append(x[:-1] if self.space else x)

    def end(self) -> None:
        if self.parts:
            self.put("".join(self.parts))
        self.parts, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if line and self.indents:
            before = []
            for own in self.indents[:INDENTS]:
                before.append(own[0])
                own[0] = own[1]
            for own in self.indents[INDENTS:]:
                before.append(own[0].strip() and own[0])
                own[0] = ""
            line = "".join(before) + line
        self.lines.append(line)

    def block(self, lines: list[str], spaced: bool) -> None:
        self.end()
        self.gap |= spaced
        for x in lines:
            self.put(x)
        self.gap |= spaced

    def raw(self, text: str) -> None:
        """Preformatted text as a block."""
        text = text.removeprefix("\n").rstrip()
        self.block([x.rstrip() for x in text.expandtabs(8).split("\n")] if text else [], True)


def whole_number(text: str, least: int, most: int) -> int | None:
    """A number that a text begins with, held between two others; a minus sign counts."""
    m = re.match(r"\s*([-+]?)0*(\d{0,10})(\d*)", text)
    if not m[2] and not re.match(r"\s*[-+]?0", text):
        return None
    value = int(m[2] or 0) if not m[3] else 10**10
    return max(least, min(most, -value if m[1] == "-" else value))


class Renderer:
    def __init__(self, styles: Styles):
        self.styles = styles

    def shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether a node is rendered, and whether its own text is visible."""
        if node.tag in HIDDEN:
            return False, False
        display, visibility = self.styles.of(node) if node.attrs or self.styles.rules else ("", "")
        if display == "none" or not display and ("hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs):
            return False, False
        return True, visibility == "visible" if visibility in ("visible", "hidden", "collapse") else visible

    def fill(self, flow: Flow, root: Node, visible: bool) -> Generator:
        """Render a node's children into the flow; yields the renderings of cells that have to be done before."""
        work: list[tuple] = [("node", root, visible)]
        numbers: list[int] = []
        while work:
            kind, x, visible = work.pop()
            if kind == "call":
                x()
            elif kind == "text":
                if visible:
                    flow.inline(x)
            elif kind == "node":
                for child in reversed(self.children(x)):
                    work.append(("text" if isinstance(child, str) else "element", child if isinstance(child, str) else (child, x), visible))
            else:
                node, parent = x
                tag = node.tag
                rendered, visible = self.shown(node, visible)
                if not rendered:
                    continue
                inside = ("node", node, visible)
                if tag == "br":
                    flow.end() if flow.parts else flow.put("")
                elif tag == "hr":
                    flow.end()
                    flow.gap = True
                elif tag in ("pre", "textarea", "xmp"):
                    flow.raw(self.preformatted(node, visible))
                elif tag == "table":
                    flow.end()
                    flow.gap = True
                    work.append(("call", lambda: (flow.end(), setattr(flow, "gap", True)), visible))
                    rows, captions, outside = table_parts(node, visible, self.shown)
                    if any(len(row) > 1 for row in rows):
                        for y, seen in ((outside, visible), *captions):
                            own = Flow()
                            yield self.fill(own, y, seen)
                            flow.block(own.lines, False)
                        grid = []
                        for row in rows:
                            cells = []
                            for cell, seen in row:
                                own = Flow()
                                yield self.fill(own, cell, seen)
                                cells.append((own.lines, *spans(cell)))
                            grid.append(cells)
                        flow.block(aligned(grid), False)
                    else:  # cells of one column are blocks
                        for y, seen in reversed([(outside, visible), *captions, *(cell for row in rows for cell in row)]):
                            work += [("call", flow.end, visible), ("node", y, seen)]
                elif tag == "li":
                    mark = "- "
                    if parent.tag == "ol" and numbers:
                        given = whole_number(node.attrs.get("value", ""), -(10**9), 10**9)
                        numbers[-1] = numbers[-1] + 1 if given is None else given
                        mark = f"{numbers[-1]}. "
                    flow.end()
                    flow.indents.append([mark, " " * len(mark)])
                    work += [("call", lambda: (flow.end(), flow.indents.pop()), visible), inside]
                elif tag in ("blockquote", "dd"):
                    flow.end()
                    flow.gap |= tag == "blockquote"
                    flow.indents.append(["    ", "    "])
                    work += [("call", lambda g=tag == "blockquote": (flow.end(), flow.indents.pop(), setattr(flow, "gap", flow.gap or g)), visible), inside]
                elif tag in BLOCK:
                    spaced = tag in SPACED and not (tag in ("ul", "ol") and parent.tag == "li")
                    flow.end()
                    flow.gap |= spaced
                    if tag == "ol":
                        first = whole_number(node.attrs.get("start", ""), -(10**9), 10**9)
                        numbers.append(0 if first is None else first - 1)
                    work += [("call", lambda g=spaced, o=tag == "ol": (flow.end(), setattr(flow, "gap", flow.gap or g), o and numbers.pop()), visible), inside]
                elif tag == "q":
                    work += [("text", '"', visible), inside, ("text", '"', visible)]
                elif tag == "input":
                    if visible and node.attrs.get("type", "text").lower() in SHOWN_INPUTS:
                        flow.inline(node.attrs.get("value", ""))
                elif tag != "wbr":
                    work.append(inside)
        flow.end()

    def children(self, node: Node) -> list:
        """The children that can be seen: the summary of closed details, the chosen options of a select."""
        if node.tag == "details" and "open" not in node.attrs:
            return next(([x] for x in node.children if isinstance(x, Node) and x.tag == "summary"), [])
        if node.tag == "select":
            options, stack = [], [node]
            while stack:
                x = stack.pop()
                options += [x] if x.tag == "option" else []
                stack += [y for y in reversed(x.children) if isinstance(y, Node)]
            if "multiple" in node.attrs or (whole_number(node.attrs.get("size", ""), 0, 10**6) or 1) > 1:
                return options
            selected = [x for x in options if "selected" in x.attrs][-1:] or [x for x in options if "disabled" not in x.attrs][:1]
            return selected[0].children if selected else []
        return node.children

    def preformatted(self, node: Node, visible: bool) -> str:
        out, work = [], [(x, visible) for x in reversed(node.children)]
        while work:
            x, seen = work.pop()
            if isinstance(x, str):
                out.append(x if seen else re.sub(r"[^\n]", " ", x))
            elif x.tag == "br":
                out.append("\n")
            else:
                rendered, seen = self.shown(x, seen)
                if rendered:
                    if x.tag in BLOCK and out and not out[-1].endswith("\n"):
                        out.append("\n")
                    work += [(y, seen) for y in reversed([*self.children(x), *(["\n"] if x.tag in BLOCK else [])])]
        return "".join(out)


def spans(cell: Node) -> tuple[int, int]:
    """Columns and rows that a cell takes; no rows: all that follow."""
    rows = whole_number(cell.attrs.get("rowspan", ""), 0, MOST_ROWS) if "rowspan" in cell.attrs else 1
    columns = whole_number(cell.attrs.get("colspan", ""), 1, MOST_COLUMNS) if "colspan" in cell.attrs else 1
    return columns or 1, 1 if rows is None else rows or MOST_ROWS


def table_parts(table: Node, visible: bool, shown) -> tuple[list[list[tuple[Node, bool]]], list[tuple[Node, bool]], Node]:
    """The rows of cells and the captions, each with whether its text is visible, and all other content of a table, which becomes a block by stretch."""
    rows: list[list[tuple[Node, bool]]] = []
    captions: list[tuple[Node, bool]] = []
    outside = Node("div")
    apart = True
    in_row = False
    work: list = [(x, visible) for x in reversed(table.children)]
    while work:
        x, seen = work.pop()
        if x is None:  # the end of a row or of a group of rows
            apart, in_row = True, False
            continue
        tag = "" if isinstance(x, str) else x.tag
        if tag:
            rendered, seen = shown(x, seen)
            if not rendered:
                continue
        if tag == "caption":
            captions.append((x, seen))
        elif tag in ("td", "th"):
            if not in_row:
                rows.append([])
                in_row = True
            rows[-1].append((x, seen))
        elif tag in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            if tag == "tr":
                rows.append([])
            in_row = tag == "tr"
            work.append((None, seen))
            work += [(y, seen) for y in reversed(x.children)]
        elif tag not in ("", "table") and x.holds_parts:
            work += [(y, seen) for y in reversed(x.children)]
        else:
            if apart:
                outside.children.append(Node("div"))
            outside.children[-1].children.append(x)
            apart = False
            continue
        apart = True
    return rows, captions, outside


def aligned(grid: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of rows of cells (lines, columns, rows): what starts in a column starts at the same place; a cell's lines stay below each other."""
    until: dict[int, int] = {}
    placed: list[list[tuple[int, int, list[str], int]]] = []
    for r, row in enumerate(grid):
        at, cells = 0, []
        for lines, columns, rows in row:
            while until.get(at, 0) > r:
                at += 1
            cells.append((at, columns, lines, max(map(width, lines), default=0)))
            if rows > 1:
                until.update(dict.fromkeys(range(at, at + columns), r + rows))
            at += columns
        placed.append(cells)
    starts = sorted({cell[0] for row in placed for cell in row})
    index, widths = {c: i for i, c in enumerate(starts)}, [0] * len(starts)
    for at, columns, _, wide in (cell for row in placed for cell in row):
        i = index[at]
        if i + 1 == len(starts) or starts[i + 1] >= at + columns:
            widths[i] = max(widths[i], min(wide, ALIGNED))
    places = [0]
    for w in widths:
        places.append(places[-1] + w + 2)
    out = []
    for row in placed:
        cells, k = row, 0
        while cells := [c for c in cells if len(c[2]) > k]:
            parts, at = [], 0
            for column, _, lines, _ in cells:
                line = lines[k]
                if line:
                    gap = max(places[index[column]] - at, 2 if at else 0)
                    parts.append(" " * gap + line)
                    at += gap + width(line)
            out.append("".join(parts).rstrip())
            k += 1
    return out if any(out) else []


def render(source: str | None) -> str:
    """All visible text of a document."""
    if not source:
        return ""
    root = build(source)
    flow, renderer = Flow(), Renderer(Styles(sheets(root)))
    running = [renderer.fill(flow, root, True)]
    while running:  # a cell's rendering is done before the one that asked for it goes on
        try:
            running.append(next(running[-1]))
        except StopIteration:
            running.pop()
    flow.end()
    return "\n".join(flow.lines).strip("\n")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        texts = [render(x) for x in strings(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines of every page."""
    return named(pages, page_id=page_id, html=html).mapInArrow(_rendered, "page_id long, text string, n_chars long, n_lines long")
