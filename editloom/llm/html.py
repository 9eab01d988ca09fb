"""Text of web pages as they are laid out: a tree with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.common import table

#: Fixed values, as in browsers and the HTML standard: how deep elements are nested (deeper ones keep their text but open
#: no level), and how many columns and rows a cell may span.
DEPTH, COLUMNS, ROWS = 512, 1000, 65_534

#: A quote opens a value only behind an equals sign.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_TAG = re.compile(rf"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<open>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)>|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>)""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Their content is text up to the end tag; character references are read in the second kind only.
RAW, ESCAPABLE = _words("script style xmp iframe noembed noframes"), _words("textarea title")
#: Elements that are never shown.
UNSEEN = _words("head title script style template noscript noembed noframes iframe object audio video canvas svg math datalist param source track meta link base area map")
#: Blocks with a blank line around them, and blocks that only begin on a new line.
SPACED = _words("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre figure table hr fieldset listing xmp plaintext")
LINED = _words("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav search section summary option optgroup caption tr thead tbody tfoot td th")
#: A start tag ends an open element of these names, unless one of the bounds is nearer.
_CLOSES_P = SPACED | _words("address article aside center details dialog div figcaption footer form header hgroup main nav search section summary")
_CLOSED_BY = {
    "li": (_words("li"), _words("ul ol menu dir")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")),
    "option": (_words("option"), _words("select datalist optgroup")), "optgroup": (_words("option optgroup"), _words("select")),
    "tr": (_words("tr td th caption colgroup"), _words("table")), "td": (_words("td th"), _words("tr table")), "th": (_words("td th"), _words("tr table")),
    "thead": (_words("caption colgroup thead tbody tfoot tr td th"), _words("table")), "tbody": (_words("caption colgroup thead tbody tfoot tr td th"), _words("table")), "tfoot": (_words("caption colgroup thead tbody tfoot tr td th"), _words("table")),
    "body": (_words("head"), frozenset()), "rt": (_words("rt rp"), _words("ruby")), "rp": (_words("rt rp"), _words("ruby")),
}
_IN_HEAD = _words("base link meta title script style noscript template")
#: End tags do not reach beyond these.
_WALLS = _words("table td th caption template button object html")

#: Where only rows and cells may stand, and what may stand there.
_ROWS = _words("table thead tbody tfoot tr colgroup")
_IN_TABLE = _words("caption colgroup col thead tbody tfoot tr td th script style template input form")


class Node:
    __slots__ = ("tag", "attrs", "children", "style")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.style: tuple[bool, bool | None] = (True, None)  # displayed; visible, hidden or as the parent


class Rule:
    """A rule of a style sheet: what its selector asks of an element and of those around it, and what it sets."""

    def __init__(self, selector: str, order: int, sets: dict[str, tuple[bool, str]]):
        self.sets = sets
        self.steps: list[tuple[str, str, set[str], set[str]]] = []  # (how it is joined to the next, tag, ids, classes)
        for join, tag, marks in re.findall(r"\s*([> ]?)\s*([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+)*)", selector.strip()):
            if tag or marks:
                of = lambda c: {m[1:] for m in re.findall(r"[#.][\w-]+", marks) if m[0] == c}  # noqa: B023, E731
                self.steps.append((join, tag.lower(), of("#"), of(".")))
        self.weight = (sum(len(s[2]) for s in self.steps), sum(len(s[3]) for s in self.steps), sum(s[1] not in ("", "*") for s in self.steps), order)

    def fits(self, node: Node, above: list[Node]) -> bool:
        if not self.steps or not _is(node, self.steps[-1]):
            return False
        k, join = len(above) - 1, self.steps[-1][0]
        for step in reversed(self.steps[:-1]):
            while k >= 0 and not _is(above[k], step):
                if join == ">":
                    return False
                k -= 1
            if k < 0:
                return False
            k, join = k - 1, step[0]
        return True


def _is(node: Node, step: tuple[str, str, set[str], set[str]]) -> bool:
    _, tag, ids, classes = step
    return tag in ("", "*", node.tag) and (not ids or ids == {node.attrs.get("id", "")}) and classes <= set(node.attrs.get("class", "").split())


def _declared(body: str) -> dict[str, tuple[bool, str]]:
    """Of a list of declarations what bears on visibility: property, (whether important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), re.sub(r"\s+", "", value)
        if name in ("display", "visibility", "content-visibility") and value:
            new = (value.endswith("!important"), value.removesuffix("!important"))
            if name not in out or new[0] >= out[name][0]:
                out[name] = new
    return out


def style_rules(sheets: list[str]) -> list[Rule]:
    """The rules of style sheets that bear on visibility: selectors of tags, classes and ids, one within another.

    Rules under conditions (``@media`` but for all and screen, ``@supports`` and others) and selectors of other kinds
    are left out, so that text stays in doubt.
    """
    out: list[Rule] = []
    for sheet in sheets:
        text = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", sheet, flags=re.S)
        text = re.sub(r"@(?:import|charset|namespace)[^;{]*;", " ", text)
        blocks, skipped = [True], 0  # whether what is open counts
        at = 0
        for m in re.finditer(r"([^{}]*)([{}])", text):
            head, brace = m[1].strip(), m[2]
            if brace == "{":
                if head.startswith("@"):
                    media = re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)\s*", head.lower())
                    blocks.append(blocks[-1] and bool(media))
                else:
                    blocks.append(blocks[-1])
                    at = m.end()
                    held = head
                    skipped = len(blocks)
            else:
                if skipped == len(blocks) and len(blocks) > 1 and blocks[-1]:
                    if sets := _declared(text[at : m.end(1)]):
                        out += [Rule(s, len(out), sets) for s in held.split(",") if re.fullmatch(r"\s*[\w#.*-]+(?:\s*[> ]\s*[\w#.*-]+)*\s*", s)]
                skipped = 0
                if len(blocks) > 1:
                    blocks.pop()
    return out


def set_styles(root: Node, sheets: list[str]) -> None:
    """Sets ``style`` of every element: whether it is displayed, and whether it says that it is visible or hidden."""
    rules = style_rules(sheets)
    stack: list[tuple[Node, int]] = [(x, 1) for x in reversed(root.children) if isinstance(x, Node)]
    above: list[Node] = [root]
    while stack:
        node, depth = stack.pop()
        del above[depth:]
        won: dict[str, tuple[tuple, str]] = {}
        for r in rules:
            if r.fits(node, above):
                for name, (important, value) in r.sets.items():
                    if name not in won or ((important, 0), r.weight) >= won[name][0]:
                        won[name] = (((important, 0), r.weight), value)
        for name, (important, value) in _declared(node.attrs["style"]).items() if "style" in node.attrs else ():
            if name not in won or (important, 1) >= won[name][0][0]:
                won[name] = (((important, 1), ()), value)
        shown = won.get("display", ((), ""))[1] != "none" and won.get("content-visibility", ((), ""))[1] != "hidden"
        visible = {"visible": True, "hidden": False, "collapse": False}.get(won.get("visibility", ((), ""))[1])
        node.style = (shown, visible)
        above.append(node)
        stack += [(x, depth + 1) for x in reversed(node.children) if isinstance(x, Node)]


def parse(source: str) -> Node:
    """The tree of a page. Broken markup gives a tree too; nothing of its text is lost."""
    root = Node("html")
    stack = [root]
    at, end = 0, len(source)

    def place(x: Node | str) -> None:
        """Appends to the open element; what has no place between rows and cells goes in front of their table."""
        k = len(stack) - 1
        if stack[k].tag in _ROWS and (x.tag not in _IN_TABLE if isinstance(x, Node) else x.strip(" \t\n\r\f")):
            while k and stack[k].tag != "table":
                k -= 1
            if k:
                above = stack[k - 1].children
                at_table = next((j for j in range(len(above) - 1, -1, -1) if above[j] is stack[k]), len(above))
                above.insert(at_table, x)
                return
        stack[k].children.append(x)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
                stack.pop()
            place(s)

    def close(names: frozenset[str], bounds: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                return
            if stack[k].tag in names:
                del stack[k:]
                if names & {"td", "th", "tr", "option", "head"}:
                    return close(names, bounds)
                return

    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            rest = source[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page ends in
            text(entities.unescape(rest[: cut.start()] if cut else rest))
            break
        if m.start() > at:
            text(entities.unescape(source[at : m.start()]))
        at = m.end()
        if name := m["open"]:
            tag, raw = name.lower(), m["attrs"]
            if tag == "html":
                continue
            attrs: dict[str, str] = {}
            for k, *v in _ATTR.findall(raw) if raw else ():  # of attributes with one name the first counts
                attrs.setdefault(k.lower(), entities.unescape(next((x for x in v if x), "")))
            if stack[-1].tag == "head" and tag not in _IN_HEAD:
                stack.pop()
            if tag in _CLOSES_P:
                close(_words("p"), _WALLS)
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
                stack.pop()
            if tag in _CLOSED_BY:
                close(*_CLOSED_BY[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")  # an implied row
                place(row)
                stack.append(row)
            node = Node(tag, attrs)
            place(node)
            if tag in RAW or tag in ESCAPABLE:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                inside = source[at : stop.start() if stop else end]
                node.children.append(entities.unescape(inside) if tag in ESCAPABLE else inside)
                at = stop.end() if stop else end
            elif tag not in VOID and not (raw and raw.endswith("/") and tag in ("svg", "path")) and len(stack) < DEPTH:
                stack.append(node)
        elif name := m["close"]:
            tag = name.lower()
            if tag == "br":
                place(Node("br"))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                place(Node("p"))
            elif tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag or re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[k].tag):
                        del stack[k:]
                        break
                    if stack[k].tag in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                        break
    return root


def unseen(node: Node) -> bool:
    """Whether an element takes no part in the layout: by its name, the attributes hidden and open, and its style."""
    if node.tag in UNSEEN or "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found":
        return True
    if node.tag == "dialog" and "open" not in node.attrs or node.tag == "input":
        return True
    return not node.style[0]


def visible(node: Node, seen: bool) -> bool:
    """Whether text in the element is seen; hidden text can have visible text within."""
    return seen if node.style[1] is None else node.style[1]


def breadth(s: str) -> int:
    """Columns that a line takes: wide characters two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of one container. Blank lines of neighbouring blocks collapse; none stands at an end."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.kept = 0, False, False

    def text(self, s: str, as_is: bool) -> None:
        if as_is:
            for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if k:
                    self.end(True)
                if line:
                    self.put(line)
                    self.kept = True
            return
        parts = _SPACE.split(s)
        if not parts[0]:
            self.space = True
            parts = parts[1:]
        for k, part in enumerate(parts):
            if part:
                self.put(part)
            if k < len(parts) - 1:
                self.space = True

    def put(self, part: str) -> None:
        if self.space and self.now and not self.now[-1].endswith((" ", "\t")):
            self.now.append(" ")
        self.space = False
        self.now.append(part)

    def end(self, forced: bool = False) -> None:
        """Ends the line; an empty one counts only if ``forced``."""
        if self.now or forced:
            if self.gap and self.lines:
                self.lines.append("")
            line = "".join(self.now)
            self.lines.append(line if self.kept else line.rstrip(" "))
            self.gap, self.now = 0, []
        self.space = self.kept = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, int(spaced))

    def add(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Finished lines, with prefixes."""
        self.end()
        for k, line in enumerate(lines):
            self.now = [(first if k == 0 else rest if line else "") + line]
            self.kept = True
            self.end(True)

    def done(self) -> list[str]:
        self.end()
        lines = self.lines
        while lines and not lines[-1].strip(" "):
            lines.pop()
        first = next((k for k, x in enumerate(lines) if x.strip(" ")), 0)
        return lines[first:]


def _number(text: str, default: int) -> int:
    try:
        return int(text)
    except ValueError:
        return default


def _marker(node: Node, number: int) -> str:
    kind = node.attrs.get("type", "1")
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, r = divmod(number - 1, 26)
            out = chr(97 + r) + out
        return (out if kind == "a" else out.upper()) + ". "
    return f"{number}. "


def _rows(node: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
    """Rows of a table and whether their text is seen; those of its head first and of its foot last, as they are shown."""
    groups: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tfoot": [], "": []}
    for x in node.children:
        if isinstance(x, Node) and not unseen(x):
            if x.tag == "tr":
                groups[""].append((x, visible(x, seen)))
            elif x.tag in ("thead", "tbody", "tfoot"):
                groups[x.tag if x.tag in groups else ""] += [(y, visible(y, visible(x, seen))) for y in x.children if isinstance(y, Node) and y.tag == "tr" and not unseen(y)]
    return iter(groups["thead"] + groups[""] + groups["tfoot"])


def table_lines(node: Node, seen: bool) -> list[str]:
    """The rows of a table, each column as wide as its widest cell, two spaces between columns.

    A cell over several columns counts for their width only if they are too narrow together, then the last one grows; a
    cell over several rows stands in the first.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}
    for row, of_row in _rows(node, seen):
        here, column = [], 0
        for x in row.children:
            if not isinstance(x, Node) or x.tag not in ("td", "th") or unseen(x):
                continue
            while taken.get(column, 0) > 0:
                column += 1
            flow = Flow()
            show(x.children, flow, False, 0, visible(x, of_row))
            span = min(max(1, _number(x.attrs.get("colspan", "1"), 1)), COLUMNS)
            here.append((column, span, flow.done()))
            down = min(max(1, _number(x.attrs.get("rowspan", "1"), 1)), ROWS)
            for k in range(column, column + span):
                taken[k] = down if down > 1 else 1
            column += span
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        placed.append(here)
    widths: dict[int, int] = {}
    for wide in (False, True):
        for column, span, lines in (c for r in placed for c in r if (c[1] > 1) == wide):
            need = max(map(breadth, lines), default=0)
            have = sum(widths.get(k, 0) for k in range(column, column + span)) + 2 * (span - 1)
            last = column + span - 1
            widths[last] = widths.get(last, 0) + max(0, need - have) if wide else max(widths.get(last, 0), need)
    starts, at = {}, 0
    for k in range(max(widths, default=-1) + 1):
        starts[k] = at
        at += widths.get(k, 0) + (2 if widths.get(k, 0) else 0)
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, size = "", 0
            for column, _, lines in row:
                if k < len(lines) and lines[k]:
                    line += " " * (starts[column] - size) + lines[k]
                    size = starts[column] + breadth(lines[k])
            out.append(line.rstrip(" "))
    return out


def show(children: list, flow: Flow, as_is: bool, level: int, seen: bool = True) -> None:
    """The children of an element, into ``flow``; ``level`` counts the lists around, ``seen`` is what they inherit."""
    for x in children:
        if isinstance(x, str):
            if seen:
                flow.text(x, as_is)
            continue
        tag = x.tag
        if unseen(x):
            continue
        now = visible(x, seen)
        if tag == "br":
            if now:
                flow.end(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(level == 0)
            _list(x, flow, level, now)
            flow.block(level == 0)
        elif tag == "table":
            flow.block(True)
            for y in x.children:
                if isinstance(y, str) or y.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):  # captions, and what has no place in a table
                    show([y], flow, False, level, now)
            flow.end()
            flow.add(table_lines(x, now))
            flow.block(True)
        elif tag in ("blockquote", "dd"):
            inner = Flow()
            show(x.children, inner, as_is, level, now)
            flow.block(tag in SPACED)
            flow.add(inner.done(), "  ", "  ")
            flow.block(tag in SPACED)
        elif tag in SPACED or tag in LINED:
            flow.block(tag in SPACED)
            kept = tag in ("pre", "listing", "xmp", "plaintext", "textarea")
            inside = x.children
            if kept and inside and isinstance(inside[0], str):
                inside = [re.sub(r"\A\r?\n", "", inside[0]), *inside[1:]]
            show(inside, flow, as_is or kept, level, now)
            flow.block(tag in SPACED)
        else:
            show(x.children, flow, as_is or tag == "textarea", level, now)


def _list(node: Node, flow: Flow, level: int, seen: bool) -> None:
    items = sum(isinstance(y, Node) and y.tag == "li" for y in node.children)
    down = "reversed" in node.attrs
    number = _number(node.attrs.get("start", ""), items if down else 1)
    for y in node.children:
        if isinstance(y, Node) and y.tag == "li" and not unseen(y):
            number = _number(y.attrs.get("value", ""), number)
            mark = _marker(node, number) if node.tag == "ol" else "- "
            inner = Flow()
            now = visible(y, seen)
            show(y.children, inner, False, level + 1, now)
            lines = inner.done()
            if lines or now:
                flow.add(lines or [""], mark if now else " " * len(mark), " " * len(mark))
            number += -1 if down else 1
        else:
            show([y], flow, False, level + 1, seen)


def _sheets(node: Node) -> list[str]:
    """The style sheets in a page that hold on a screen, in order."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag == "style":
            if x.attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
                out += [s for s in x.children if isinstance(s, str)]
        else:
            stack += [y for y in reversed(x.children) if isinstance(y, Node)]
    return out


def render(source: str) -> str:
    """The visible text of a page."""
    tree, flow = parse(source.replace("\0", "")), Flow()
    sheets = _sheets(tree)
    if sheets or "style" in source or "STYLE" in source or "Style" in source:
        set_styles(tree, sheets)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 20 * DEPTH))  # a few frames a level
    try:
        show(tree.children, flow, False, 0)
    finally:
        sys.setrecursionlimit(before)
    return "\n".join(flow.done())


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """The columns ``keep`` of every row of ``pages``, and the text that its HTML shows.

    A null or empty page has an empty text; very long pages are read whole, in time that grows with their length; broken
    markup is repaired as far as it goes; repeated rows each give a row; an empty table gives no rows; further columns are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = [render(s.as_py() or "") for s in x.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    rows = pages.select(*keep, F.col(column).cast("string").alias("html"))
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
