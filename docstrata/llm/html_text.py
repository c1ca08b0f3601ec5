"""Layout-aware text of HTML pages.

A tree is built with the implied tags of HTML (paragraphs, list items, table parts, options, head and body); then all
that a reader would see is written out: blocks on lines of their own, blank lines around paragraphs, list marks with
their depth, and the cells of a table in aligned columns (spans of rows and columns leave cells empty); what a table
holds outside its cells comes before it. Scripts, styles, templates, comments, the head, and elements that an attribute,
a style or a simple rule of the page's style sheets hides leave nothing.
"""

from __future__ import annotations

import collections
import html

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head title noscript iframe object embed noembed noframes datalist canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul menu".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
    "ol p pre search section summary table ul li".split()
)
# What an opening tag closes (left), unless one of the elements at the right stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)), "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
SCOPE = frozenset("table td th caption html object template button".split())
DEEPEST = 512  # open elements; what is nested deeper stands beside, as in browsers
IN_HEAD = frozenset("base link meta title style script noscript template".split())

_NAME = regex.compile(r"/?([a-zA-Z][^\s/>]*+)")
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>))"
_TAIL = regex.compile(rf"((?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)>")
_ATTRIBUTE = regex.compile(rf"(=?[^\s/>=]++)(?:{_VALUE})?+")
_DISPLAY = regex.compile(r"(?i)(?:^|[;\s])display\s*+:\s*+([a-z-]++)")
_VISIBILITY = regex.compile(r"(?i)(?:^|[;\s])visibility\s*+:\s*+([a-z-]++)")
_RULE = regex.compile(r"([^{}]*+)\{([^{}]*+)\}")
_SELECTOR = regex.compile(r"([a-zA-Z][\w-]*+|\*)?(?:\.([\w-]++)|#([\w-]++))?$")
_SPACE = regex.compile(r"[ \t\n\r\f]+")
_WHOLE = regex.compile(r"\s*+([+-]?)([0-9]++)")
_HUGE = regex.compile(r"(?i)&#(?:x0*[0-9a-f]{7,}+|0*[0-9]{8,}+);?")
_PARTS = frozenset("thead tbody tfoot colgroup".split())
WIDEST = 80  # columns of a table are aligned up to this width; a longer cell moves what follows it in its row


def _unescape(text: str) -> str:
    """Character references replaced; numbers beyond all characters become U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_HUGE.sub("\ufffd", text) if "&#" in text else text)


def _number(text: str | None, default: int, low: int, high: int) -> int:
    """The whole number at the start of an attribute, as HTML reads it, inside bounds."""
    m = _WHOLE.match(text or "")
    if m is None:
        return default
    size = int(m[2][:12]) if len(m[2].lstrip("0")) <= 12 else 10**12
    return min(high, max(low, -size if m[1] == "-" else size))


class Node:
    __slots__ = ("attributes", "cells", "children", "name", "named")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []
        self.cells = False  # whether rows, cells or captions of the table around it are below
        self.named: dict[str, str] | None = None

    def attribute(self, name: str) -> str | None:
        if self.named is None:
            self.named = {}
            for m in _ATTRIBUTE.finditer(self.attributes):
                self.named.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
        found = self.named.get(name)
        return None if found is None else _unescape(found)

    def seen(self, sheet: Sheet, inherited: bool) -> bool | None:
        """Whether its own text is visible; None: nothing of it is there, nor of what it holds."""
        if self.name in UNSEEN:
            return None
        if not self.attributes and not sheet.by_tag:
            return inherited
        low = self.attributes.lower()
        if "hidden" in low and (self.attribute("hidden") is not None or (self.name == "input" and self.attribute("type") == "hidden")):
            return None
        display, visibility = sheet.of(self) if sheet.rules else (None, None)
        if "style" in low:
            style = self.attribute("style") or ""
            for m in _DISPLAY.finditer(style):
                display = m[1]
            for m in _VISIBILITY.finditer(style):
                visibility = m[1]
        if display and display.lower() == "none":
            return None
        return inherited if not visibility or visibility.lower() == "inherit" else visibility.lower() not in ("hidden", "collapse")


class Sheet:
    """What style elements say on display and visibility by tag, class or id; other selectors do not count."""

    def __init__(self):
        self.rules: dict[tuple[str, str], list[tuple[str, str | None, str | None]]] = {}
        self.by_tag = False

    def add(self, text: str):
        if "display" not in text.lower() and "visibility" not in text.lower():
            return
        for m in _RULE.finditer(text):
            shown, seen = (list(x.finditer(m[2])) for x in (_DISPLAY, _VISIBILITY))
            if not shown and not seen or "@" in m[1]:
                continue
            for selector in m[1].split(","):
                one = _SELECTOR.match(selector.strip())
                if one is None or not one[0]:
                    continue
                key = ("#", one[3]) if one[3] else (".", one[2]) if one[2] else ("", (one[1] or "*").lower())
                self.by_tag = self.by_tag or not key[0]
                self.rules.setdefault(key, []).append(((one[1] or "*").lower(), shown[-1][1] if shown else None, seen[-1][1] if seen else None))

    def of(self, node: Node) -> tuple[str | None, str | None]:
        keys = [("", "*"), ("", node.name)]
        if node.attributes:
            keys += [(".", c) for c in (node.attribute("class") or "").split()] + [("#", node.attribute("id") or "")]
        display = visibility = None
        for key in keys:
            for tag, shown, seen in self.rules.get(key, ()):
                if tag in ("*", node.name):
                    display, visibility = shown or display, seen or visibility
        return display, visibility


class Tree:
    """Elements from tags in order; the stack holds the open ones."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.opened: collections.Counter = collections.Counter()
        self.sheet = Sheet()

    def pop(self, to: int):
        for x in self.stack[to:]:
            self.opened[x.name] -= 1
        del self.stack[to:]

    def close_to(self, names, barrier) -> bool:
        """Close up to the nearest open element of ``names``, if no element of ``barrier`` is nearer."""
        if not any(self.opened[n] for n in names):
            return False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                self.pop(i)
                return True
            if self.stack[i].name in barrier:
                return False
        return False

    def open(self, name: str, attributes: str, empty: bool):
        if name in ("html", "body") and self.opened[name]:
            return
        if self.stack[-1].name == "head" and name not in IN_HEAD:
            self.pop(len(self.stack) - 1)
        if name in ENDS_P:
            self.close_to(("p",), SCOPE)
        if name in CLOSES:
            closed, barrier = CLOSES[name]
            while self.close_to(closed, barrier):
                pass
        top = self.stack[-1].name
        if name == "tr" and top == "table":
            self.push(Node("tbody"))
        elif name in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                self.push(Node("tbody"))
            self.push(Node("tr"))
        self.push(Node(name, attributes), empty)

    def push(self, node: Node, empty: bool = False):
        self.stack[-1].children.append(node)
        if node.name in ("tr", "td", "th", "caption"):
            for x in reversed(self.stack):
                if x.cells or x.name == "table":
                    break
                x.cells = True
        elif self.opened["svg"] and node.name in ("defs", "desc", "metadata") or self.opened["math"] and node.name in ("annotation", "annotation-xml"):
            node.attributes += " hidden"
        if not empty and len(self.stack) < DEEPEST:
            self.stack.append(node)
            self.opened[node.name] += 1

    def close(self, name: str):
        if name == "p" and not self.opened["p"]:
            return
        if name == "br":
            self.open("br", "", True)
            return
        self.close_to((name,), () if name in ("html", "body", "table") else ("table",) if name not in ("thead", "tbody", "tfoot", "tr", "td", "th", "caption") else ())

    def text(self, raw: str):
        if not raw:
            return
        if self.stack[-1].name == "head" and raw.strip():
            self.pop(len(self.stack) - 1)
        self.stack[-1].children.append(_unescape(raw))


def parse(source: str) -> Tree:
    """The tree of a page. Each character is read once: a tag ends at its ``>``, and one that has none ends the page."""
    tree, at, size = Tree(), 0, len(source)
    while at < size:
        begin = source.find("<", at)
        if begin < 0:
            tree.text(source[at:])
            break
        after = source[begin + 1 : begin + 2]
        if after in ("!", "?") and after:
            tree.text(source[at:begin])
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                at = size if end < 0 else end + 3
            elif source.startswith("<![CDATA[", begin):
                end = source.find("]]>", begin + 9)
                tree.text(source[begin + 9 : size if end < 0 else end])
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", begin)
                at = size if end < 0 else end + 1
            continue
        m = _NAME.match(source, begin + 1)
        if m is None:
            tree.text(source[at : begin + 1])
            at = begin + 1
            continue
        tree.text(source[at:begin])
        tail = _TAIL.match(source, m.end())
        if tail is None:
            break
        at, name = tail.end(), m[1].lower()
        if after == "/":
            tree.close(name)
            continue
        tree.open(name, tail[1], name in VOID)
        if name in RAW:
            end = regex.compile(rf"(?i)</{regex.escape(name)}\s*+/?>").search(source, at)
            body, at = (source[at : end.start()], end.end()) if end else (source[at:], size)
            if name in ("textarea", "title"):
                body = _unescape(body)
            if name == "style":
                tree.sheet.add(body)
            if body and tree.stack[-1].name == name:
                tree.stack[-1].children.append(body)
            tree.close(name)
    return tree


class Writer:
    """Lines of text: runs of white space are one space, blocks begin lines, ``gap`` asks for blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def words(self, text: str):
        first, last = text[:1] in " \t\n\r\f", text[-1:] in " \t\n\r\f"
        body = _SPACE.sub(" ", text).strip(" ")
        if not body:
            self.space = self.space or bool(text)
            return
        if (self.space or first) and self.now:
            self.now.append(" ")
        self.now.append(body)
        self.space = last

    def kept(self, text: str):
        for i, line in enumerate(text.split("\n")):
            if i:
                self.line(keep_empty=True)
            if line:
                self.now.append(line.replace("\r", ""))
        self.space = False

    def line(self, keep_empty: bool = False):
        text = "".join(self.now).rstrip()
        if text or self.mark and keep_empty:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append(f"{self.indent}{self.mark}{text}".rstrip())
            self.mark = ""
        elif keep_empty and self.lines:
            self.lines.append("")
        self.now, self.space = [], False

    def block(self, blank: bool):
        self.line()
        if blank:
            self.gap = 1


def _table(node: Node, sheet: Sheet, visible: bool) -> tuple[list[tuple[Node | str, bool]], list[str]]:
    """What stands in a table outside its cells and captions, which browsers put before it, and the table's lines.

    Rows and cells are found at any depth below other elements, and a cell without a row makes one. Cells are padded to
    the width of their column, up to ``WIDEST``; a cell that spans columns or rows leaves the other places empty.
    """
    rows: list[list[str]] = []
    captions: list[str] = []
    stray: list[tuple[Node | str, bool]] = []
    below: dict[int, int] = {}  # columns that a cell from above takes up, with the rows it still does
    stack: list[tuple] = [(c, None, visible) for c in reversed(node.children)]

    def begin() -> list[str]:
        for column in [c for c, n in below.items() if n <= 0]:
            del below[column]
        for column in below:
            below[column] -= 1
        rows.append([])
        return rows[-1]

    def fill(cells: list[str]):
        while len(cells) in taken:
            cells.append("")

    taken: set[int] = set()
    while stack:
        c, cells, visible = stack.pop()
        if isinstance(c, str):
            if c.strip(" \t\n\r\f"):
                stray.append((c, visible))
            continue
        visible = c.seen(sheet, visible)
        if visible is None:
            continue
        if c.name == "caption":
            captions += render(c, sheet, visible).split("\n")
        elif c.name in ("td", "th"):
            if cells is None:
                cells, taken = begin(), set(below)
            columns, down = (_number(c.attribute(x), 1, 1, most) if c.attributes else 1 for x, most in (("colspan", 100), ("rowspan", 65_534)))
            fill(cells)
            if down > 1:
                below.update(dict.fromkeys(range(len(cells), len(cells) + columns), down - 1))
            cells.append(_SPACE.sub(" ", render(c, sheet, visible)))
            cells += [""] * (columns - 1)
        elif c.name == "tr":
            own, taken = begin(), set(below)
            stack += [(x, own, visible) for x in reversed(c.children)]
        elif c.name in _PARTS or c.cells and c.name != "table":
            if c.name in _PARTS:
                below.clear()  # a cell ends with its part of the table
            stack += [(x, cells, visible) for x in reversed(c.children)]
            if c.name in BLOCK:
                stray.append((Node("div"), visible))  # a line of its own
        else:
            stray.append((c, visible))
    widths: list[int] = []
    for r in rows:
        widths += [0] * (len(r) - len(widths))
        for i, x in enumerate(r):
            if widths[i] < len(x) <= WIDEST:
                widths[i] = len(x)
    return stray, [x for x in captions if x] + ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows if any(r)]


def render(root: Node, sheet: Sheet, visible: bool = True) -> str:
    """All visible text below ``root``. Walks with a stack of its own, so that depth does not matter."""
    out = Writer()
    lists: list[list] = []  # kind and next number of each open list
    pre = 0
    stack: list[tuple] = [("enter", c, visible) for c in reversed(root.children)]
    while stack:
        step, node, visible = stack.pop()
        if isinstance(node, str):
            if visible:
                (out.kept if pre else out.words)(node)
            continue
        if step == "table":
            out.block(True)
            for line in node:
                out.now = [line]
                out.line()
            out.block(True)
            continue
        name = node.name
        if step == "leave":
            out.block(name in SPACED and not (name in ("ul", "ol", "menu") and len(lists) > 1))
            if name in ("ul", "ol", "menu"):
                lists.pop()
                out.indent = "  " * max(0, len(lists) - 1)
            pre -= name in ("pre", "textarea")
            if name == "li":
                out.mark = ""
            continue
        inherited, visible = visible, node.seen(sheet, visible)
        if visible is None:
            continue
        if name == "br":
            out.line(keep_empty=bool(out.lines) and not out.now)
            continue
        if name == "img":
            out.words((node.attribute("alt") or "") if visible else "")
            continue
        if name == "table":
            before, lines = _table(node, sheet, visible)
            stack.append(("table", lines, visible))
            stack += [("enter", c, v) for c, v in reversed(before)]
            continue
        if name in BLOCK or name in ("tr", "caption"):
            out.block(name in SPACED and not (name in ("ul", "ol", "menu") and lists))
            if name in ("ul", "ol", "menu"):
                lists.append([name, _number(node.attribute("start") if node.attributes else None, 1, -(10**9), 10**9)])
                out.indent = "  " * (len(lists) - 1)
            elif name == "li" and lists:
                mark = f"{lists[-1][1]}. " if lists[-1][0] == "ol" else "- "
                out.mark = mark if visible else ""
                lists[-1][1] += 1
            pre += name == "pre"
            stack.append(("leave", node, inherited))
        elif name in ("td", "th"):
            out.space = True
        elif name == "textarea":
            pre += 1
            stack.append(("leave", node, inherited))
        stack += [("enter", c, visible) for c in reversed(node.children)]
    out.line()
    return "\n".join(out.lines).strip("\n")


def visible_text(source: str | None) -> str:
    if not source:
        return ""
    tree = parse(source)
    return render(tree.root, tree.sheet)


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``, the visible text of each whole page (an existing column of that name is replaced).

    Null and empty pages give an empty text. Broken markup is read tag by tag and never fails: a tag without an end takes
    the rest of the page, as in browsers; numbers in attributes and character references are held inside bounds; what is
    nested deeper than ``DEEPEST`` stands beside. Time grows with the length of a page. Other columns stay; repeated rows
    are each returned; an empty table gives an empty result.
    """

    def run(sources: pa.Array) -> pa.Array:
        return pa.array(map(visible_text, sources.to_pylist()), pa.string())

    return pages.withColumn(text_col, F.arrow_udf(run, "string")(F.col(html_col).cast("string")))
