"""HTML extraction: a tree of elements, then layout-aware rendering of all visible text.

The tree builder knows void elements, raw-text elements and implied end tags (paragraphs, list items,
table rows and cells, options, definitions); an end tag without its start is dropped, and what a document
leaves open is closed at its end. Hidden are head, script, style, template and the other elements of
``_HIDDEN``, the ``hidden`` attribute, ``display:none``, ``visibility:hidden`` and hidden inputs. Of an svg its
text elements are shown, of math all but annotations, of a select the shown option (of a list box all), of an
input its value where browsers show it.

Rendering collapses white space, starts blocks on lines of their own (with a blank line around paragraphs,
headings, lists and tables), marks list items and indents nested lists, aligns the cells of a table by the
width of its columns, and keeps preformatted text as it is.

Defined results: null or empty HTML gives the empty text; null ids are kept; repeated rows are rendered
each; an empty table gives no rows; other columns are ignored. Nesting is bounded by nothing: no recursion.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_HIDDEN = frozenset("head script style template noscript title datalist iframe object audio video canvas noembed noframes annotation annotation-xml".split())
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
_BLOCK = _SPACED | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr legend li main menu nav section summary caption tr thead tbody tfoot option optgroup".split())
#: Inputs whose value isn't shown as text.
_NO_VALUE = frozenset("hidden password checkbox radio range color file image".split())
_UNDRAWN = frozenset("defs symbol clippath mask marker pattern metadata desc".split())
_TOKENS = frozenset("mi mn mo mtext ms".split())
#: An open element (key) that the start of any of these (value) ends.
_PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt td th tr".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE_PARTS = frozenset("td th tr tbody thead tfoot table body html".split())
_SCOPE = frozenset("table td th caption button object html".split())

#: What may begin a tag, and what ends one or begins a quoted value in it.
_OPEN = re.compile(r"<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def attribute(self, name: str) -> str | None:
        """The value of an attribute, '' where it has none."""
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return entities.unescape(m[2] or m[3] or m[4] or "")
        return None


def _tags(text: str, at: int = 0):
    """(start, end, closing, name, attributes) of each tag from ``at`` on, name None for comments and declarations; ``send`` moves on.

    A quoted value may hold '>'. Where a quote is never closed, values in quotes aren't heeded from there on, so
    that no text is looked through again and again; without a '>' to come, what is left is text.
    """
    quoted, last = True, text.rfind(">")
    while m := _OPEN.search(text, at):
        start, at = m.start(), m.end()
        if m[2] is None:
            end = text.find("-->" if m[0] == "<!--" else ">", at)
            end = len(text) if end < 0 else end + (3 if m[0] == "<!--" else 1)
        else:
            if at > last:
                return
            end = at
            while quoted:
                stop = _STOP.search(text, end)
                if stop and stop[0] == ">":
                    end = stop.end()
                    break
                end = text.find(stop[0], stop.end()) + 1 if stop else 0
                quoted = end > 0
            if not quoted:
                end = text.find(">", at) + 1
        at = (yield start, end, m[1], m[2], text[m.end() : end - 1] if m[2] else "") or end


class _Open:
    """The open elements, with the places of each name, so that none is looked for along the whole stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, names) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def cut(self, k: int) -> None:
        """Close what stands at place k and above."""
        for node in self.stack[k:]:
            self.places[node.name].pop()
        del self.stack[k:]

    def close(self, name: str) -> None:
        """An end tag: of an element outside the cell or table at hand only where that is its business."""
        k = self.last((name,))
        if k and (name in _TABLE_PARTS or k >= self.last(("td", "th", "table"))):
            self.cut(k)

    def end(self, names, within) -> None:
        """Close the outermost of the open elements named, looking no further than ``within``."""
        k = self.last(names)
        if k > self.last(within):
            while k > 1 and self.stack[k - 1].name in names and self.stack[k - 1].name not in within:
                k -= 1
            self.cut(k)


def parse(text: str) -> Node:
    """The tree of a document; children are nodes and strings."""
    root = Node("#root")
    open_, at, tags, move = _Open(root), 0, _tags(text), None
    while True:
        try:
            start, end, closing, name, attributes = tags.send(move)
        except StopIteration:
            break
        move, top = None, open_.stack
        if start > at:
            top[-1].children.append(entities.unescape(text[at:start]))
        at = end
        if name is None:
            continue
        name = name.lower()
        if closing:
            open_.close(name)
            continue
        if name in _PARAGRAPH_ENDS:
            open_.end(("p",), _SCOPE)
        if name in _ENDS:
            open_.end(*_ENDS[name])
        if name in _HEADINGS and top[-1].name in _HEADINGS or name == "body" and top[-1].name == "head":
            open_.cut(len(top) - 1)
        node = Node(name, attributes)
        top[-1].children.append(node)
        if name in _VOID or attributes.endswith("/") and open_.last(("svg", "math")):
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
            body = text[at : stop.start() if stop else len(text)]
            node.children.append(entities.unescape(body) if name in ("textarea", "title") else body)
            at = move = stop.end() if stop else len(text)
            continue
        open_.push(node)
    if at < len(text):
        open_.stack[-1].children.append(entities.unescape(text[at:]))
    return root


def hidden(node: Node) -> bool:
    if node.name in _HIDDEN:
        return True
    if not node.attributes:
        return False
    low = node.attributes.lower()
    if "hidden" in low and (node.attribute("hidden") is not None or node.name == "input" and (node.attribute("type") or "").lower() == "hidden"):
        return True
    return "style" in low and bool(_UNSEEN.search(node.attribute("style") or ""))


def _inside(node: Node, names, skip=frozenset()) -> list[Node]:
    """The visible elements of these names, in order, the outermost ones only."""
    out, stack = [], list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str) or n.name in skip or hidden(n) or (n.attribute("display") if n.attributes else None) == "none":
            continue
        if n.name in names:
            out.append(n)
        else:
            stack.extend(reversed(n.children))
    return out


def _list_box(node: Node) -> bool:
    size = node.attribute("size") or ""
    return node.attribute("multiple") is not None or size.isdecimal() and int(size) > 1


def _shown_option(node: Node) -> list[Node]:
    """The option that a drop-down shows: the last one selected, else the first that isn't disabled."""
    options = [(o, g.name == "optgroup" and g.attribute("disabled") is not None) for g in _inside(node, ("option", "optgroup")) for o in ([g] if g.name == "option" else _inside(g, ("option",)))]
    chosen = [o for o, _ in options if o.attribute("selected") is not None]
    return chosen[-1:] or [o for o, off in options if not off and o.attribute("disabled") is None][:1]


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Page:
    """Lines under construction. ``gap``: 0 same line, 1 new line, 2 blank line before what comes next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.indent, self.mark = [], 0, False, "", None

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def begin(self) -> None:
        if not self.line:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent if self.mark is None else self.mark)
            self.mark = None

    def text(self, s: str) -> None:
        words = _SPACE.split(s)
        if len(words) == 1:
            lead = trail = False
        else:
            lead, trail = not words[0], not words[-1]
            words = [w for w in words if w]
        if not words or words == [""]:
            self.space = self.space or lead or trail
            return
        fresh = not self.line
        self.begin()
        if (lead or self.space) and not fresh:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = trail

    def verbatim(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                self.begin()
                self.lines.append("".join(self.line))
                self.line = []
            if part:
                self.begin()
                self.line.append(part)

    def done(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def render(root: Node) -> str:
    """All visible text of a tree."""
    page, tables = _Page(), []
    # entries: a child to enter, or a function to call on the way out
    stack: list = [root]
    pre, lists = 0, []
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            page.verbatim(item) if pre else page.text(item)
            continue
        if isinstance(item, tuple):
            what, name, held = item
            if what == "block":
                page.block(2 if name in _SPACED and not (name in ("ul", "ol") and lists) else 1)
            elif what == "list":
                lists.pop()
                page.indent = held
                page.block(1 if lists else 2)
            elif what == "item":
                page.flush()
                page.indent, page.mark = held, None
            elif what == "pre":
                pre -= 1
                page.block(2)
            elif what == "cell":
                cell = page.done().replace("\n", " ").strip()
                page = held
                if tables:
                    tables[-1][-1].append(_SPACE.sub(" ", cell))
            elif what == "table":
                rows = [r for r in tables.pop() if any(r)]
                page.block(2)
                wide = [max((_width(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows), default=0))]
                for r in rows:
                    page.block(1)
                    page.begin()
                    page.line.append("  ".join(c + " " * (wide[k] - _width(c)) if k < len(r) - 1 else c for k, c in enumerate(r)))
                page.block(2)
            continue
        name = item.name
        if hidden(item):
            continue
        if name == "br":
            page.begin()
            page.flush()
            continue
        if name == "hr":
            page.block(1)
            continue
        if name == "img":
            alt = item.attribute("alt")
            if alt:
                page.text(f" {alt} ")
            continue
        if name == "input":
            kind = (item.attribute("type") or "text").lower()
            shown = item.attribute("alt") if kind == "image" else None if kind in _NO_VALUE else item.attribute("value")
            if shown:
                page.text(f" {shown} ")
            continue
        if name == "svg":
            for n in reversed(_inside(item, ("text", "foreignobject"), _UNDRAWN)):
                stack += [" ", *reversed(n.children), " "]
            continue
        if name in _TOKENS:
            stack += [" ", *reversed(item.children), " "]
            continue
        if name == "select" and not _list_box(item):
            for n in _shown_option(item):
                stack += [" ", *([n.attribute("label")] if n.attribute("label") else reversed(n.children)), " "]
            continue
        if name in ("option", "optgroup") and item.attributes and item.attribute("label"):
            page.block(1)
            page.text(item.attribute("label"))
            page.block(1)
            if name == "option":
                continue
        if name in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            stack.append(("cell", name, page))
            page = _Page()
        elif name == "tr" and tables:
            tables[-1].append([])
        elif name == "table":
            stack.append(("table", name, None))
            tables.append([])
        elif name in ("ul", "ol", "menu"):
            page.block(1 if lists else 2)
            start = item.attribute("start") if name == "ol" and item.attributes else None
            lists.append([name, int(start) if start and start.lstrip("-").isdigit() else 1])
            stack.append(("list", name, page.indent))
        elif name == "li":
            page.block(1)
            sign = "- "
            if lists and lists[-1][0] == "ol":
                sign, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
            stack.append(("item", name, page.indent))
            page.mark = page.indent + sign
            page.indent += " " * len(sign)
        elif name == "pre":
            page.block(2)
            stack.append(("pre", name, None))
            pre += 1
        elif name in _BLOCK:
            page.block(2 if name in _SPACED else 1)
            stack.append(("block", name, None))
        stack.extend(reversed(item.children))
    return page.done()


def text_of(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every page."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(h) for h in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(work, "page_id long, text string")
