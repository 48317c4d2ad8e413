"""HTML to text by layout: a tree with implied tags, visibility rules, blocks and tables.

Pages are tokenised, built into a tree (optional end tags, void and raw-text elements, stray
end tags), and rendered as a browser without style sheets would lay them out: hidden parts
leave nothing, inline text runs together with white space collapsed, blocks stand on lines
of their own with blank lines around paragraphs, headings, lists and tables, list items get
markers and indentation, table cells are padded so that columns line up, and preformatted
text is kept. Nothing recurses with a page's depth: nested tables are laid out from the inside.
A table's lines are copied once for each table around it; all other work is linear in a page.
Spaces that align columns are bounded: a table in which they would be more than ``PADDING``
times its text has its widest columns aligned less far, and a cell that is wider than its
column pushes on what follows it. No text is ever left out.

Defined results: null and empty pages give empty text; bytes that are not UTF-8 become
replacement characters; unclosed comments and tags end with the page; equal pages give equal
texts, and every row, repeated or not, one text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe object audio video canvas noembed noframes source track param area rp".split())
#: Tags that show nothing inside the given element.
UNDISPLAYED = {
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tr ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tr".split()) | frozenset(("li", "dd", "dt"))
#: Start tag: open elements that it ends, and those that stop the search.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    **{x: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])) for x in ("thead", "tbody", "tfoot")},
}
SCOPE = frozenset("table td th caption template html".split())
PADDING, LEAST_PADDING = 8, 512
COLUMN_WIDTHS = (1 << 30, 120, 40, 12, 0)  # how far columns are aligned, until the spaces are few enough
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?""")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def tokens(page: str):
    """('text', s), ('start', tag, attrs, ended at once) and ('end', tag), in order."""
    at, end, foreign = 0, len(page), 0
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield ("text", page[at:])
            return
        if lt > at:
            yield ("text", page[at:lt])
        if page.startswith("<!--", lt):
            m = _COMMENT_END.search(page, lt + 4)
            if page.startswith((">", "->"), lt + 4):  # empty
                at = page.index(">", lt) + 1
            else:
                at = m.end() if m else end
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            after = page[lt + 1 : lt + 3]
            if after[:1].isalpha() or (after[:1] == "/" and after[1:].isalpha()):
                stop = page.find(">", lt)  # quotes that never close
                at = end if stop < 0 else stop + 1
            else:
                yield ("text", "<")
                at = lt + 1
            continue
        close, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
        at = m.end()
        if close:
            if tag in UNDISPLAYED and foreign:
                foreign -= 1
            yield ("end", tag)
            continue
        found = _ATTR.findall(rest) if rest.strip(" /") else []
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in found}
        # only svg and math know elements without an end tag; an unquoted value takes the slash
        single = (foreign > 0 or tag in UNDISPLAYED) and rest.endswith("/") and not (found and found[-1][3].endswith("/"))
        if tag in UNDISPLAYED and not single:
            foreign += 1
        yield ("start", tag, attrs, single)
        if tag in RAW and not single:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at) if tag != "plaintext" else None
            stop_at = stop.start() if stop else end
            if stop_at > at:
                yield ("text", page[at:stop_at])
            at = stop_at


def build(page: str) -> Node:
    """The page's tree, under a root of its own."""
    root = Node("#root", {})
    stack: list[Node | None] = [root]  # None: ended, but what is inside goes on
    places: defaultdict[str, list[int]] = defaultdict(list)  # where a tag's open elements stand in the stack
    blocks: list[int] = []

    def pop() -> None:
        tag = stack.pop().tag
        places[tag].pop()
        if tag in BLOCK:
            blocks.pop()
        while stack[-1] is None:
            stack.pop()

    def nearest(tags: frozenset) -> int:
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    def end_to(names: frozenset, stops: frozenset) -> None:
        """Close the elements up to the outermost of ``names`` above the nearest of ``stops``."""
        own = [places[x] for x in names if places.get(x)]
        if not own:
            return
        limit = nearest(stops)
        found = min((x[i] for x in own if (i := bisect(x, limit)) < len(x)), default=len(stack))
        while len(stack) > found:
            pop()

    def push(tag: str, attrs: dict, single: bool = False) -> None:
        if places.get("svg") and attrs:
            if attrs.get("display") == "none":
                attrs["hidden"] = ""
            if "visibility" in attrs:
                attrs["style"] = f"{attrs.get('style', '')};visibility:{attrs['visibility']}"
        if any(tag in inner and places.get(outer) for outer, inner in UNDISPLAYED.items()):
            attrs["hidden"] = ""
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID and not single:
            places[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)

    for token in tokens(page):
        kind = token[0]
        if kind == "text":
            raw = stack[-1].tag in RAW and stack[-1].tag not in ("textarea", "title")
            stack[-1].children.append(token[1] if raw or "&" not in token[1] else entities.unescape(token[1]))
        elif kind == "start":
            _, tag, attrs, single = token
            if tag in ("html", "body", "head") and places.get(tag):
                continue
            if tag == "image":
                tag = "img"
            if tag in ("body", "frameset") or (places.get("head") and tag in BLOCK and tag != "head"):
                end_to(frozenset(["head"]), frozenset())
            if tag in CLOSES_P:
                end_to(frozenset(["p"]), SCOPE)
            if tag in IMPLIED_ENDS:
                end_to(*IMPLIED_ENDS[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop()
            push(tag, attrs, single)
        else:
            tag = token[1]
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif places.get(tag):
                stops = frozenset() if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE
                at = places[tag][-1]
                if at < nearest(stops):
                    continue
                if tag in FORMATTING and blocks and blocks[-1] > at:
                    places[tag].pop()  # it ends, but the blocks inside it go on
                    stack[at] = None
                else:
                    while len(stack) > at:
                        pop()
    return root


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether a node takes part in the layout, and whether its own text shows."""
    a = node.attrs
    if node.tag in HIDDEN or (a and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"))):
        return False, False
    if node.tag == "dialog" and "open" not in a:
        return False, False
    style = a.get("style") if a else None
    if style:
        if _NONE.search(style):
            return False, False
        m = _VISIBILITY.search(style)
        if m:
            visible = m.group(1).lower() == "visible"
    return True, visible


class _Page:
    """Lines under construction: inline text gathers until a block ends it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = False
        self.first = ""  # what stands before the next line: a list marker
        self.indent = ""

    def text(self, s: str) -> None:
        self.run.append(s)

    def flush(self) -> None:
        if not self.run:
            return
        line = _SPACE.sub(" ", "".join(self.run)).strip(" ")
        self.run = []
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = self.indent
        if self.first:
            lead, self.first = self.indent[: -len(self.first)] + self.first, ""
        self.lines.append(lead + line)

    def space(self) -> None:
        self.gap = True


def render(root: Node) -> str:
    """The visible text below a node."""
    tables: list[tuple[Node, bool, bool]] = []  # outer ones first
    todo: list = [(c, True, False) for c in reversed(root.children)]
    while todo:
        node, seen, within = todo.pop()
        if isinstance(node, str):
            continue
        take, seen = _shown(node, seen)
        if not take:
            continue
        if node.tag == "table":
            tables.append((node, within, seen))
            within = True
        todo += [(c, seen, within) for c in reversed(node.children) if not isinstance(c, str)]
    for node, within, seen in reversed(tables):
        node.attrs["#lines"] = _table(node, within, seen)
    return _flow(root)


def _flow(root: Node, visible: bool = True) -> str:
    """The visible text below a node whose tables are laid out."""
    page = _Page()
    # (node or text, visible, in pre) to enter; a callable to leave
    todo: list = [(c, visible, False) for c in reversed(root.children)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, seen, pre = item
        if isinstance(node, str):
            if not seen:
                continue
            if pre and "\n" in node:
                head, *rest = node.split("\n")
                page.text(head.replace(" ", "\u00a0").replace("\t", "\u00a0" * 4))
                for line in rest:
                    line_now = "".join(page.run)
                    page.run = []
                    page.put(line_now.replace("\u00a0", " ").rstrip()) if line_now.strip("\u00a0 ") else page.lines.append("")
                    page.text(line.replace(" ", "\u00a0").replace("\t", "\u00a0" * 4))
            else:
                page.text(node.replace(" ", "\u00a0") if pre else node)
            continue
        take, seen = _shown(node, seen)
        if not take:
            continue
        tag = node.tag
        if tag == "br":
            if page.run:
                page.flush()
            elif page.lines and not page.gap:
                page.lines.append("")
            continue
        if tag == "wbr" or tag in VOID and tag not in ("hr", "input"):
            continue
        if tag == "input":
            if seen and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel") and node.attrs.get("value"):
                page.text(" " + node.attrs["value"] + " ")
            continue
        if tag == "hr":
            page.flush()
            page.space()
            continue
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options = [c for c in _below(node, "option")]
            chosen = [o for o in options if "selected" in o.attrs] or ([] if "multiple" in node.attrs else options[:1])
            page.text(" ")
            for o in chosen:
                for s in o.children:
                    if isinstance(s, str) and seen:
                        page.text(s + " ")
            continue
        if tag == "table":
            page.flush()
            page.space()
            for line in node.attrs.pop("#lines", ()):
                page.put(line)
            page.space()
            continue
        block = tag in BLOCK
        if block:
            page.flush()
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and page.indent):
                page.space()
        before = page.indent
        if tag in ("ul", "ol", "menu", "dir"):
            node.attrs["#next"] = _number(node.attrs.get("start"), 1) if tag == "ol" else 0
            node.attrs["#list"] = tag
        elif tag == "li":
            page.first = ""
            marker = "- "
            if node.attrs.get("#of") is not None:
                owner = node.attrs["#of"]
                value = _number(node.attrs.get("value"), owner.attrs["#next"])
                owner.attrs["#next"] = value + 1
                marker = f"{value}. "
            page.indent += " " * len(marker)
            page.first = marker
        elif tag in ("blockquote", "dd"):
            page.indent += "  "
        if tag == "ol":
            for c in children:
                if isinstance(c, Node) and c.tag == "li":
                    c.attrs["#of"] = node

        def leave(tag: str = tag, block: bool = block, before: str = before) -> None:
            if block:
                page.flush()
                if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and before):
                    page.space()
                if tag == "li":
                    page.first = ""
                page.indent = before

        if tag == "q":
            page.text("“")
            todo.append(lambda: page.text("”"))
        elif tag in ("td", "th", "button", "label", "mtd"):
            page.text(" ")
        elif tag == "text":  # of svg: has a place of its own
            page.text(" ")
            todo.append(lambda: page.text(" "))
        todo.append(leave)
        todo += [(c, seen, pre or tag in ("pre", "textarea", "xmp", "plaintext")) for c in reversed(children)]
    page.flush()
    return "\n".join(x.replace("\u00a0", " ").rstrip() for x in page.lines).strip("\n")


def _number(s: str | None, other: int) -> int:
    return int(s) if s and re.fullmatch(r"-?\d{1,9}", s.strip()) else other


def _below(node: Node, tag: str):
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            if n.tag == tag:
                yield n
            else:
                todo += reversed(n.children)


def _table(table: Node, within: bool, visible: bool) -> list[str]:
    """A table's caption and rows; the cells of a column start in one place.

    A row is as high as its tallest cell. The columns of a table within another stand closer.
    """
    rows: list[dict[int, list[str]]] = []  # lines by column
    lines: list[str] = []
    busy: dict[int, int] = {}  # column: the first row that cells from above leave free
    at = 0
    todo: list = [(c, visible) for c in reversed(table.children)]
    while todo:
        node, seen = todo.pop()
        if node is None:  # no cell reaches over the end of a row group
            busy.clear()
            continue
        if isinstance(node, str):
            if seen and node.strip():
                lines.append(_SPACE.sub(" ", node).strip())
            continue
        take, seen = _shown(node, seen)
        if not take or node.tag in ("colgroup", "col"):
            continue
        if node.tag == "tr":
            cells, column = {}, 0
            for cell in node.children:
                wide = high = 1
                if isinstance(cell, str):
                    if not seen or not cell.strip():
                        continue
                    inner = _SPACE.sub(" ", cell).strip()
                else:
                    take, shows = _shown(cell, seen)
                    if not take:
                        continue
                    inner = _flow(cell, shows)
                    wide = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000)
                    high = _number(cell.attrs.get("rowspan"), 1)
                    high = 65534 if high == 0 else min(max(high, 1), 65534)  # 0: to the end of the row group
                while busy.get(column, 0) > at:
                    column += 1
                if inner:
                    cells[column] = inner.split("\n")
                if high > 1:
                    busy.update(dict.fromkeys(range(column, column + wide), at + high))
                column += wide
            at += 1
            if cells:
                rows.append(cells)
        elif node.tag in ("thead", "tbody", "tfoot"):
            todo += [(None, seen), *[(c, seen) for c in reversed(node.children)], (None, seen)]
        else:
            inner = _flow(node, seen)
            if inner:
                lines += inner.split("\n")
    return lines + _aligned(rows, 1 if within else 2)


def _aligned(rows: list[dict[int, list[str]]], gap: int) -> list[str]:
    """Rows of cells (lines by column) as lines, aligned as far as the bound on spaces allows."""
    width: dict[int, int] = {}
    for r in rows:
        for i, cell in r.items():
            width[i] = max(width.get(i, 0), *map(len, cell))
    columns = sorted(width)
    ink = sum(len(line) - line.count(" ") for r in rows for cell in r.values() for line in cell)
    out: list[str] = []
    for most in COLUMN_WIDTHS:
        used, start = 0, {}
        for i in columns:
            start[i] = used + gap * i if most else 0
            used += min(width[i], most)
        out, spaces = [], 0
        for r in rows:
            own = [""] * max(map(len, r.values()))
            for i in sorted(r):
                for j, line in enumerate(r[i]):
                    if line:
                        at = max(start[i], len(own[j]) + gap if own[j] else 0)
                        spaces += at - len(own[j])
                        own[j] = own[j].ljust(at) + line
                if most and spaces > PADDING * ink + LEAST_PADDING:
                    break
            else:
                out += own
                continue
            break
        else:
            return out
    return out


def extract(page: str) -> str:
    return render(build(page))


def text_column(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text): the visible text of every whole page."""

    def make():
        return lambda raw: [pa.array([extract(x.decode("utf-8", "replace")) for x in raw], pa.string())]

    return map_texts(pages, id_col, html_col, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string", make)
