"""Layout-aware rendering of HTML pages to their visible text.

A tree builder reads tags one by one: void elements hold nothing, start tags imply the end of what can't contain them (a
paragraph before a block, list items, cells, rows, options, terms), end tags close up to their element and stray ones are
ignored. Rendering walks the tree once. Hidden are head, script, style, template and svg content, `hidden` elements, `display:none` and
`visibility:hidden` styles, hidden inputs, and closed details but for their summary. Formulas are inline text without their annotations;
the parts of fractions, roots and tables in them stand apart. White space collapses as in a browser, but for pre and textarea. Blocks start lines, and blocks with margins (paragraphs, headings, lists, tables, quotes)
have a blank line around them; list items carry a dash or their number and an indent; table cells are padded to columns.

Defined results: null, empty and text-free pages give an empty string; open elements end with the page; character references
without a meaning stay as they are; nesting beyond `DEEPEST` elements is read as siblings, so no text is lost; equal pages
give equal texts; an empty table gives an empty result. Only the html column is read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEEPEST = 200

# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg datalist title link meta base".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr fieldset".split())
BLOCK = MARGIN | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li listing main nav optgroup option search section summary tbody thead tfoot tr td th caption".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup tbody thead tfoot tr td th caption legend".split())
#: Start tag -> (elements whose end it implies, elements that shield those outside them).
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("table tr".split())), "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])), "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])), "body": (frozenset(["head"]), frozenset()),
}
_SHIELDS_P = frozenset("button td th caption table object template".split())
_CELLS = frozenset("table td th caption".split())

#: MathML elements; those that hold text; those never shown; those whose parts lie in two dimensions.
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction".split())
MATH_TEXT = frozenset("mi mn mo ms mtext".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
MATH_APART = frozenset("mfrac mroot mtable mtr mlabeledtr".split())

# A quote opens a value only directly behind an equals sign; anywhere else it is an ordinary character.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/(?!>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=)))*+)(/?)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?")
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str) -> dict:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def build(page: str) -> Node:
    """The tree of a page; text nodes are strings with their references resolved."""
    root = Node("#root", {})
    stack, at = [root], 0

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    def close(names: frozenset, shields: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in shields:
                return
            if tag in names:
                del stack[i:]  # and on: a row ends with its cell

    while (m := _TAG.search(page, at)) is not None:
        add_text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add_text(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _CELLS and tag not in BLOCK:  # inline ends don't reach out of a cell
                    break
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), _SHIELDS_P)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif stack[-1].tag == "head" and tag not in UNSEEN:
            stack.pop()
        node = Node(tag, _attributes(m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(inside) if tag == "textarea" else inside)
            at = end.end() if end else len(page)
        elif tag not in VOID and len(stack) < DEEPEST and not (m[4] and (tag in ("svg", "math", "path") or any(n.tag in ("svg", "math") for n in stack))):
            stack.append(node)
    add_text(page[at:])
    return root


def hidden(node: Node) -> bool:
    own = node.attributes
    if node.tag in UNSEEN:
        return True
    return bool(own) and ("hidden" in own or "style" in own and _NO_SHOW.search(own["style"]) is not None)


class Lines:
    """Lines of text under construction; `gap` is how many line ends stand between what was and what comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.current, self.gap, self.space, self.indent, self.marker = "", 0, False, "", ""

    def break_to(self, ends: int) -> None:
        if self.current:
            self.lines.append(self.current.rstrip(" "))
            self.current = ""
        self.space = False
        if self.lines:
            self.gap = max(self.gap, ends)

    def _begin(self) -> None:
        if not self.current:
            self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            self.current = self.marker or self.indent
            if self.marker:
                self.marker = ""

    def flow(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        begun = bool(self.current)
        self._begin()
        if begun and (self.space or words[0] == " ") and not self.current.endswith(" "):
            self.current += " "
        self.current += words.strip(" ")
        self.space = words[-1] == " "

    def line_end(self) -> None:
        if self.current:
            self.break_to(1)
        elif self.lines:
            self.gap += 1
        self.space = False

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self._begin()
            self.current += first
        for line in rest:
            self.line_end()
            if line:
                self._begin()
                self.current += line

    def block(self, lines: list[str]) -> None:
        for line in lines:
            if line:
                self._begin()
                self.current += line
                self.break_to(1)
            elif self.lines:  # an empty line is one more line end
                self.gap += 1

    def done(self) -> list[str]:
        self.break_to(0)
        return self.lines


def _walk(node: Node, out: Lines, pre: bool, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.verbatim(child) if pre else out.flow(child)
            continue
        tag = child.tag
        if hidden(child) or node.tag == "details" and "open" not in node.attributes and tag != "summary":
            continue
        if tag == "br":
            out.line_end()
        elif tag == "input":
            if child.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                out.flow(child.attributes.get("value", ""))
        elif tag == "math":
            ends = int(child.attributes.get("display", "").lower() == "block")
            if ends:
                out.break_to(1)
            _math(child, out, depth)
            if ends:
                out.break_to(1)
        elif tag == "table":
            out.break_to(2)
            out.block(table_lines(child))
            out.break_to(2)
        elif tag in ("ul", "ol", "menu"):
            ends = 2 if depth == 0 else 1
            out.break_to(ends)
            _list(child, out, pre, depth)
            out.break_to(ends)
        elif tag in BLOCK:
            ends = 2 if tag in MARGIN else 1
            out.break_to(ends)
            if tag == "dd" or tag == "blockquote":
                own, out.indent = out.indent, out.indent + "  "
                _walk(child, out, pre, depth)
                out.break_to(ends)
                out.indent = own
            else:
                _closed_details(child, out, pre or tag in ("pre", "textarea", "listing"), depth)
            out.break_to(ends)
        else:
            _walk(child, out, pre or tag in ("textarea", "xmp"), depth)


def _math(node: Node, out: Lines, depth: int) -> None:
    """A formula as inline text; white space between its elements is layout of the source."""
    last = len(node.children) - 1
    for i, child in enumerate(node.children):
        if isinstance(child, str):
            if i == 0 or node.tag not in MATH_TEXT:
                child = child.lstrip(" \t\n\r\f")
            out.flow(child.rstrip(" \t\n\r\f") if i == last or node.tag not in MATH_TEXT else child)
        elif hidden(child) or child.tag in MATH_UNSEEN:
            continue
        elif child.tag in MATH and node.tag not in MATH_TEXT:
            apart = node.tag in MATH_APART or child.tag in MATH_APART
            if apart:
                out.flow(" ")
            _math(child, out, depth)
            if apart:
                out.flow(" ")
        else:
            part = Node("#part", {})
            part.children = [child]
            _walk(part, out, False, depth)


def _closed_details(node: Node, out: Lines, pre: bool, depth: int) -> None:
    if node.tag == "details" and "open" not in node.attributes:
        part = Node("#summary", {})
        part.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        node = part
    _walk(node, out, pre, depth)


def _number(text: str, other: int) -> int:
    text = text.strip()
    return int(text) if re.fullmatch(r"[+-]?[0-9]{1,9}", text, re.A) else other


def _list(node: Node, out: Lines, pre: bool, depth: int) -> None:
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and not hidden(c)]
    step = -1 if "reversed" in node.attributes else 1
    number = _number(node.attributes.get("start", ""), len(items) if step < 0 else 1)
    indent = out.indent
    for child in node.children:
        if not (isinstance(child, Node) and child.tag == "li"):
            part = Node("#part", {})
            part.children = [child]
            _walk(part, out, pre, depth + 1)
            continue
        if hidden(child):
            continue
        number = _number(child.attributes.get("value", ""), number) if node.tag == "ol" else number
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += step
        out.break_to(1)
        out.marker, out.indent = indent + mark, indent + " " * len(mark)
        _walk(child, out, pre, depth + 1)
        out.break_to(1)
        out.marker, out.indent = "", indent


def _rows(node: Node, found: list, captions: list) -> None:
    for child in node.children:
        if isinstance(child, str) or hidden(child):
            if isinstance(child, str) and child.strip():
                captions.append(child)
        elif child.tag == "tr":
            found.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)])
            captions.extend(c for c in child.children if isinstance(c, str) and c.strip() or isinstance(c, Node) and c.tag not in ("td", "th"))
        elif child.tag in ("tbody", "thead", "tfoot"):
            _rows(child, found, captions)
        elif child.tag in ("td", "th"):
            found.append([child])
        else:
            captions.append(child)


def table_lines(node: Node) -> list[str]:
    """Caption and stray content first, then rows with their cells padded to the width of the column, two blanks apart."""
    rows, above = [], []
    _rows(node, rows, above)
    part = Node("#part", {})
    part.children = above
    lines = rendered(part)
    cells = [[(rendered(c), min(max(_number(c.attributes.get("colspan", ""), 1), 1), 1000)) for c in row] for row in rows]
    widths: dict[int, int] = {}
    for row in cells:
        at = 0
        for text, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, text), default=0))
            at += span
    for row in cells:
        columns, at = [], 0
        for text, span in row:
            columns.append((text, sum(widths.get(i, 0) for i in range(at, at + span)) + 2 * (span - 1)))
            at += span
        for i in range(max((len(t) for t, _ in columns), default=0)):
            lines.append("  ".join((t[i] if i < len(t) else "").ljust(w) for t, w in columns).rstrip(" "))
    return lines


def rendered(node: Node) -> list[str]:
    out = Lines()
    _walk(node, out, False, 0)
    return out.done()


def visible_text(page: str | None) -> str:
    return "\n".join(rendered(build(page))) if page else ""


def visible_texts(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of `column` in a further column `out`, page by page, without a shuffle."""

    @F.arrow_udf("string")
    def render(page: pa.Array) -> pa.Array:
        return pa.array([visible_text(p) for p in page.to_pylist()], pa.string())

    return pages.withColumn(out, render(F.col(column).cast("string")))


def text_report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, text, n_chars, n_lines."""
    df = visible_texts(pages.select("page_id", "html"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    return df.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"), lines.alias("n_lines"))
