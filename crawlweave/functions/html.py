"""HTML as text: what is dropped, how it is cut into tokens, entities and attributes.

No look-around, no back-references, explicit white space. Cutting into tokens takes linear time on any page.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r" \t\r\n\f"

# Elements whose content is never text of the page, and elements that never belong to the article.
HIDDEN = ["script", "style", "noscript", "template", "svg", "iframe"]
CHROME = ["nav", "aside", "footer"]
# Elements whose content is no markup: without an end they reach to the end of the page.
RAW_TEXT = ["script", "style", "iframe"]

# Tags that end a block of text.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr",
    "html", "legend", "li", "link", "main", "menu", "meta", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul",
]

# The named entities of HTML that end in a semicolon, with their characters. A look-up in a map tries the names in turn, so
# the short ones, which pages hold most, come first.
ENTITIES = dict(sorted(((n[:-1], text) for n, text in html5.items() if n.endswith(";")), key=lambda x: (len(x[0]), x[0])))

# attributes with quoted values that may hold ">", any number of them: the possessive group is matched in a loop, not on
# the matcher's stack, and as a quote can't be passed otherwise it matches what the plain group would
_ATTRS = r"""[^\x22'>]*(?:(?:\x22[^\x22]*\x22|'[^']*')[^\x22'>]*)*+"""
TOKEN = rf"<[a-zA-Z/]{_ATTRS}>|<[a-zA-Z/][^>]*>|<![^>]*>|<\?[^>]*>|[^<]+|<"
ATTRIBUTE = rf"""[^{WS}=/\x22'>]+(?:[{WS}]*=[{WS}]*(?:\x22[^\x22]*\x22|'[^']*'|[^{WS}\x22'>]+))?"""
ENTITY_PIECE = r"&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"


def _elements(names: list[str]) -> str:
    """Elements with their content; of one that never ends only the start tag, unless its content isn't markup."""
    whole = "|".join(rf"{n}(?:[{WS}/][^>]*)?>.*?</{n}[^>]*>" for n in names)
    ends = {n: r".*\z" if n in RAW_TEXT else "" for n in names}
    return whole + "|" + "|".join(rf"{n}(?:[{WS}/][^>]*)?>{ends[n]}" for n in names)


# the common "<" comes first, so that the matcher tries the names at tags only
HIDDEN_PATTERN = rf"(?is)<(?:!--.*?(?:-->|\z)|svg(?:[{WS}/][^>]*)?/>|{_elements(HIDDEN)})"


def drop_hidden(html: Column) -> Column:
    """Without comments, scripts, styles and the like; an unclosed comment or script reaches to the end."""
    return F.regexp_replace(html, HIDDEN_PATTERN, "")


def open_end(html: Column) -> Column:
    """What begins with the first ``<`` behind the last ``>``: no tag ends there."""
    behind = F.substring_index(html, ">", -1)
    at = F.instr(behind, "<")
    return F.when(at > 0, F.substr(behind, at)).otherwise("")


def tokens(html: Column) -> Column:
    """Array of tags and texts; put together they give the input again.

    Linear in the length: behind the last ``>`` no tag is tried. Before it the plain pattern of a tag always ends at the next
    ``>``, and the pattern with quoted values can run to the end in vain three times at most: each quote swaps two of the
    states outside, in double and in single quotes, so a ``>`` in the state of the start follows unless it was its last one.
    """
    rest = F.length(html) - F.length(open_end(html))
    closed = F.regexp_extract_all(F.left(html, rest), F.lit(TOKEN), F.lit(0))
    return F.concat(closed, F.regexp_extract_all(open_end(html), F.lit("[^<]+|<"), F.lit(0)))


def is_tag(token: Column) -> Column:
    return token.rlike(r"\A<[a-zA-Z/]") & token.endswith(">")


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"\A</?([a-zA-Z][a-zA-Z0-9:\-]*)", 1))


def tag_attrs(token: Column) -> Column:
    return F.regexp_extract(token, r"(?s)\A</?[a-zA-Z][a-zA-Z0-9:\-]*(.*?)/?>\z", 1)


def attribute(attrs: Column, name: str) -> Column:
    """Decoded value of an attribute, null if it is missing or has no value."""
    pairs = F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), F.lit(0))
    named = F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, rf"\A([^{WS}=]+)", 1)) == name)
    value = F.regexp_extract(F.get(named, 0), rf"(?s)\A[^=]+=[{WS}]*(.*)\z", 1)
    return decode_entities(F.nullif(F.regexp_replace(value, r"(?s)\A[\x22'](.*)[\x22']\z", "$1"), F.lit("")))


def _from_code_point(n: Column) -> Column:
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    safe = F.when(valid, n).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _entity_map() -> Column:
    # a constant, folded once per plan; the two delimiters occur in no entity and no character above
    pairs = "\x02".join(f"&{name};\x03{text}" for name, text in ENTITIES.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x03"))


def decode_entities(text: Column) -> Column:
    """Each entity is decoded once, from left to right; unknown ones stay."""
    named = _entity_map()

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"\A&#[xX]?([0-9a-fA-F]+);\z", 1)
        base16 = piece.rlike(r"\A&#[xX]")
        point = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        return (
            F.when(~piece.startswith("&"), piece)
            .when(piece.startswith("&#") & (digits != ""), _from_code_point(point))
            .when(piece.endswith(";"), F.coalesce(F.try_element_at(named, piece), piece))
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(text, F.lit(ENTITY_PIECE), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", " ")


def word_count(text: Column) -> Column:
    # words are runs of anything but white space
    return F.regexp_count(text, F.lit(f"[^{WS}]+"))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")
