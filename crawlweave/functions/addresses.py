"""Private and reserved address test, in plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
# eight groups, or fewer around one "::"; a dotted tail has been rewritten before
IPV6 = (
    r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}"
    r"|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)\z"
)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` worked out once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _octets(text: str) -> str:
    return f"transform(split({text}, r'\\.'), p -> try_cast(p as int))"


_PRIVATE_V4 = (
    "get(o, 0) in (0, 10, 127) or (get(o, 0) = 172 and get(o, 1) between 16 and 31)"
    " or (get(o, 0) = 192 and get(o, 1) = 168) or (get(o, 0) = 169 and get(o, 1) = 254) or get(o, 0) >= 224"
)


def _hex_pair(high: int) -> str:
    return f"lower(hex(get(o, {high}) * 256 + get(o, {high + 1})))"


def _ints(side: str) -> str:
    return f"transform(filter(split({side}, ':'), p -> p <> ''), p -> try_cast(conv(substring(p, 1, 4), 16, 10) as int))"


# a dotted tail as two hex groups
_HEXED = (
    f"case when contains(t, '.') and regexp_extract(t, r'([0-9.]+)\\z', 1) rlike r'{IPV4}' then "
    + _let(_octets(r"regexp_extract(t, r'([0-9.]+)\z', 1)"), "o",
           f"concat(regexp_replace(t, r'[0-9.]+\\z', ''), {_hex_pair(0)}, ':', {_hex_pair(2)})")
    + " else t end"
)
# eight ints, with "::" filled up by zeros; null if the text is no address
_GROUPS = f"case when h rlike r'{IPV6}' then " + _let(
    f"named_struct('l', {_ints("get(split(h, '::'), 0)")}, 'r', case when contains(h, '::') then "
    f"{_ints("substring_index(h, '::', -1)")} else cast(array() as array<int>) end)",
    "s", "concat(s.l, array_repeat(0, greatest(0, 8 - size(s.l) - size(s.r))), s.r)",
) + " end"
_PRIVATE_V6 = (
    "case when size(g) <> 8 then null"
    " when concat_ws(':', slice(g, 1, 6)) = '0:0:0:0:0:65535' then "
    + _let("array(shiftright(get(g, 6), 8), get(g, 6) & 255, shiftright(get(g, 7), 8), get(g, 7) & 255)", "o", _PRIVATE_V4)
    + " else concat_ws(':', g) = '0:0:0:0:0:0:0:1' or (get(g, 0) & 65024) = 64512"  # fc00::/7
    " or (get(g, 0) & 65472) = 65152 or get(g, 0) >= 65280 end"  # fe80::/10, ff00::/8
)


def ip_is_private(column: str) -> Column:
    """True for loopback, private, link-local, multicast, 0/8 and 240/4; null if not an address.

    ``::``, 100.64/10 and 192.0.2/24 count as public, as in the policy this follows.
    """
    v6 = _let(_let(_HEXED, "h", _GROUPS), "g", _PRIVATE_V6)
    judged = (
        f"case when t rlike r'{IPV4}' then {_let(_octets('t'), 'o', _PRIVATE_V4)} when contains(t, ':') then {v6} end"
    )
    # a zone, as in fe80::1%eth0, and a dot that ends a name don't change the address
    return F.expr(_let(f"regexp_replace(lower(trim({column})), '(?:%.*|[.])$', '')", "t", judged))


def is_ip_literal(host: Column) -> Column:
    return host.rlike(IPV4) | host.contains(":")
