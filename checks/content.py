"""Queries on page content: tokens, blocks, regions, markdown, images in the text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from checks.inputs import HOST_OF, oracle, table
from crawlweave.functions.html import BLOCK_TAGS, decode_entities
from crawlweave.functions.urls import filename_from_url
from crawlweave.operators import extract, markdown


def _hosted_blocks(s, d):
    blocks = extract.page_blocks(extract.page_tokens(table(s, d, "pages")))
    hosts = table(s, d, "pages").selectExpr("page_id", f"{HOST_OF} as host")
    return blocks.select("page_id", "block_no", "text").join(hosts, "page_id")


def _both_contents(s, d):
    regions = extract.main_region(table(s, d, "pages"))
    return regions.select("page_id", "content").join(markdown.to_markdown(regions), "page_id")


QUERIES = {
    "page_tokens": lambda s, d: extract.page_tokens(table(s, d, "rich_pages")),
    "page_title": lambda s, d: extract.page_title(table(s, d, "region_pages")),
    "main_region": lambda s, d: extract.main_region(table(s, d, "region_pages")),
    "page_blocks": lambda s, d: extract.page_blocks(extract.page_tokens(table(s, d, "region_pages"))),
    "content_blocks": lambda s, d: extract.content_blocks(extract.page_blocks(extract.page_tokens(table(s, d, "pages")))),
    "host_boilerplate": lambda s, d: extract.host_boilerplate(_hosted_blocks(s, d), 2, 10),
    "decode_entities": lambda s, d: table(s, d, "rich_pages").select(
        "page_id", decode_entities(F.concat("html", F.lit(" &#38;lt; &amp;lt; &#xD800; &#0; &nbsp;&hellip; &Eacute;&alpha;&ensp;&NotEqualTilde; &#128512;"))).alias("text")),
    "to_markdown": lambda s, d: markdown.to_markdown(extract.main_region(table(s, d, "rich_pages"))),
    "extract_pages": lambda s, d: extract.extract_pages(table(s, d, "region_pages")).withColumn("images", F.size("images").cast("bigint")),
    "raw_content": lambda s, d: extract.raw_content(
        table(s, d, "requests").select("request_id", "page_id", "raw"), _both_contents(s, d)),
    "image_refs": lambda s, d: extract.image_refs(extract.main_region(table(s, d, "image_pages")).select("page_id", "content")),
    "filename_from_url": lambda s, d: table(s, d, "guard_urls").withColumn("filename", filename_from_url(F.col("url"))),
}


def q(text: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


WS = r" \t\r\n\f"
_TAG = r"(regexp_matches(raw, '\A<[a-zA-Z/]') and raw like '%>')"
_NAME = r"lower(regexp_extract(raw, '\A</?([a-zA-Z][a-zA-Z0-9:\-]*)', 1))"
_ATTRS = r"regexp_extract(raw, '(?s)\A</?[a-zA-Z][a-zA-Z0-9:\-]*(.*?)/?>\z', 1)"
# the patterns of the SQL side, written for its own matcher
_VALUE = r"""\x22[^\x22]*\x22|'[^']*'"""
TOKEN = rf"<[a-zA-Z/][^\x22'>]*(?:(?:{_VALUE})[^\x22'>]*)*>|<[a-zA-Z/][^>]*>|<![^>]*>|<\?[^>]*>|[^<]+|<"
ATTRIBUTE = rf"[^ \t\r\n\f=/\x22'>]+(?:[ \t\r\n\f]*=[ \t\r\n\f]*(?:{_VALUE}|[^ \t\r\n\f\x22'>]+))?"
ENTITY_PIECE = "&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"


def _part(name: str, content: str) -> str:
    return rf"{name}(?:[ \t\r\n\f/][^>]*)?>{content}"


_UNSEEN, _RAW, _AROUND = ["script", "style", "noscript", "template", "svg", "iframe"], ["script", "style", "iframe"], ["nav", "aside", "footer"]
HIDDEN_PATTERN = "(?is)<(?:" + "|".join(
    [r"!--.*?(?:-->|\z)", r"svg(?:[ \t\r\n\f/][^>]*)?/>", *[_part(n, f".*?</{n}[^>]*>") for n in _UNSEEN], *[_part(n, r".*\z" if n in _RAW else "") for n in _UNSEEN]]
) + ")"
_BLOCKS = "(" + ", ".join(q(t) for t in BLOCK_TAGS) + ")"


def drop_hidden(x: str) -> str:
    return f"regexp_replace({x}, {q(HIDDEN_PATTERN)}, '', 'g')"


def chrome_ctes(to: str, source: str, column: str) -> list[tuple[str, str]]:
    """CTEs ending in ``to`` (page_id, bare): the column without navigation, asides and footers, by depth over the rows of their tags."""
    tag = q(f"(?i)</?(?:{'|'.join(_AROUND)})(?:[{WS}/][^>]*)?>")
    step = lambda n: f"case when lower(regexp_extract(tag, '([a-zA-Z]+)')) <> '{n}' then 0 when tag like '</%' then -1 when tag like '%/>' then 0 else 1 end"
    each = lambda make: ", ".join(make(n) for n in _AROUND)
    order = "over (partition by page_id order by idx"
    return [
        (f"{to}_cut", f"""select page_id, idx, gaps[idx + 1] as gap, case when idx > 0 then tags[idx] else '<>' end as tag from (select page_id, gaps, tags, unnest(range(len(gaps))) as idx
            from (select page_id, regexp_split_to_array({column}, {tag}) as gaps, regexp_extract_all({column}, {tag}) as tags from {source}))"""),
        (f"{to}_sum", f"select page_id, idx, gap, {each(lambda n: f'sum({step(n)}) {order}) as {n}')} from {to}_cut"),
        (f"{to}_deep", f"select page_id, idx, gap, {each(lambda n: f'{n} - least(0, min({n}) {order})) as {n}')} from {to}_sum"),
        (f"{to}_out", f"select page_id, idx, gap, {' and '.join(f'{n} = min({n}) {order} rows between current row and unbounded following)' for n in _AROUND)} as outside from {to}_deep"),
        (to, f"select page_id, string_agg(case when outside then gap else '' end, '' order by idx) as bare from {to}_out group by page_id"),
    ]


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def blank(x: str) -> str:
    return f"not regexp_matches({x}, '[^{WS}]')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def text_words(x: str) -> str:
    return words(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")


def decode(x: str) -> str:
    names = ", ".join(f"'&{n}': " + " || ".join(f"chr({ord(c)})" for c in text) for n, text in html5.items() if n.endswith(";"))
    point = ("case when lower(substr(p, 3, 1)) = 'x' then try_cast('0x' || substr(p, 4, length(p) - 4) as int) "
             "else try_cast(substr(p, 3, length(p) - 3) as int) end")
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {q(ENTITY_PIECE)}), lambda p: "
            f"case when regexp_full_match(p, '&#[xX]?[0-9a-fA-F]+;') then "
            f"chr(list_transform([{point}], lambda n: case when n between 1 and 1114111 and n not between 55296 and 57343 then n else 65533 end)[1]) "
            f"else coalesce(map {{{names}}}[p], p) end), '')")


def attribute(attrs: str, name: str) -> str:
    value = (f"regexp_extract(list_filter(regexp_extract_all({attrs}, {q(ATTRIBUTE)}), "
             f"lambda a: lower(regexp_extract(a, '\\A([^{WS}=]+)', 1)) = '{name}')[1], '(?s)\\A[^=]+=[{WS}]*(.*)\\z', 1)")
    bare = f"regexp_replace({value}, '(?s)\\A[\\x22''](.*)[\\x22'']\\z', '\\1')"
    return f"(select {decode('v')} from (select nullif({bare}, '') as v))"


def attribute_flat(attrs: str, name: str) -> str:
    """As above without a subquery, for use inside lambdas."""
    value = (f"regexp_extract(list_filter(regexp_extract_all({attrs}, {q(ATTRIBUTE)}), "
             f"lambda a: lower(regexp_extract(a, '\\A([^{WS}=]+)', 1)) = '{name}')[1], '(?s)\\A[^=]+=[{WS}]*(.*)\\z', 1)")
    bare = f"nullif(regexp_replace({value}, '(?s)\\A[\\x22''](.*)[\\x22'']\\z', '\\1'), '')"
    return f"case when {bare} is not null then {decode(bare)} end"


def tokens_sql(source: str, column: str) -> str:
    return f"""select page_id, cast(idx as int) as idx, raw, case when {_TAG} then {_NAME} else '' end as tag,
        case when not {_TAG} then 0 when raw like '</%' then -1 else 1 end as dir
      from (select page_id, unnest(range(len(l))) as idx, unnest(l) as raw from (select page_id, regexp_extract_all({column}, {q(TOKEN)}) as l from {source}))"""


def page_tokens_sql(source: str) -> list[tuple[str, str]]:
    return [
        ("clean_html", f"select page_id, {drop_hidden('html')} as html from {source}"),
        ("raw_tokens", tokens_sql("clean_html", "html")),
        ("tok", f"""select page_id, idx, case when dir = 1 then 'open' when dir = -1 then 'close' when regexp_matches(raw, '\\A<[!?]') then 'decl' else 'text' end as kind,
            tag, case when dir <> 0 then {_ATTRS} else '' end as attrs, case when dir = 0 then raw else '' end as text from raw_tokens"""),
    ]


BLOCKS_SQL = [
    ("bt", f"""select *, sum(case when tag in {_BLOCKS} then 1 else 0 end) over w as block_no,
        sum(case when tag = 'a' then case when kind = 'open' then 1 else -1 end else 0 end) over w as s from tok window w as (partition by page_id order by idx)"""),
    ("bw", f"select *, s - least(0, min(s) over (partition by page_id order by idx)) > 0 as in_link, {words('text')} as n from bt"),
    ("blocks", f"""select page_id, cast(block_no as int) as block_no, trim({collapse(decode("string_agg(text, '' order by idx)"))}, ' ') as text,
        cast(sum(n) as int) as n_words, cast(sum(case when in_link then n else 0 end) as int) as n_link_words,
        sum(case when in_link then n else 0 end) / sum(n) as link_density
        from bw where kind = 'text' group by page_id, block_no having sum(n) > 0"""),
]


def rule_sql(n: str, links: str, prev: str, prev_links: str, nxt: str) -> str:
    return f"""case when {links} / {n} > 0.333333 then false
        when {prev} > 0 and {prev_links} / {prev} > 0.555556 then case when {n} > 40 then true else {nxt} > 17 end
        when {n} > 16 then true when {nxt} > 15 then true else {prev} > 4 end"""


def inner(x: str, tag: str) -> str:
    return (f"regexp_replace(regexp_extract({x}, '(?is)<{tag}(?:[{WS}/][^>]*)?>(.*)\\z', 1), "
            f"'(?is)\\A(.*)</{tag}.*\\z', '\\1')")


def region_sql(source: str) -> list[tuple[str, str]]:
    """CTEs ending in ``region`` (page_id, content, source_rule, error_code)."""
    def body(x: str) -> str:
        no_head = (f"regexp_replace({x}, '(?is)<!doctype[^>]*>|</?html(?:[{WS}][^>]*)?>|<head(?:[{WS}][^>]*)?>.*?</head[^>]*>"
                   f"|<title(?:[{WS}][^>]*)?>.*?</title[^>]*>', '', 'g')")
        return f"case when regexp_matches({x}, '(?i)<body[{WS}/>]') then {inner(x, 'body')} else {no_head} end"

    return [
        ("rc", f"select page_id, {drop_hidden('html')} as c from {source}"),
        *chrome_ctes("r_bare", "rc", "c"),
        ("ri", f"select page_id, {body('c')} as whole_bd, {inner('bare', 'article')} as art, {inner('bare', 'main')} as mn, {body('bare')} as bd from rc join r_bare using (page_id)"),
        ("rw", f"select *, {text_words('art')} as aw, {text_words('mn')} as mw, {text_words('bd')} as bw from ri"),
        ("ru", f"""select *, case when not ({blank('art')}) and aw * 3 >= bw then 'article' when not ({blank('mn')}) and mw * 3 >= bw then 'main' else 'body' end as rule from rw"""),
        ("rr", f"select page_id, rule, case rule when 'article' then art when 'main' then mn else case when {blank('bd')} then whole_bd else bd end end as html from ru"),
        ("rtok", tokens_sql("(select page_id, html from rr where rule = 'body')", "html")),
        ("rt1", f"""select *, case when tag in {_BLOCKS} then 1 else 0 end as brk,
            sum(case when tag in {_BLOCKS} then 1 else 0 end) over (partition by page_id order by idx) as b,
            sum(case when tag = 'a' then dir else 0 end) over (partition by page_id order by idx) as s from rtok"""),
        ("rt2", f"""select *, s - least(0, min(s) over (partition by page_id order by idx)) > 0 as in_link,
            case when dir = 0 and not regexp_matches(raw, '\\A<[!?]') then {words('raw')} else 0 end as n from rt1"""),
        ("rb", """select page_id, b, sum(n) as n, sum(case when in_link then n else 0 end) as ln, string_agg(raw, '' order by idx) as whole,
            coalesce(string_agg(case when brk = 1 then raw end, '' order by idx), '') as frame from rt2 group by page_id, b"""),
        ("rj", f"""select r.page_id, r.b, {rule_sql('n', 'ln', "coalesce(lag(n) over w, 0)", "coalesce(lag(ln) over w, 0)", "coalesce(lead(n) over w, 0)")} as good
            from rb r where n > 0 window w as (partition by page_id order by b)"""),
        ("rk", """select rb.page_id, bool_or(coalesce(good, false)) as any_good, string_agg(whole, '' order by rb.b) as all_html,
            string_agg(case when coalesce(good, true) then whole else frame end, '' order by rb.b) as some_html
            from rb left join rj on rb.page_id = rj.page_id and rb.b = rj.b group by rb.page_id"""),
        ("region", f"""select page_id, content, source_rule, case when {blank('content')} then 'no_content' end as error_code from (
            select rr.page_id, coalesce(case when rule <> 'body' then html when any_good then some_html else all_html end, '') as content,
                   case when rule = 'body' and any_good then 'blocks' else rule end as source_rule
            from rr left join rk on rr.page_id = rk.page_id)"""),
    ]


def _run(tags: str) -> str:
    return f"sum(case when tag in ({tags}) then dir else 0 end)"


def _clamp(s: str, window: str) -> str:
    return f"({s} - least(0, min({s}) over {window}))"


_TABLES = "('table', 'thead', 'tbody', 'tfoot', 'tr', 'td', 'th')"
_PAGE = "(partition by page_id order by idx)"
_BLK = "(partition by page_id, block_no order by idx)"


def markdown_sql(source: str) -> list[tuple[str, str]]:
    """CTEs ending in ``md`` (page_id, markdown) for a source with page_id and content."""
    text = f"""case
        when dir = 0 and regexp_matches(raw, '\\A<[!?]') then null
        when dir = 0 and in_pre then {decode('raw')} when dir = 0 then {collapse(decode('raw'))}
        when in_pre then case when tag = 'br' or (tag in {_BLOCKS} and not is_break and dir = -1) then chr(10) end
        when tag = 'img' and dir = 1 then '![' || {collapse(f"coalesce({attribute_flat(_ATTRS, 'alt')}, '')")} || '](' || {attribute_flat(_ATTRS, 'src')} || ')'
        when tag = 'br' then case when cell_id >= 0 then ' ' else chr(1) end
        when tag = 'hr' and dir = 1 and is_break then '---'
        when cell_id >= 0 and is_break then '' when cell_id >= 0 and tag in {_BLOCKS} then ' ' end"""
    flat = f"regexp_replace({collapse('t')}, '\\A[ \\x01]+|[ \\x01]+\\z', '', 'g')"
    same_link = "coalesce({o}.link_id = link_id, false)"

    def cont(o: str, *names: str) -> str:
        return "(" + " and ".join(f"coalesce({o}.{n} = {n}, false)" for n in names) + ")"

    def mark(flag: str, o: str, names: list[str], txt: str) -> str:
        return f"case when {flag} and not {cont(o, *names)} then {txt} else '' end"

    levels = [("link_id >= 0", ["link_id"]), ("bold", ["link_id", "bold"]), ("ital", ["link_id", "bold", "ital"]),
              ("code", ["link_id", "bold", "ital", "code"])]
    opens = " || ".join(mark(f, "pv", n, t) for (f, n), t in zip(levels, ["'['", "'**'", "'*'", "'`'"]))
    closes = " || ".join(mark(f, "nx", n, t) for (f, n), t in reversed(list(zip(levels, ["'](' || href || ')'", "'**'", "'*'", "'`'"]))))
    same_row = "coalesce({o}.cell_id >= 0 and {o}.row_id = row_id, false)"
    prow, nrow = same_row.format(o="pv"), same_row.format(o="nx")
    return [
        ("m0", f"""select page_id, coalesce(idx, 0) as idx, coalesce(raw, '') as raw, coalesce(tag, '') as tag, coalesce(dir, 0) as dir
            from {source} left join ({tokens_sql(source, 'content')}) using (page_id)"""),
        ("m1", f"""select *, {_run("'pre'")} over w as s_pre, {_run("'ul', 'ol'")} over w as s_list, {_run("'blockquote'")} over w as s_quote,
            coalesce(last_value(case when tag in ('td', 'th') and dir = 1 then idx when tag in {_TABLES} then -1 end ignore nulls) over w, -1) as c_id,
            coalesce(last_value(case when tag = 'tr' and dir = 1 then idx when tag in ('tr', 'table') then -1 end ignore nulls) over w, -1) as row_id,
            coalesce(last_value(case when tag = 'table' and dir = 1 then idx end ignore nulls) over w, -1) as table_id
            from m0 window w as {_PAGE}"""),
        ("m2", f"""select page_id, idx, raw, tag, dir, row_id, table_id, case when row_id >= 0 then c_id else -1 end as cell_id,
            {_clamp('s_pre', _PAGE)} as pre, {_clamp('s_list', _PAGE)} as l_depth, {_clamp('s_quote', _PAGE)} as quote_depth from m1"""),
        ("m3", f"""select * exclude (brk), brk or coalesce(lag(brk and tag = 'hr') over {_PAGE}, false) as is_break from (select *, pre > 0 and cell_id < 0 as in_pre, case when cell_id >= 0 then tag in {_TABLES} when pre > 0 then tag = 'pre' and pre = 1
            else tag in {_BLOCKS} end as brk from m2)"""),
        ("m4", f"select *, sum(case when is_break then 1 else 0 end) over {_PAGE} as block_no, sum(case when tag = 'li' and dir = 1 then 1 else 0 end) over (partition by page_id, l_depth order by idx) as li_n from m3"),
        ("m5", """select *, last_value(case when tag in ('ul', 'ol') and dir = 1 then {'idx': idx, 'ordered': tag = 'ol', 'li_before': li_n} end ignore nulls) over w as lst,
            last_value(case when tag = 'li' and dir = 1 then idx end ignore nulls) over w as li from m4 window w as (partition by page_id, l_depth order by idx)"""),
        ("m6", """select * exclude (l_depth), case when ok then l_depth else 0 end as list_depth, case when ok then li else -1 end as li_id,
            case when ok then lst.idx else -1 end as list_id, case when ok and lst.ordered then li_n - lst.li_before else 0 end as li_no
            from (select *, coalesce(l_depth > 0 and li > lst.idx and cell_id < 0, false) as ok from m5)"""),
        ("m7", f"""select *, {_run("'b', 'strong'")} over w as s_b, {_run("'i', 'em'")} over w as s_i, {_run("'code', 'kbd', 'samp', 'tt'")} over w as s_c,
            last_value(case when tag = 'a' and dir = 1 then {{'id': idx, 'href': {attribute_flat(_ATTRS, 'href')}}} when tag = 'a' then {{'id': -1, 'href': null}} end ignore nulls) over w as lk,
            first_value(tag) over w as h_tag, first_value(is_break) over w as h_break, first_value(dir) over w as h_dir
            from m6 window w as {_BLK}"""),
        ("m8", f"""select *, coalesce({_clamp('s_b', _BLK)} > 0, false) as bold, {_clamp('s_i', _BLK)} > 0 as ital, {_clamp('s_c', _BLK)} > 0 as code,
            case when coalesce(lk.id >= 0 and lk.href is not null, false) then lk.id else -1 end as link_id, lk.href as href, {text} as text from m7"""),
        ("m9", f"""select *, not in_pre and not ({blank("replace(text, chr(1), '')")}) as solid,
            case when h_break and h_dir = 1 and regexp_matches(h_tag, '\\Ah[1-6]\\z') then cast(substr(h_tag, 2, 1) as int) else 0 end as level
            from m8 where text is not null"""),
        ("m10", """select *, lag({'link_id': link_id, 'bold': bold, 'ital': ital, 'code': code}) over w as pv,
            lead({'link_id': link_id, 'bold': bold, 'ital': ital, 'code': code}) over w as nx
            from m9 window w as (partition by page_id, block_no, solid order by idx)"""),
        ("m11", f"""select *, case when not solid then text else case when regexp_matches(text, '\\A[{WS}]') then ' ' else '' end || {opens}
            || regexp_replace(text, '\\A[{WS}]+|[{WS}]+\\z', '', 'g') || {closes} || case when regexp_matches(text, '[{WS}]\\z') then ' ' else '' end end as piece from m10"""),
        ("m12", """select page_id, block_no, string_agg(piece, '' order by idx) as t, min(idx) as idx from m11 group by page_id, block_no"""),
        ("m13", f"""select * from (select a.page_id, a.block_no, in_pre, quote_depth, list_depth, li_id, list_id, li_no, cell_id, row_id, table_id, level,
            case when in_pre then regexp_replace(t, '\\A[\\r\\n]+|[{WS}]+\\z', '', 'g')
                 when cell_id >= 0 then replace(trim({collapse('t')}, ' '), '|', '\\|')
                 when level > 0 then regexp_replace({flat}, ' *\\x01[ \\x01]*', ' ', 'g')
                 else regexp_replace({flat}, ' *\\x01 *', '  ' || chr(10), 'g') end as text
            from m12 a join m11 b on a.page_id = b.page_id and a.block_no = b.block_no and a.idx = b.idx) where text <> '' or cell_id >= 0"""),
        ("m14", """select *, li_id >= 0 and block_no = min(block_no) over (partition by page_id, li_id) as is_first,
            sum(case when cell_id >= 0 then 1 else 0 end) over (partition by page_id, row_id) as cells,
            min(case when cell_id >= 0 then row_id end) over (partition by page_id, table_id) as top_row from m13"""),
        ("m15", """select *, lag({'row_id': row_id, 'table_id': table_id, 'cell_id': cell_id, 'list_depth': list_depth, 'list_id': list_id, 'quote_depth': quote_depth}) over w as pv,
            lead({'row_id': row_id, 'cell_id': cell_id}) over w as nx, repeat('> ', cast(quote_depth as int)) as quo from m14 window w as (partition by page_id order by block_no)"""),
        ("m16", f"""select page_id, block_no, case when pv is null then '' when cell_id >= 0 and {prow} then ' | '
              when (cell_id >= 0 and pv.cell_id >= 0 and pv.table_id = table_id)
                or (is_first and pv.list_depth > 0 and not (list_depth = 1 and pv.list_depth = 1 and list_id <> pv.list_id)) then chr(10)
              when quote_depth > 0 and pv.quote_depth > 0 then chr(10) || rtrim(repeat('> ', cast(least(quote_depth, pv.quote_depth) as int)), ' ') || chr(10)
              else chr(10) || chr(10) end
            || case when cell_id >= 0 then case when {prow} then '' else quo || '| ' end || text
                 || case when {nrow} then '' else ' |' || case when row_id = top_row then chr(10) || quo || '|' || repeat(' --- |', cast(cells as int)) else '' end end
               else quo || repeat('    ', cast(list_depth - case when is_first then 1 else 0 end as int))
                 || case when is_first then case when li_no > 0 then cast(li_no as string) || '. ' else '- ' end else '' end
                 || replace(case when in_pre then '```' || chr(10) || text || chr(10) || '```' when level > 0 then repeat('#', level) || ' ' || text else text end,
                            chr(10), chr(10) || quo || repeat('    ', cast(list_depth as int))) end as piece from m15"""),
        ("md", f"""select page_id, coalesce(markdown, '') as markdown from {source} left join
            (select page_id, regexp_replace(string_agg(piece, '' order by block_no), '\\A[{WS}]+|[{WS}]+\\z', '', 'g') as markdown from m16 group by page_id) using (page_id)"""),
    ]


def images_sql(source: str) -> list[tuple[str, str]]:
    attrs = _ATTRS.replace("raw", "t")
    return [
        ("ia", f"""select * from (select *, list_filter(list_transform(list_filter(regexp_extract_all(content, {q(TOKEN)}),
            lambda t: regexp_matches(t, '(?i)\\A<img[{WS}/>]')),
            lambda t: {{'src': {attribute_flat(attrs, 'src')}, 'alt': coalesce({attribute_flat(attrs, 'alt')}, '')}}), lambda i: i.src is not null) as l from {source})"""),
        ("images", f"""select * exclude (l, i), i.src as src, i.alt as alt, {filename_sql('i.src')} as filename
            from (select *, cast(unnest(range(len(l))) as int) as idx, unnest(l) as i from ia)"""),
    ]


def filename_sql(x: str) -> str:
    return f"coalesce(nullif(split_part(split_part({x}, '/', -1), '?', 1), ''), 'image.jpg')"


def title_sql(x: str) -> str:
    found = f"regexp_extract({drop_hidden(x)}, '(?is)<title(?:[{WS}][^>]*)?>(.*?)</title', 1)"
    return f"trim({collapse(decode(found))}, ' ')"


ORACLES = {
    "page_tokens": oracle(["rich_pages"], "select * from tok", page_tokens_sql("rich_pages")),
    "page_title": oracle(["region_pages"], f"select page_id, {title_sql('html')} as title from region_pages"),
    "main_region": oracle(["region_pages"], "select * from region", region_sql("region_pages")),
    "page_blocks": oracle(["region_pages"], "select * from blocks", [*page_tokens_sql("region_pages"), *BLOCKS_SQL]),
    "content_blocks": oracle([], f"""select *, {rule_sql('n_words', 'n_link_words', 'coalesce(lag(n_words) over w, 0)', 'coalesce(lag(n_link_words) over w, 0)',
        'coalesce(lead(n_words) over w, 0)')} as is_content from blocks window w as (partition by page_id order by block_no)""",
        [*page_tokens_sql("pages"), *BLOCKS_SQL]),
    "host_boilerplate": oracle([], """select page_id, block_no, text, host from hb where (host, text) not in (
          select host, text from (select host, text, count(distinct page_id) as n from hb group by all) join
            (select host, count(distinct page_id) as total from hb group by all) using (host) where n >= 2 and n * 100 >= total * 10)""",
        [*page_tokens_sql("pages"), *BLOCKS_SQL,
         ("hb", f"select page_id, block_no, text, host from blocks join (select page_id, {HOST_OF} as host from pages) using (page_id)")]),
    "decode_entities": oracle(["rich_pages"], f"""select page_id, {decode("html || ' &#38;lt; &amp;lt; &#xD800; &#0; &nbsp;&hellip; &Eacute;&alpha;&ensp;&NotEqualTilde; &#128512;'")} as text from rich_pages"""),
    "to_markdown": oracle(["rich_pages"], "select * from md", [*region_sql("rich_pages"), *markdown_sql("region")]),
    "extract_pages": oracle(["region_pages"], f"""select page_id, url, title, content, len(l) as images, source_rule, error_code, markdown
        from ia join md using (page_id) join (select page_id, url, {title_sql('html')} as title from region_pages) using (page_id)""",
        [*region_sql("region_pages"), *markdown_sql("region"), *images_sql("region")]),
    "raw_content": oracle(["requests"], """select request_id, page_id, raw, case when raw then content else markdown end as content,
        case when raw then 'raw' else 'markdown' end as content_type from requests join region using (page_id) join md using (page_id)""",
        [*region_sql("pages"), *markdown_sql("region")]),
    "image_refs": oracle(["image_pages"], "select page_id, idx, src, alt, filename from images",
                         [*region_sql("image_pages"), *images_sql("(select page_id, content from region)")]),
    "filename_from_url": oracle(["guard_urls"], f"select id, url, {filename_sql('url')} as filename from guard_urls"),
}
