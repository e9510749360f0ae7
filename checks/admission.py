"""Queries on requests, URLs, addresses and robots files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import oracle, table
from crawlweave.functions.addresses import ip_is_private
from crawlweave.operators import admission, requests, robots

URL_RE = r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
V4_RE = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

QUERIES = {
    "parse_requests": lambda s, d: requests.parse_requests(table(s, d, "request_json")),
    "validate_requests": lambda s, d: requests.validate_requests(table(s, d, "loose_requests")),
    "url_parts": lambda s, d: admission.url_parts(table(s, d, "guard_urls")),
    "url_guard": lambda s, d: admission.url_guard(table(s, d, "guard_urls"), blocked_hosts=table(s, d, "blocked_hosts")),
    "ip_class": lambda s, d: table(s, d, "addresses").withColumn("is_private", ip_is_private("ip")),
    "dns_guard": lambda s, d: admission.dns_guard(
        admission.url_guard(table(s, d, "guard_urls"), blocked_hosts=table(s, d, "blocked_hosts")),
        table(s, d, "resolutions")),
    "allowed_hosts": lambda s, d: admission.allowed_hosts(
        table(s, d, "requests").select("request_id", "url", "host"), table(s, d, "blocked_hosts")),
    "cache_key": lambda s, d: requests.with_cache_key(table(s, d, "guard_urls")),
    "robots_status": lambda s, d: robots.robots_status(table(s, d, "robots_snapshots")).select("robots_id", "status", "policy"),
    "robots_rules": lambda s, d: robots.robots_rules(table(s, d, "robots_snapshots"))
    .withColumn("agents", F.array_join("agents", ",")),
    "robots_asof": lambda s, d: robots.robots_asof(
        table(s, d, "requests").select("request_id", "ts", "host_key"), table(s, d, "robots_snapshots")),
    "robots_gate": lambda s, d: robots.robots_gate(
        admission.url_parts(robots.robots_asof(
            table(s, d, "requests").select("request_id", "ts", "url", "ignore_robots", F.col("host").alias("host_key")),
            table(s, d, "robots_snapshots")).drop("host_key"))
        .select("request_id", "robots_id", "path", "ignore_robots"),
        table(s, d, "robots_snapshots")),
}


def _num(path: str, default: int) -> str:
    """A JSON number cut to an int, or the default if the value is missing or of another type."""
    return (f"case when json_type(j, '{path}') in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then cast(trunc(least(greatest("
            f"cast(json_extract_string(j, '{path}') as double), -2147483647), 2147483647)) as int) else {default} end")


def _flag(path: str, default: str) -> str:
    return f"case when json_type(j, '{path}') = 'BOOLEAN' then cast(json_extract_string(j, '{path}') as boolean) else {default} end"


def _str(path: str) -> str:
    return f"case when json_type(j, '{path}') = 'VARCHAR' then json_extract_string(j, '{path}') end"


_PARSE = f"""
select request_id, ts, coalesce({_str('$.url')}, '') as url,
  {_num('$.text.maxLength', 20000)} as max_length, {_num('$.text.startIndex', 0)} as start_index, {_flag('$.text.raw', 'false')} as raw,
  case json_type(j, '$.images') when 'BOOLEAN' then cast(json_extract_string(j, '$.images') as boolean) when 'OBJECT' then true else false end as images_enabled,
  {_num('$.images.maxCount', 3)} as image_count, {_num('$.images.startIndex', 0)} as image_start,
  {_num('$.images.size.maxWidth', 1000)} as image_max_width, {_num('$.images.size.maxHeight', 1600)} as image_max_height,
  {_num('$.images.size.quality', 80)} as image_quality,
  coalesce({_str('$.images.originPolicy')} = 'cross-origin', true) as allow_cross_origin,
  coalesce({_str('$.images.output')} in ('base64', 'both'), true) as output_base64,
  coalesce({_str('$.images.output')} in ('file', 'both'), false) as save_to_file,
  coalesce({_str('$.images.layout')}, 'merged') as layout,
  {_flag('$.security.ignoreRobotsTxt', 'true')} as ignore_robots,
  case when coalesce({_str('$.url')}, '') = '' then 'url_required' end as error_code
from (select request_id, ts, case when json_valid(args) then cast(args as json) end as j from request_json)"""

_VALIDATE = """
select *, case when error_detail is not null then 'invalid_url' end as error_code from (
select *, case
  when url = '' then 'URL is required'
  when max_length not between 0 and 1000000 then 'maxLength must be between 0 and 1,000,000'
  when image_count not between 0 and 10 then 'imageMaxCount must be between 0 and 10'
  when image_quality not between 1 and 100 then 'imageQuality must be between 1 and 100'
  when image_max_width not between 100 and 10000 then 'imageMaxWidth must be between 100 and 10000'
  when image_max_height not between 100 and 10000 then 'imageMaxHeight must be between 100 and 10000'
  when start_index < 0 then 'startIndex must not be negative'
  when image_start < 0 then 'imageStartIndex must not be negative' end as error_detail
from loose_requests)"""


def parts_sql(source: str) -> str:
    """CTE body: every column of the source and the pieces of its url."""
    return f"""
    select *, case when hostport like '[%' then lower(regexp_extract(hostport, '\\[([^\\]]*)\\]', 1)) else lower(split_part(hostport, ':', 1)) end as host,
           case when contains(hostport, ':') then regexp_extract(hostport, ':([0-9]*)\\z', 1) else '' end as port
    from (select *, regexp_replace(authority, '(?s)\\A.*@', '') as hostport from (
      select *, lower(regexp_extract(url, '{URL_RE}', 1)) as scheme, regexp_extract(url, '{URL_RE}', 2) as authority,
             regexp_extract(url, '{URL_RE}', 3) as path, regexp_extract(url, '{URL_RE}', 4) as query from {source}))"""


def guard_sql(parts: str, blocked: str = "blocked_hosts") -> str:
    """CTE body: verdict code and detail by the shape of the URL; host must not be ambiguous."""
    return f"""
    select *, case code when 'bad' then 'invalid_url' when 'user' then 'invalid_url' when 'empty' then 'invalid_url' else code end as error_code,
           case code when 'bad' then 'cannot be parsed' when 'user' then 'URL contains userinfo' when 'empty' then 'host is empty' end as error_detail
    from (select *, case
      when regexp_matches(url, '[\\x00-\\x1f\\x7f]') or regexp_matches(authority, '[ <>\\x22]')
           or regexp_matches(authority || path, '%([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|[0-9a-fA-F]\\z|\\z)')
           or (hostport like '[%' and not regexp_full_match(hostport, '\\[[^\\[\\]]*\\](:[0-9]*)?'))
           or (hostport not like '[%' and contains(hostport, ':') and not regexp_full_match(hostport, '[^:]*:[0-9]*')) then 'bad'
      when scheme not in ('http', 'https') then 'scheme_not_allowed'
      when contains(authority, '@') then 'user'
      when host = '' then 'empty'
      when host = 'localhost' or host like '%.localhost' or host like '%.local' then 'localhost_blocked'
      when host in (select b.host from {blocked} b) then 'ssrf_blocked' end as code
    from {parts})"""


def ip_sql(source: str, column: str) -> str:
    """CTE body: the source with is_private for an address column."""
    v4 = "(o[1] in (0, 10, 127) or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and o[2] = 168) or (o[1] = 169 and o[2] = 254) or o[1] >= 224)"
    return f"""
    select * exclude (t, t6, l, r, g, o, gap), case
      when regexp_full_match(t, '{V4_RE}') then {v4}
      when contains(t, ':') and len(g) = 8 and gap >= 0
        and list_bool_and(list_transform(g, lambda x: x is not null))
        and (len(string_split(t6, '::')) = 1 or (len(string_split(t6, '::')) = 2 and gap >= 1))
      then case
        when g[1:6] = [0, 0, 0, 0, 0, 65535] then list_transform([[g[7] >> 8, g[7] & 255]], lambda o: {v4})[1]
        when g = [0, 0, 0, 0, 0, 0, 0, 1] then true
        else (g[1] & 65024) = 64512 or (g[1] & 65472) = 65152 or g[1] >= 65280 end
      end as is_private
    from (select *, list_concat(list_transform(l, lambda x: try_cast('0x' || x as int)),
                                list_transform(range(greatest(gap, 0)), lambda z: 0),
                                list_transform(r, lambda x: try_cast('0x' || x as int))) as g
    from (select *, 8 - len(l) - len(r) as gap from (
      select *, list_filter(string_split(string_split(t6, '::')[1], ':'), lambda x: x <> '') as l,
             case when contains(t6, '::') then list_filter(string_split(string_split(t6, '::')[2], ':'), lambda x: x <> '') else [] end as r
      from (select *, case when contains(t, ':') and contains(t, '.') then
               regexp_replace(t, '[0-9.]+\\z', '') || to_hex(to4[1] * 256 + to4[2]) || ':' || to_hex(to4[3] * 256 + to4[4]) else t end as t6,
             list_transform(string_split(t, '.'), lambda x: try_cast(x as int)) as o
      from (select *, lower(trim({column})) as t,
                   list_transform(string_split(regexp_extract(lower(trim({column})), '([0-9.]+)\\z', 1), '.'), lambda x: try_cast(x as int)) as to4 from {source})))))"""


def dns_sql(guarded: str) -> list[tuple[str, str]]:
    return [
        ("r_class", f"select host, ip, is_private from ({ip_sql('resolutions', 'ip')})"),
        ("r_bad", "select host, min(ip) as private_ip from r_class where is_private group by host"),
        ("g_class", ip_sql(guarded, "host")),
        ("dns", """select g.* exclude (error_code, error_detail),
             case when error_code is null and bad is not null then 'ssrf_blocked' else error_code end as error_code,
             case when error_code is null and bad is not null then host || ' resolves to ' || bad else error_detail end as error_detail
           from (select c.*, coalesce(case when is_private then c.host end, b.private_ip) as bad
                 from g_class c left join r_bad b on c.host = b.host) g"""),
    ]


def robots_lines_sql() -> list[tuple[str, str]]:
    """Rule lines with group number, and the agents of each group."""
    return [
        ("rl", """select robots_id, host_key, line_no, lower(regexp_extract(line, '\\A[ \\t]*([a-zA-Z\\-]+)[ \\t]*:', 1)) as kind,
               regexp_extract(line, '\\A[ \\t]*[a-zA-Z\\-]+[ \\t]*:[ \\t]*(.*?)[ \\t]*\\z', 1) as value
             from (select robots_id, host_key, i - 1 as line_no, split_part(ls[i], '#', 1) as line
                   from (select robots_id, host_key, ls, unnest(range(1, len(ls) + 1)) as i
                         from (select robots_id, host_key, string_split(body, chr(10)) as ls from robots_snapshots where status between 200 and 299)))"""),
        ("rkind", """select *, case when kind = 'user-agent' and coalesce(lag(kind) over (partition by robots_id order by line_no), '') <> 'user-agent' then 1 else 0 end as starts
             from rl where kind in ('user-agent', 'allow', 'disallow')"""),
        ("rg", "select *, sum(starts) over (partition by robots_id order by line_no) as group_no from rkind"),
        ("ra", "select robots_id, group_no, lower(value) as agent from rg where kind = 'user-agent' and group_no > 0"),
    ]


def robots_verdict_sql(asof: str) -> list[tuple[str, str]]:
    """Verdicts for rows of request_id, robots_id, path, ignore_robots."""
    agent = "mozilla/5.0 (windows nt 10.0; win64; x64) applewebkit/537.36 (khtml, like gecko) chrome/120.0.0.0 safari/537.36"
    glob = r"regexp_replace(regexp_replace(regexp_replace(value, '\$\z', ''), '([.+?()\[\]{}^$|\\])', '\\\1', 'g'), '\*', '.*', 'g')"
    return [
        ("rbest", f"""select robots_id, group_no, fit from (
               select robots_id, group_no, max(fit) as fit, max(max(fit)) over (partition by robots_id) as best from (
                 select robots_id, group_no, case when agent = '*' then 0 when agent <> '' and starts_with('{agent}', agent) then length(agent) else -1 end as fit from ra)
               group by robots_id, group_no) where fit = best and fit >= 0"""),
        ("rrules", f"""select rg.robots_id, kind, value, '(?s)\\A' || {glob} || case when value like '%$' then '\\z' else '' end as re
             from rg join rbest using (robots_id, group_no) where kind <> 'user-agent' and value <> ''"""),
        ("rhit", f"""select a.request_id, max_by(r.kind, length(r.value) * 2 + case when r.kind = 'allow' then 1 else 0 end) as kind
             from {asof} a join rrules r on a.robots_id = r.robots_id
             where regexp_matches(case when a.path = '' then '/' else a.path end, r.re) group by a.request_id"""),
        ("rverdict", f"""select a.*, case when ignore_robots then 'allowed' when s.status in (401, 403) then 'forbidden'
               when h.kind = 'disallow' then 'disallowed' else 'allowed' end as robots_verdict
             from {asof} a left join robots_snapshots s on a.robots_id = s.robots_id left join rhit h on a.request_id = h.request_id"""),
    ]


ROBOTS_ASOF = """select q.*, case when age < 3600000000 then rid end as robots_id, case when age < 3600000000 then age end as robots_age_us
  from (select r.*, s.robots_id as rid, epoch_us(r.ts) - epoch_us(s.fetched_at) as age
        from requests r asof left join (select host_key, fetched_at, max(robots_id) as robots_id from robots_snapshots group by all) s
          on r.host_key = s.host_key and r.ts >= s.fetched_at) q"""

ORACLES = {
    "parse_requests": oracle(["request_json"], _PARSE),
    "validate_requests": oracle(["loose_requests"], _VALIDATE),
    "url_parts": oracle(["guard_urls"], """select id, url, scheme, host, port, lower(hostport) as host_key,
        case when scheme <> '' and hostport <> '' then scheme || '://' || hostport end as origin, path, query,
        case when scheme <> '' and hostport <> '' then scheme || '://' || authority || '/robots.txt' end as robots_url from p""",
        [("p", parts_sql("guard_urls"))]),
    "url_guard": oracle(["guard_urls", "blocked_hosts"], "select id, url, host, error_code, error_detail from g",
                        [("p", parts_sql("guard_urls")), ("g", guard_sql("p"))]),
    "ip_class": oracle(["addresses"], f"select id, ip, is_private from ({ip_sql('addresses', 'ip')})"),
    "dns_guard": oracle(["guard_urls", "blocked_hosts", "resolutions"], "select id, url, host, error_code, error_detail from dns",
                        [("p", parts_sql("guard_urls")), ("g", guard_sql("p")), *dns_sql("g")]),
    "allowed_hosts": oracle(["requests", "blocked_hosts"],
                            "select request_id, url, host from requests where host in (select b.host from blocked_hosts b)"),
    "cache_key": oracle(["guard_urls"], "select id, url, sha256(url) as url_key from guard_urls"),
    "robots_status": oracle(["robots_snapshots"], """select robots_id, status, case when status in (401, 403) then 'forbidden'
        when status between 200 and 299 then 'rules' else 'allow' end as policy from robots_snapshots"""),
    "robots_rules": oracle(["robots_snapshots"], """select robots_id, host_key, cast(group_no as bigint) as group_no, agents, cast(line_no as int) as rule_no, kind, value as pattern
        from rg join (select robots_id, group_no, string_agg(distinct agent, ',' order by agent) as agents from ra group by all) using (robots_id, group_no)
        where kind <> 'user-agent' and value <> ''""", robots_lines_sql()),
    "robots_asof": oracle(["requests", "robots_snapshots"], f"select request_id, ts, host_key, robots_id, robots_age_us from ({ROBOTS_ASOF})"),
    "robots_gate": oracle(["requests", "robots_snapshots"], "select request_id, robots_id, path, ignore_robots, robots_verdict from rverdict",
                          [("asof_rows", f"select request_id, robots_id, regexp_extract(url, '{URL_RE}', 3) as path, ignore_robots from ({ROBOTS_ASOF})"),
                           *robots_lines_sql(), *robots_verdict_sql("asof_rows")]),
}
