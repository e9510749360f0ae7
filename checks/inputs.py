"""Input tables derived from the given ones by arithmetic on ids, written once for both engines.

Each entry is a SELECT in the common part of Spark SQL and DuckDB SQL; what differs goes through a
``Dialect``. Every table covers all rows of the table it starts from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    name: str

    def plus_s(self, ts: str, seconds: str) -> str:
        if self.name == "spark":
            return f"({ts} + make_dt_interval(0, 0, 0, {seconds}))"
        return f"({ts} + to_seconds({seconds}))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.name == "spark" else f"sha256({x})"

    def series(self, n: str) -> str:
        """One row per number 0 .. n-1 (none for 0), as a select item."""
        if self.name == "spark":
            return f"explode(slice(sequence(0, cast({n} as int)), 1, cast({n} as int)))"
        return f"cast(unnest(range({n})) as int)"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")

HOST_OF = "lower(regexp_extract(url, '://([^/?#]+)', 1))"


def _text(x: str) -> str:
    return f"cast({x} as string)"


def _hv(host: str) -> str:
    return f"(length({host}) * 3 + ascii(substr({host}, 4, 1)) + ascii(substr({host}, 8, 1)))"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


def _dotted(i: str) -> str:
    return f"concat({_text(f'({i} * 7) % 256')}, '.', {_text(f'({i} * 13) % 256')}, '.', {_text(f'{i} % 256')}, '.', {_text(f'({i} * 3) % 256')})"


def table_sql(d: Dialect) -> dict[str, str]:
    """Name to SELECT; later entries may use earlier ones."""
    n_pages = "(select count(*) from pages)"
    eid = "e.event_id"
    return {
        # one request per event, on a page
        "visits": f"""
            select e.event_id as request_id, e.ts, e.event_type, e.value, p.page_id, p.url, {HOST_OF.replace('url', 'p.url')} as host,
                   {d.sha256('p.url')} as url_key
            from (select *, event_id % {n_pages} as pid from events) e join pages p on e.pid = p.page_id""",
        "requests": f"""
            select request_id, ts, page_id, url, host, host as host_key, url_key,
                   cast(case request_id % 5 when 0 then 20000 when 1 then 500 when 2 then 0 when 3 then 1500 else 5000 end as int) as max_length,
                   cast(case request_id % 4 when 0 then 0 when 1 then 400 when 2 then 3000 else 100000 end as int) as start_index,
                   request_id % 7 = 0 as raw,
                   request_id % 3 <> 0 as images_enabled,
                   cast(request_id % 4 as int) as image_count,
                   cast(request_id % 3 as int) as image_start,
                   1000 as image_max_width, 1600 as image_max_height, 80 as image_quality,
                   request_id % 2 = 0 as allow_cross_origin,
                   request_id % 4 = 0 as ignore_robots
            from visits""",
        # typed requests, some beyond the limits
        "loose_requests": """
            select event_id as request_id,
                   case when event_id % 23 = 0 then '' else 'https://example.com/' || cast(event_id as string) end as url,
                   cast(case event_id % 6 when 0 then -1 when 1 then 1000000 when 2 then 1000001 else event_id % 9999 end as int) as max_length,
                   cast(case event_id % 17 when 3 then -5 else event_id % 400 end as int) as start_index,
                   cast(event_id % 13 - 1 as int) as image_count,
                   cast(case event_id % 19 when 3 then -1 else event_id % 5 end as int) as image_start,
                   cast(event_id % 103 as int) as image_quality,
                   cast(case event_id % 7 when 0 then 99 when 1 then 10001 else 100 + event_id % 9901 end as int) as image_max_width,
                   cast(case event_id % 11 when 0 then 99 when 1 then 10001 else 100 + event_id % 9901 end as int) as image_max_height
            from events""",
        "request_json": """
            select request_id, ts,
                   case request_id % 12
                     when 0 then '{"url": "' || url || '"}'
                     when 1 then '{"url": "' || url || '", "text": {"maxLength": ' || cast(request_id % 5000 as string) || ', "startIndex": 12.9, "raw": true}}'
                     when 2 then '{"url": "' || url || '", "images": true, "security": {"ignoreRobotsTxt": false}}'
                     when 3 then '{"url": "' || url || '", "images": {"output": "both", "layout": "individual", "maxCount": 5, "startIndex": 2, "size": {"maxWidth": 640, "maxHeight": 480, "quality": 55}, "originPolicy": "same-origin"}}'
                     when 4 then '{"url": "' || url || '", "text": {"maxLength": "5", "startIndex": true, "raw": "yes"}, "images": "on", "security": {"ignoreRobotsTxt": 0}}'
                     when 5 then '{"url": "", "text": {"maxLength": 7}}'
                     when 6 then '{"url": "' || url || '"'
                     when 7 then '{"url": 17, "images": {"output": "file"}}'
                     when 8 then '[1, 2, "' || url || '"]'
                     when 9 then '{"url": "' || url || '", "text": null, "images": {"output": "file", "maxCount": -2.7, "size": 9, "originPolicy": "cross-origin"}}'
                     when 10 then '{"text": {"maxLength": 1e6}}'
                     else '{"url": "' || url || '", "images": false, "text": {"maxLength": 1e12, "startIndex": -3}}'
                   end as args
            from visits""",
        # page addresses, many of them bent into something a guard has to see through
        "guard_urls": f"""
            select page_id as id,
                   case page_id % 20
                     when 1 then replace(replace(url, 'https://', 'ftp://'), 'http://', 'ftp://')
                     when 2 then replace(url, '://', '://user:pw@')
                     when 3 then 'http://localhost:' || {_text('8000 + page_id % 100')} || '/x'
                     when 4 then 'https://app.LOCALHOST/p' || {_text('page_id')}
                     when 5 then 'http://api.local/' || {_text('page_id')}
                     when 6 then 'http://10.' || {_text('page_id % 256')} || '.0.1/'
                     when 7 then 'http://[::ffff:127.0.0.1]/' || {_text('page_id')}
                     when 8 then 'http://[fe80::' || {_text('page_id % 1000')} || ']:8080/p'
                     when 9 then 'javascript:alert(' || {_text('page_id')} || ')'
                     when 10 then '/relative/path/' || {_text('page_id')}
                     when 11 then 'http:///nohost/' || {_text('page_id')}
                     when 12 then replace(replace(upper(url), 'HTTPS', 'Https'), '.COM', '.com:8443')
                     when 13 then url || '%zz'
                     when 14 then 'http://host:12ab/' || {_text('page_id')}
                     when 15 then 'http://93.184.' || {_text('page_id % 256')} || '.34:80'
                     when 16 then 'http://a_b.example.com?q=/x#/y'
                     when 17 then 'http://bad host/' || {_text('page_id')}
                     else url end as url
            from pages""",
        "blocked_hosts": f"""
            select distinct {HOST_OF} as host from pages where url like '%spam-farm%' or url like '%cheap-pills%'""",
        "addresses": f"""
            select event_id as id,
                   case event_id % 12
                     when 0 then {_dotted('event_id')}
                     when 1 then '172.' || {_text('event_id % 256')} || '.4.5'
                     when 2 then '192.168.' || {_text('event_id % 300')} || '.1'
                     when 3 then '::ffff:' || {_dotted('event_id')}
                     when 4 then 'fe' || substr('89abcdef', cast(event_id % 8 + 1 as int), 1) || '0::' || {_text('event_id % 10000')}
                     when 5 then '2001:4860:4860::' || {_text('event_id % 10000')}
                     when 6 then 'F' || substr('BCDE', cast(event_id % 4 + 1 as int), 1) || '00:1:2:3:4:5:6:7'
                     when 7 then '::' || {_text('event_id % 3')}
                     when 8 then '0:0:0:0:0:ffff:7f00:' || {_text('event_id % 100')}
                     when 9 then {_text('event_id % 256')} || '.1.1.1'
                     when 10 then 'ff02::' || {_text('event_id % 100')} || ':1'
                     else '1.2.3' end as ip
            from events""",
        "resolutions": f"""
            select host, case (hv + k) % 7
                       when 0 then '10.0.0.' || {_text('hv % 256')}
                       when 1 then '::ffff:192.168.1.' || {_text('hv % 256')}
                       else '93.184.216.' || {_text('(hv + k) % 256')} end as ip
            from (select host, hv, {d.series('hv % 4')} as k
                  from (select distinct {HOST_OF} as host, {_hv(HOST_OF)} as hv from pages) h) r""",
        "robots_snapshots": f"""
            select request_id as robots_id, host as host_key,
                   {d.plus_s('ts', '-((request_id * 37) % 7200)')} as fetched_at,
                   cast(case request_id % 12 when 6 then 404 when 7 then 403 when 8 then 500 when 9 then 401 when 10 then 301 else 200 end as int) as status,
                   case request_id % 5
                     when 0 then {_lines("'# all'", "'User-agent: *'", "'Disallow: /en/   # english'", "'Allow: /en/1*'", "''", "'USER-AGENT: mozilla'", "'User-agent: bot'", "'Disallow: /fr/'", "'Allow: /fr/*5$'", "'Sitemap: /s.xml'")}
                     when 1 then {_lines("'User-agent: bot'", "'Disallow: /'", "'User-agent: *'", "'Crawl-delay: 3'", "'Disallow: /*.html$'", "'Disallow: /de/'", "'Allow: /de/3'", "'Disallow:'")}
                     when 2 then {_lines("'User-agent: *'", "'Disallow: /'", "'User-agent: Mozilla/5'", "'Disallow:'")}
                     when 3 then {_lines("'Disallow: /en/'", "'User-agent: *'", "'Allow: /e'", "'Disallow: /e'", "'Disallow: /*/4*4'", "'Disallow: /e*7$'")}
                     else {_lines("'User-agent: *'", "'Disallow: /es'", "'User-agent: moz'", "'Disallow: /f*/*2'", "'User-agent: mozilla'", "'Disallow: /en/7'", "'Allow: /en/70'")}
                   end as body
            from visits""",
        "hops": f"""
            select a.url, case a.page_id % 29 when 7 then 'http://localhost/' || {_text('a.page_id')}
                                            when 11 then 'http://10.0.0.1/' || {_text('a.page_id')}
                                            else b.url end as location
            from (select page_id, url,
                         case when page_id % 9 = 0 then null when page_id % 31 = 5 then page_id - 1 else page_id + 1 end as to_id
                  from pages) a join pages b on a.to_id = b.page_id""",
        "fetch_log": f"""
            select request_id, attempt, {d.plus_s('ts', 'attempt * 2')} as ts, url,
                   cast(case when c in (4, 5, 9) then null when c = 0 then 503 when c = 1 then 500 when c = 2 then 404 else 200 end as int) as status,
                   cast(case when c in (4, 5, 9) then 0 when c = 3 then 10485760 + request_id % 2 else (request_id * 977) % 400000 end as bigint) as n_bytes,
                   case c when 4 then 'timeout' when 5 then 'fetch_failed' when 9 then case when request_id % 5 = 0 then 'ssrf_blocked' else 'timeout' end end as error_code
            from (select *, (request_id * 7 + attempt * 3) % 11 as c
                  from (select request_id, ts, url, {d.series('request_id % 4 + 1')} as attempt from visits) x) y""",
        "snapshots": f"""
            select request_id as snapshot_id, url_key, {d.plus_s('ts', '-((request_id * 37) % 900)')} as fetched_at, page_id
            from visits""",
        "outcomes": """
            select request_id, ts, host, cast(20 + (request_id * 131) % 4000 as int) as latency_ms,
                   case when event_type = 'error' then 'fetch_failed' end as error_code
            from visits""",
        "coded": """
            select event_id as request_id,
                   case event_id % 18 when 0 then 'url_required' when 1 then 'invalid_url' when 2 then 'scheme_not_allowed' when 3 then 'ssrf_blocked'
                     when 4 then 'localhost_blocked' when 5 then 'robots_disallowed' when 6 then 'robots_forbidden' when 7 then 'content_too_large'
                     when 8 then 'image_too_large' when 9 then 'timeout' when 10 then 'too_many_redirects' when 11 then 'fetch_failed'
                     when 12 then 'http_client_error' when 13 then 'http_server_error' when 14 then 'extraction_failed' when 15 then 'no_content' end as error_code,
                   case event_id % 4 when 0 then 'detail ' || cast(event_id as string) when 1 then '' end as error_detail
            from events""",
        # arrivals squeezed from thirty days into about twenty minutes, as microseconds
        "arrivals": f"""
            select request_id, host, {d.idiv(_epoch(d), '2000')} as arrival_us from visits""",
        "image_pages": f"""
            select page_id, url, replace(html, '</article>',
                   case when page_id % 6 > 0 then '<p><img src="/img/a' || {_text('page_id')} || '.png" alt="A &amp; B"></p>' else '' end
                   || case when page_id % 6 > 1 then '<IMG alt=''two'' src=''https://cdn.example.org/x/photo.jpg?size=' || {_text('page_id % 90')} || '''/>' else '' end
                   || case when page_id % 6 > 2 then '<img src=rel/pic.gif width=10><img alt="no source"><img src="">' else '' end
                   || case when page_id % 6 > 3 then '<img data-src="lazy.png" src="//static.example.net/b.webp" alt="">' else '' end
                   || case when page_id % 6 > 4 then '<img src="a>b.png?x=1&amp;y=/z/" title=">"><img src="data:image/png;base64,AAAA">' else '' end
                   || '</article>') as html
            from pages""",
        # what fetches of the images of image_pages left; some addresses were never fetched
        "landed_images": f"""
            select image_url, case k % 3 when 0 then 'image/png' when 1 then 'image/jpeg' else 'image/webp; q=1' end as mime,
                   cast(case when k % 11 = 5 then null else 200 + k * 37 % 2600 end as int) as width,
                   cast(case when k % 11 = 5 then null when k % 13 = 4 then 0 else 100 + k * 53 % 3200 end as int) as height,
                   cast(10485000 + k % 900 as bigint) as n_bytes
            from (select regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/img/a' || {_text('page_id')} || '.png' as image_url, page_id as k from pages
                  union all select distinct 'https://cdn.example.org/x/photo.jpg?size=' || {_text('page_id % 90')} as image_url, page_id % 90 as k from pages
                  union all select 'https://cdn.example.org/x/photo.jpg?size=7' as image_url, 3 as k) f""",
        "image_request_json": """
            select request_id, ts, '{"url": "' || url || case request_id % 6
                     when 0 then '", "images": true}'
                     when 1 then '", "images": {"layout": "both", "maxCount": 4, "output": "file", "size": {"maxWidth": 700, "maxHeight": 300, "quality": 41}}}'
                     when 2 then '", "images": {"layout": "individual", "maxCount": 10, "startIndex": 1, "output": "both"}}'
                     when 3 then '", "images": {"originPolicy": "same-origin", "maxCount": 9, "size": {"maxWidth": 10000, "maxHeight": 10000}}}'
                     when 4 then '", "images": {"startIndex": 9, "maxCount": 0}}'
                     else '"}' end as args
            from visits""",
        "region_pages": """
            select page_id, url,
                   case page_id % 8
                     when 1 then replace(replace(html, '<article>', '<MAIN id="m>1">'), '</article>', '</MAIN>')
                     when 2 then replace(replace(html, '<article>', '<div class="x">'), '</article>', '</div>')
                     when 3 then replace(html, '</article>', '')
                     when 4 then '<html><head><title>none</title></head><body> <script>x()</script></body></html>'
                     when 5 then replace(replace(replace(replace(html, '<article>', ''), '</article>', ''), '<body>', ''), '</body>', '')
                     when 6 then '<html><body><p>Only a short line ' || url || '</p><nav>menu</nav></body></html>'
                     when 7 then replace(html, '<article>', '<article class="post"><nav>crumbs</nav><aside>related</aside><!-- note <article> -->')
                     else html end as html
            from pages""",
        "rich_pages": f"""
            select page_id, replace(html, '</article>',
                   case page_id % 4
                     when 0 then '<ul><li>one <a href="/p/' || {_text('page_id')} || '?a=1&amp;b=2">link <b>bold</b></a></li><li>two<ol><li>n1<li>n2 <em>it</em></ol></li><li><p>three</p><p>more</p></li></ul><ul><li>other</ul>'
                     when 1 then '<blockquote><p>Quoted <i>text</i> ' || url || '</p><p>again</p></blockquote><pre><code>x = ' || {_text('page_id')} || chr(10) || '  if a &lt; b:' || chr(10) || '</code></pre><p>uses <code>f(x)</code></p>'
                     when 2 then '<table><thead><tr><th>k</th><th>v</th></tr></thead><tr><td>' || {_text('page_id')} || '</td><td><p>a|b</p><p>c</p></td></tr><tr><td></td><td>x<br>y</td></tr></table>'
                     else '<h2>Part <b>' || {_text('page_id')} || '</b></h2><p>Line<br>break<hr>after rule<p title="a > b">quoted &#8364;&#x41; &unknown; <img src="i.png" alt="pic"> end</div></ul></pre>' end
                   || '</article>') as html
            from pages""",
        "image_meta": f"""
            select page_id, idx, 'https://cdn.example.org/' || {_text('page_id')} || '/' || {_text('idx')} as src,
                   case idx % 4 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/webp; q=1' else 'application/octet-stream' end as mime,
                   cast(case when (page_id + idx) % 7 = 6 then null else 200 + (page_id * 37 + idx * 911) % 2600 end as int) as width,
                   cast(case when (page_id + idx) % 7 = 6 then null else 100 + (page_id * 53 + idx * 613) % 3200 end as int) as height,
                   cast(10485758 + (page_id + idx) % 5 as bigint) as n_bytes
            from (select page_id, {d.series('page_id % 6')} as idx from pages) p""",
    }


def _epoch(d: Dialect) -> str:
    if d.name == "spark":
        return "cast(cast(cast(ts - timestamp_ntz'2024-01-01 00:00:00' as interval second) as decimal(20,6)) * 1000000 as bigint)"
    return "(epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00'))"


_GIVEN = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name in _GIVEN:
        return given(spark, sf_dir, name)
    sql = table_sql(SPARK)
    *before, last = _needed(name, sql)
    ctes = ", ".join(f"{n} as ({sql[n]})" for n in before)
    query = f"with {ctes} {sql[last]}" if ctes else sql[last]
    used = [n for n in _GIVEN if re.search(rf"\b(from|join) {n}\b", query)]
    for n in used:
        query = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", query)
    return spark.sql(_spark_braces(query, used), **{n: given(spark, sf_dir, n) for n in used})


def _spark_braces(query: str, used: list[str]) -> str:
    """Only the table markers may be read as placeholders; JSON texts hold braces of their own."""
    doubled = query.replace("{", "{{").replace("}", "}}")
    for n in used:
        doubled = doubled.replace(f"{{{{{n}}}}}", f"{{{n}}}")
    return doubled


def _needed(name: str, sql: dict[str, str]) -> list[str]:
    found: list[str] = []
    for other in sql:
        if other == name:
            break
        if re.search(rf"\b(?:from|join) {other}\b", sql[name]):
            found += [n for n in _needed(other, sql) if n not in found]
    return [*found, name]


def oracle(names: list[str], body: str, ctes: list[tuple[str, str]] = ()) -> str:
    """A DuckDB query with the derived tables it needs in front."""
    sql = table_sql(DUCKDB)
    order: list[str] = []
    for name in names:
        order += [n for n in _needed(name, sql) if n not in order]
    parts = [f"{n} as ({sql[n]})" for n in order] + [f"{n} as ({q})" for n, q in ctes]
    return f"with recursive {', '.join(parts)} {body}" if parts else body
