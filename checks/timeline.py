"""Queries on fetch logs, stored snapshots and request times."""

from __future__ import annotations

from checks.admission import dns_sql, guard_sql, parts_sql
from checks.inputs import oracle, table
from crawlweave.operators import fetchlog, freshness, rate

DAY = 86_400

QUERIES = {
    "redirect_chains": lambda s, d: fetchlog.redirect_chains(table(s, d, "pages"), table(s, d, "hops"), table(s, d, "resolutions")),
    "classify_response": lambda s, d: fetchlog.classify_response(table(s, d, "fetch_log")),
    "retry_outcome": lambda s, d: fetchlog.retry_outcome(table(s, d, "fetch_log")),
    "backoff_schedule": lambda s, d: fetchlog.backoff_schedule(table(s, d, "fetch_log")),
    "error_messages": lambda s, d: fetchlog.error_messages(table(s, d, "coded")),
    "outcome_metrics": lambda s, d: fetchlog.outcome_metrics(table(s, d, "outcomes"), exact=True),
    "fresh_snapshot": lambda s, d: freshness.fresh_snapshot(
        table(s, d, "requests").select("request_id", "ts", "url_key"), table(s, d, "snapshots")),
    "ttl_admission": lambda s, d: freshness.ttl_admission(
        table(s, d, "requests").select("request_id", "ts", "url_key"), ttl_s=DAY),
    "invalidate": lambda s, d: freshness.invalidate(
        table(s, d, "snapshots"), table(s, d, "requests").where("url like '%/de/%'").select("url_key")),
    "hot_set": lambda s, d: freshness.hot_set(table(s, d, "requests"), 100),
    "politeness_schedule": lambda s, d: rate.politeness_schedule(
        table(s, d, "requests").select("request_id", "host"), order="request_id"),
    "rate_limit_admission": lambda s, d: rate.rate_limit_admission(
        table(s, d, "arrivals"), per_second=0.5, burst=3, arrival_us="arrival_us"),
}

_RESPONSE = """case when error_code is not null then error_code when status >= 500 then 'http_server_error'
  when status >= 400 then 'http_client_error' when n_bytes > 10485760 then 'content_too_large' end"""
_CODED = f"""select request_id, attempt, ts, url, status, n_bytes, code as error_code,
  case when code like 'http!_%' escape '!' then 'HTTP ' || cast(status as string) end as error_detail
  from (select *, {_RESPONSE} as code from fetch_log)"""

# fixed values: the texts of messages and error codes here and in messages_sql have to be these
_MESSAGES = """case
  when error_code in ('ssrf_blocked', 'localhost_blocked') then 'Security blocked: ' || t || '. This URL resolves to a private or reserved address and cannot be fetched.'
  when error_code = 'robots_disallowed' then 'This URL is disallowed by robots.txt. You can bypass this by setting security.ignoreRobotsTxt to true (if your client supports it).'
  when error_code = 'robots_forbidden' then 'The robots.txt for this site returned 401/403. The site may be blocking automated access.'
  when error_code = 'timeout' then 'The request timed out. The server may be slow or unreachable. Try again later.'
  when error_code = 'content_too_large' then 'The response exceeds the maximum size limit. Try fetching a smaller page or increasing the limit.'
  when error_code = 'too_many_redirects' then 'Too many redirects. The URL may be part of a redirect loop.'
  when error_code in ('invalid_url', 'scheme_not_allowed') then 'Invalid URL: ' || t
  when error_code = 'fetch_failed' then 'Failed to fetch the URL: ' || t
  when error_code in ('extraction_failed', 'no_content') then 'Content extraction failed: ' || t
  else t end"""


def messages_sql(source: str) -> str:
    return f"""select * exclude (b, t), case
        when error_code in ('ssrf_blocked', 'localhost_blocked') then 'ssrf' when error_code like 'robots%' then 'robots'
        when error_code in ('content_too_large', 'image_too_large') then 'size' when error_code = 'timeout' then 'timeout'
        when error_code in ('too_many_redirects', 'fetch_failed', 'http_client_error', 'http_server_error') then 'http'
        when error_code in ('extraction_failed', 'no_content') then 'extraction' end as error_category,
      {_MESSAGES} as error_message
      from (select *, b || case when coalesce(error_detail, '') = '' then '' else ': ' || error_detail end as t from (
        select *, case error_code when 'url_required' then 'url is required' when 'invalid_url' then 'invalid URL format'
          when 'scheme_not_allowed' then 'only http and https schemes are allowed' when 'ssrf_blocked' then 'URL resolves to private/reserved address'
          when 'localhost_blocked' then 'localhost/local hostnames are not allowed' when 'robots_disallowed' then 'disallowed by robots.txt'
          when 'robots_forbidden' then 'robots.txt returned 401/403' when 'content_too_large' then 'response exceeds size limit'
          when 'image_too_large' then 'image exceeds size limit' when 'timeout' then 'request timed out' when 'too_many_redirects' then 'too many redirects'
          when 'fetch_failed' then 'fetch failed' when 'http_client_error' then 'HTTP client error' when 'http_server_error' then 'HTTP server error'
          when 'extraction_failed' then 'content extraction failed' when 'no_content' then 'no content could be extracted' end as b from {source}))"""


OUTCOME_SQL = [
    ("coded_log", _CODED),
    ("ends", """select request_id, min(attempt) as attempt from coded_log where error_code is null or attempt >= 3 or error_code in
        ('ssrf_blocked', 'localhost_blocked', 'robots_disallowed', 'robots_forbidden', 'content_too_large', 'http_client_error',
         'invalid_url', 'scheme_not_allowed', 'too_many_redirects', 'url_required') group by request_id"""),
    ("lasts", "select request_id, max(attempt) as attempt from coded_log group by request_id"),
    ("decided", """select l.request_id, l.attempt + 1 as attempts_used, l.error_code, l.error_detail, l.status, l.n_bytes, e.attempt is not null as finished
        from lasts m left join ends e on m.request_id = e.request_id
        join coded_log l on l.request_id = m.request_id and l.attempt = coalesce(e.attempt, m.attempt)"""),
]

CHAINS_SQL = [
    ("targets", "select url as src, min(location) as url from hops group by url"),
    ("tparts", parts_sql("targets")),
    ("no_hosts", "select '' as host where false"),
    ("tguard", guard_sql("tparts", "no_hosts")),
    *dns_sql("tguard"),
    ("chain", """
        select url, url as cur, 0 as n, false as stopped, null::varchar as error_code, null::varchar as error_detail, false as moved from pages
        union all
        select c.url, case when t.url is null or c.n = 5 or t.error_code is not null then c.cur else t.url end,
               case when t.url is null or c.n = 5 or t.error_code is not null then c.n else c.n + 1 end,
               t.url is null or c.n = 5 or t.error_code is not null,
               case when t.url is null then null when c.n = 5 then 'too_many_redirects' else t.error_code end,
               case when t.url is null then null when c.n = 5 then 'exceeded 5 redirects' else t.error_detail end, true
        from chain c left join dns t on c.cur = t.src where not c.stopped"""),
    ("chains", """select url, case when error_code is null then cur end as final_url, n as n_redirects, error_code, error_detail from chain where stopped"""),
]

FRESH_SQL = """select request_id, ts, url_key, case when age <= 300000000 then sid end as snapshot_id,
    case when age <= 300000000 then age end as age_us, coalesce(age <= 300000000, false) as cache_hit
  from (select q.request_id, q.ts, q.url_key, s.sid, epoch_us(q.ts) - epoch_us(s.fetched_at) as age
    from requests q asof left join (select url_key, fetched_at, max(snapshot_id) as sid from snapshots group by all) s
      on q.url_key = s.url_key and q.ts >= s.fetched_at)"""


def rate_sql(source: str, step: int, burst: int) -> str:
    return f"""select * exclude (n, lead_us, peak), greatest(arrival_us, coalesce((n - 1) * {step} + peak - {burst - 1} * {step}, arrival_us)) as admitted_us,
        greatest(arrival_us, coalesce((n - 1) * {step} + peak - {burst - 1} * {step}, arrival_us)) - arrival_us as wait_us
      from (select *, max(lead_us) over (partition by host order by arrival_us, request_id rows between unbounded preceding and 1 preceding) as peak
        from (select *, arrival_us - (n - 1) * {step} as lead_us
          from (select *, row_number() over (partition by host order by arrival_us, request_id) as n from {source})))"""


ORACLES = {
    "redirect_chains": oracle(["hops", "resolutions"], "select * from chains", CHAINS_SQL),
    "classify_response": oracle(["fetch_log"], _CODED),
    "retry_outcome": oracle(["fetch_log"], "select * from decided", OUTCOME_SQL),
    "backoff_schedule": oracle(["fetch_log"], """select request_id, attempt, delay_us,
        cast(coalesce(sum(delay_us) over (partition by request_id order by attempt rows between unbounded preceding and 1 preceding), 0) as bigint) as planned_us
        from (select request_id, attempt, cast(case when attempt >= 3 then 0 else least(500000 * (2 ** attempt), 10000000) * 7 / 8 end as bigint) as delay_us from fetch_log)"""),
    "error_messages": oracle(["coded"], messages_sql("coded")),
    "outcome_metrics": oracle(["outcomes"], """select time_bucket(interval '10 minutes', ts) as window_start, host, count(*) as requests,
        count(error_code) as errors, count(error_code) / count(*) as error_rate, quantile_cont(latency_ms, 0.5) as p50_ms,
        quantile_cont(latency_ms, 0.95) as p95_ms, max(latency_ms) as max_ms from outcomes group by 1, 2"""),
    "fresh_snapshot": oracle(["requests", "snapshots"], FRESH_SQL),
    "ttl_admission": oracle(["requests"], f"""select r.request_id, r.ts, r.url_key, case when m.id is null then 'hit' else 'miss' end as verdict
        from requests r left join (select a.id from misses m join arr a on a.url_key = m.url_key and a.t = m.t) m on r.request_id = m.id""",
        [("arr", "select url_key, epoch_us(ts) as t, min(request_id) as id from requests group by all"),
         ("misses", f"""select url_key, min(t) as t from arr group by url_key
            union all
            select url_key, nt from (select m.url_key, (select min(a.t) from arr a where a.url_key = m.url_key and a.t > m.t + {DAY * 1_000_000}) as nt from misses m) where nt is not null""")]),
    "invalidate": oracle(["requests", "snapshots"], """select * from snapshots where url_key not in
        (select url_key from requests where url like '%/de/%')"""),
    "hot_set": oracle(["requests"], """select url_key, max(ts) as last_used, count(*) as uses from requests
        group by url_key order by last_used desc, url_key limit 100"""),
    "politeness_schedule": oracle(["requests"], """select request_id, host, n, greatest(0, n - 10) * 200000 as start_us
        from (select request_id, host, row_number() over (partition by host order by request_id) as n from requests)"""),
    "rate_limit_admission": oracle(["arrivals"], rate_sql("arrivals", 2_000_000, 3)),
}
