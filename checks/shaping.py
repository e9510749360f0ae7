"""Queries on sources and sinks, images, slices and the whole flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.admission import ROBOTS_ASOF, URL_RE, _PARSE, _VALIDATE, dns_sql, guard_sql, parts_sql, robots_lines_sql, robots_verdict_sql
from checks.content import filename_sql, images_sql, markdown_sql, region_sql, title_sql
from checks.inputs import oracle, table
from checks.timeline import CHAINS_SQL, FRESH_SQL, OUTCOME_SQL, messages_sql, rate_sql
from crawlweave.durability import shared_folder
from crawlweave.operators import extract, images, output
from crawlweave.options import Options
from crawlweave.plans.fetch_flow import fetch_flow, fetch_flow_outputs
from crawlweave.sources.pages import load_pages
from crawlweave.sources.results import write_results

FLOW_OPTIONS = Options(rate_per_second=0.001, rate_burst=2)


def _refs(s, d):
    """Image references with their page's address."""
    pages = table(s, d, "image_pages")
    contents = extract.main_region(pages, keep=("url",)).select("page_id", "url", "content")
    return extract.image_refs(contents)


def _resolved(s, d):
    return images.resolve_image_urls(_refs(s, d))


def _slices_input(s, d):
    return table(s, d, "documents").selectExpr(
        "doc_id", "text as content", "cast(doc_id * 37 % 3000 as int) as start_index",
        "cast(case doc_id % 3 when 0 then 0 else doc_id * 53 % 2000 end as int) as max_length",
    )


def _written(s, d):
    """Round trip: write the outcomes in folders and read them back."""
    folder = shared_folder(s, "results")
    write_results(table(s, d, "outcomes"), folder, mode="overwrite", host_buckets=2)
    return s.read.parquet(folder).select("request_id", "ts", "host", "latency_ms", "error_code")


def _formatted(s, d):
    """Landed pages to the first slice of their markdown with the notes on what is left."""
    pages = extract.extract_pages(load_pages(s, f"{d}/pages.parquet"))
    shaped = pages.select(
        "page_id", "title", F.col("markdown").alias("content"), F.lit(0).alias("start_index"), F.lit(1500).alias("max_length"),
        output.remaining_images(F.col("page_id").cast("int") % 7, F.lit(0), F.lit(3)).alias("remaining_images"),
    )
    return output.format_results(output.paginate(shaped)).select("page_id", "title", "remaining_content", "remaining_images", "response")


QUERIES = {
    "load_pages": lambda s, d: load_pages(s, f"{d}/pages.parquet"),
    "write_results": _written,
    "resolve_image_urls": _resolved,
    "origin_policy": lambda s, d: images.origin_policy(
        _resolved(s, d).withColumn("allow_cross_origin", F.col("page_id") % 2 == 0)),
    "select_images": lambda s, d: images.select_images(
        _refs(s, d), table(s, d, "requests").select("request_id", "page_id", "image_start", "image_count")),
    "fit_dimensions": lambda s, d: images.fit_dimensions(table(s, d, "image_meta")),
    "strip_layout": lambda s, d: images.strip_layout(table(s, d, "image_meta")),
    "image_size_gate": lambda s, d: images.image_size_gate(table(s, d, "image_meta")),
    "safe_filename": lambda s, d: images.safe_filename(
        _resolved(s, d).withColumn("mime", F.concat(F.lit("image/"), F.element_at(F.split("filename", r"\."), -1)))),
    "ext_from_mime": lambda s, d: table(s, d, "image_meta").select(
        "page_id", "idx", images.ext_from_mime(F.col("mime"), F.when(F.col("page_id") % 2 == 0, "png").otherwise("jpeg")).alias("ext")),
    "image_base64": lambda s, d: images.image_base64(
        table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))).drop("data"),
    "paginate": lambda s, d: output.paginate(_slices_input(s, d)),
    "all_slices": lambda s, d: output.all_slices(table(s, d, "documents").select("doc_id", F.col("text").alias("content")), 1500),
    "format_results": _formatted,
    "fetch_flow": lambda s, d: fetch_flow(
        table(s, d, "request_json"), table(s, d, "pages"), snapshots=table(s, d, "snapshots"),
        resolutions=table(s, d, "resolutions"), robots_snapshots=table(s, d, "robots_snapshots"), hops=table(s, d, "hops"),
        fetch_log=table(s, d, "fetch_log"), blocked_hosts=table(s, d, "blocked_hosts"), options=FLOW_OPTIONS),
    "fetch_flow_images": lambda s, d: fetch_flow_outputs(
        table(s, d, "image_request_json"), table(s, d, "image_pages"), table(s, d, "landed_images"), snapshots=table(s, d, "snapshots"),
        resolutions=table(s, d, "resolutions"), robots_snapshots=table(s, d, "robots_snapshots"), hops=table(s, d, "hops"),
        fetch_log=table(s, d, "fetch_log"), blocked_hosts=table(s, d, "blocked_hosts"), options=FLOW_OPTIONS)[1],
}

_REFS = [
    *region_sql("image_pages"),
    *images_sql("(select r.page_id, r.content, p.url from region r join image_pages p using (page_id))"),
    ("refs", "select page_id, url, idx, src, alt, filename from images"),
]

_ADDRESS = """case when regexp_matches(src, '(?i)\\Ahttps?://') then src when regexp_matches(src, '\\A[a-zA-Z][a-zA-Z0-9+.\\-]*:') then null
    when starts_with(src, '//') then lower(sc) || ':' || src when starts_with(src, '/') then org || src
    when starts_with(src, '?') then org || pth || src
    else org || case when pth = '' then '/' else regexp_replace(pth, '[^/]*\\z', '') end || regexp_replace(src, '\\A(?:\\./)+', '') end"""

_RESOLVED = [
    *_REFS,
    ("rbase", f"""select *, regexp_extract(url, '^([a-zA-Z]+)://', 1) as sc, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) as org,
        regexp_extract(url, '{URL_RE}', 3) as pth from refs"""),
    ("resolved", f"select page_id, url, idx, src, alt, filename, image_url from (select *, {_ADDRESS} as image_url from rbase) where image_url is not null"),
]

_EXT = """case when contains(mime, 'jpeg') or contains(mime, 'jpg') then 'jpg' when contains(mime, 'png') then 'png'
    when contains(mime, 'gif') then 'gif' when contains(mime, 'webp') then 'webp' else {other} end"""

_FLOW = [
    ("f_parsed", _PARSE.replace("from request_json", "from request_json")),
    ("f_valid", _VALIDATE.replace("from loose_requests", "from (select * exclude (error_code), error_code as parse_code from f_parsed)")
     .replace("case\n  when url = ''", "case when parse_code is not null then null\n  when url = ''")),
    ("f_checked", "select * exclude (error_code, error_detail, parse_code), coalesce(parse_code, error_code) as code0, error_detail as detail0 from f_valid"),
    ("f_parts", parts_sql("f_checked")),
    ("f_guard", guard_sql("f_parts")),
    ("f_pre", """select * exclude (error_code, error_detail, code0, detail0), coalesce(code0, error_code) as error_code,
        case when code0 is not null then detail0 else error_detail end as error_detail from f_guard"""),
    *[(f"f_{n}", q.replace("r_class", "f_r_class").replace("r_bad", "f_r_bad").replace("g_class", "f_g_class")) for n, q in dns_sql("f_pre")],
    ("f_keyed", "select *, lower(hostport) as host_key, sha256(url) as url_key from f_dns"),
    ("f_fresh", FRESH_SQL.replace("from requests q", "from f_keyed q")),
    ("f_cached", """select k.*, f.snapshot_id, f.cache_hit and k.error_code is null as from_cache from f_keyed k join f_fresh f using (request_id)"""),
    ("f_arrive", """select request_id, epoch_us(ts) as arrival_us, case when error_code is null and not from_cache then host
        else 'alone ' || cast(request_id as string) end as host from f_cached"""),
    ("f_rate", rate_sql("f_arrive", 1_000_000_000, 2)),
    ("f_rob", ROBOTS_ASOF.replace("from requests r", "from f_keyed r")),
    ("f_ask", """select c.request_id, b.robots_id, c.path, c.ignore_robots or c.error_code is not null or c.from_cache as ignore_robots
        from f_cached c join f_rob b using (request_id)"""),
    *robots_lines_sql(), *robots_verdict_sql("f_ask"),
    *[(n, q.replace("no_hosts", "blocked_hosts")) for n, q in CHAINS_SQL if n != "no_hosts"], *OUTCOME_SQL,
    ("f_all", """select c.*, t.admitted_us, coalesce(h.final_url, c.url) as final_url, v.robots_verdict, h.error_code as hop_code, h.error_detail as hop_detail,
        o.error_code as out_code, o.error_detail as out_detail
        from f_cached c join f_rate t using (request_id) join rverdict v using (request_id) left join chains h on c.url = h.url
        left join decided o on c.request_id = o.request_id"""),
    ("f_coded", """select * exclude (error_code, error_detail),
        case when error_code is not null then error_code when robots_verdict = 'forbidden' then 'robots_forbidden' when robots_verdict = 'disallowed' then 'robots_disallowed'
             when from_cache then null when hop_code is not null then hop_code else out_code end as error_code,
        case when error_code is not null then error_detail when robots_verdict = 'forbidden' then null when robots_verdict = 'disallowed' then 'for URL ' || url
             when from_cache then null when hop_code is not null then hop_detail else out_detail end as error_detail from f_all"""),
    *region_sql("pages"), *markdown_sql("region"), *images_sql("region"),
    ("f_pages", f"""select page_id, {title_sql('html')} as title, content, markdown, len(l) as n_images, error_code as page_code
        from ia join md using (page_id) join (select page_id, html from pages) using (page_id)"""),
    ("f_found", """select c.*, case when c.error_code is null then case when c.from_cache then s.page_id else p.page_id end end as found_page
        from f_coded c left join snapshots s on c.snapshot_id = s.snapshot_id left join (select url, max(page_id) as page_id from pages group by url) p on c.final_url = p.url"""),
    ("f_final", """select f.* exclude (error_code, error_detail, path), p.title, p.content as html, p.markdown, p.n_images,
        case when f.error_code is not null then f.error_code when f.found_page is null then 'fetch_failed' else p.page_code end as error_code,
        case when f.error_code is not null then f.error_detail when f.found_page is null then 'no landed page' end as error_detail
        from f_found f left join f_pages p on f.found_page = p.page_id"""),
    ("f_text", """select *, case when raw then html else markdown end as body from f_final"""),
    ("f_cut", """select request_id, ts, url, host, final_url, from_cache, admitted_us, error_code, error_detail,
        case when error_code is null then title end as title, case when error_code is null then case when raw then 'raw' else 'markdown' end end as content_type,
        case when error_code is not null then null when start_index >= length(body) then '' when max_length = 0 then substr(body, start_index + 1) else substr(body, start_index + 1, max_length) end as content,
        cast(case when error_code is not null then null when start_index >= length(body) or max_length = 0 then 0 else greatest(0, length(body) - start_index - max_length) end as int) as remaining_content,
        cast(case when error_code is not null then null when image_start >= n_images then 0 else greatest(0, n_images - image_start - image_count) end as int) as remaining_images
        from f_text"""),
    ("f_said", messages_sql("f_cut")),
]

RESPONSE_SQL = """case when coalesce(title, '') <> '' then '# ' || title || chr(10) || chr(10) else '' end || content
    || case when remaining_content > 0 then chr(10) || chr(10) || '[Content truncated. ' || cast(remaining_content as string) || ' characters remaining. Use start_index to continue.]' else '' end
    || case when remaining_images > 0 then chr(10) || chr(10) || '[' || cast(remaining_images as string) || ' more images available. Use imageStartIndex to continue.]' else '' end"""

FLOW_TABLES = ["request_json", "requests", "blocked_hosts", "resolutions", "robots_snapshots", "snapshots", "hops", "fetch_log"]
FLOW_ORACLE = oracle(FLOW_TABLES, f"""select request_id, ts, url, host, final_url, from_cache, admitted_us, error_code, error_message, title, content_type, content,
    remaining_content, remaining_images, {RESPONSE_SQL} as response from f_said""", _FLOW)

_IMAGE_FLOW = [
    *[(n, q.replace("from request_json", "from image_request_json").replace("from pages", "from image_pages")) for n, q in _FLOW[: [n for n, _ in _FLOW].index("f_coded") + 1]],
    *region_sql("image_pages"), *images_sql("region"),
    ("f_found", """select c.*, case when c.from_cache then s.page_id else p.page_id end as found_page from f_coded c left join snapshots s on c.snapshot_id = s.snapshot_id
        left join (select url, max(page_id) as page_id from image_pages group by url) p on c.final_url = p.url where c.error_code is null and c.images_enabled"""),
    ("i_cut", """select * exclude (l, path), unnest(range(len(cut))) as k, unnest(cut) as img from (select f.* exclude (error_code, url), f.final_url as url, l, l[image_start + 1:image_start + image_count] as cut
        from f_found f join ia on f.found_page = ia.page_id where ia.error_code is null)"""),
    ("i_base", f"""select *, img.src as src, img.alt as img_alt, {filename_sql('img.src')} as filename, regexp_extract(url, '^([a-zA-Z]+)://', 1) as sc,
        regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) as org, regexp_extract(url, '{URL_RE}', 3) as pth from i_cut"""),
    ("i_kept", f"""select * from (select *, {_ADDRESS} as image_url from i_base) where image_url is not null
        and (allow_cross_origin or lower(regexp_extract(image_url, '^([a-zA-Z]+://[^/?#]+)', 1)) = lower(org))"""),
    ("i_landed", "select distinct on (image_url) * from landed_images order by image_url, n_bytes desc, mime desc, width desc nulls last, height desc nulls last"),
    ("i_met", """select i.*, m.mime, m.width as w, m.height as h, case when m.image_url is null then 'fetch_failed' when m.n_bytes > 10485760 then 'image_too_large'
        when not coalesce(m.width > 0 and m.height > 0, false) then 'not_an_image' end as image_error from i_kept i left join i_landed m using (image_url)"""),
    ("i_fit", """select *, case when image_error is null then case when w <= image_max_width and h <= image_max_height then w
          when image_max_width * h <= image_max_height * w then image_max_width else greatest(1, w * image_max_height // h) end end as fw,
        case when image_error is null then case when w <= image_max_width and h <= image_max_height then h
          when image_max_width * h <= image_max_height * w then greatest(1, h * image_max_width // w) else image_max_height end end as fh from i_met"""),
    ("i_all", f"""select *, layout in ('merged', 'both') and n > 1 as strip, coalesce(nullif(regexp_replace(regexp_replace(filename, '\\.[^./]*\\z', ''), '[^a-zA-Z0-9_\\-]', '_', 'g'), ''), 'image')
          || '_' || cast(k as string) || '.' || {_EXT.format(other="'jpg'")} as safe_name
        from (select *, count(fw) over r as n, max(fw) over r as mw, sum(fh) over r as sh, coalesce(sum(fh) over (partition by request_id order by k rows between unbounded preceding and 1 preceding), 0) as y
          from i_fit window r as (partition by request_id))"""),
]

IMAGE_FLOW_ORACLE = oracle(["image_request_json", "image_pages", "landed_images", *[t for t in FLOW_TABLES if t != "request_json"]], """
    select request_id, cast(k + 1 as int) as position, src, image_url, img_alt as alt, mime, cast(fw as int) as width, cast(fh as bigint) as height,
      cast(case when strip and fw is not null then (mw - fw) // 2 end as bigint) as x_offset, cast(case when strip and fw is not null then y end as bigint) as y_offset,
      image_quality as quality, safe_name as name, case when save_to_file and image_error is null then strftime(ts, '%Y-%m-%d') || '/' || cast(request_id as string) || '/' || safe_name end as saved_as,
      output_base64 and image_error is null as as_base64, image_error from i_all
    union all
    select distinct on (request_id) request_id, 0, 'merged', null, 'Merged ' || cast(n as string) || ' images', 'image/jpeg', cast(mw as int), cast(sh as bigint), 0, 0, image_quality, 'merged.jpg',
      case when save_to_file then strftime(ts, '%Y-%m-%d') || '/' || cast(request_id as string) || '/merged.jpg' end, output_base64, null from i_all where strip""", _IMAGE_FLOW)

ORACLES = {
    "load_pages": "select page_id, url, html from pages",
    "write_results": oracle(["outcomes"], "select request_id, ts, host, latency_ms, error_code from outcomes"),
    "resolve_image_urls": oracle(["image_pages"], "select * from resolved", _RESOLVED),
    "origin_policy": oracle(["image_pages"], """select *, page_id % 2 = 0 as allow_cross_origin from resolved
        where page_id % 2 = 0 or lower(regexp_extract(image_url, '^([a-zA-Z]+://[^/?#]+)', 1)) = lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1))""", _RESOLVED),
    "select_images": oracle(["image_pages", "requests"], """select request_id, page_id, image_start, image_count,
        cast(case when image_start >= n then 0 else greatest(0, n - image_start - image_count) end as int) as remaining_images,
        cast(idx - image_start as int) as image_no, src, alt, filename
        from requests join (select *, count(*) over (partition by page_id) as n from refs) using (page_id)
        where idx >= image_start and idx < image_start + image_count""", _REFS),
    "fit_dimensions": oracle(["image_meta"], """select *, cast(case when width is null or height is null then null when width <= 1000 and height <= 1600 then width
          when 1000 * height <= 1600 * width then 1000 else greatest(1, width * 1600 // height) end as int) as fit_width,
        cast(case when width is null or height is null then null when width <= 1000 and height <= 1600 then height
          when 1000 * height <= 1600 * width then greatest(1, height * 1000 // width) else 1600 end as int) as fit_height from image_meta"""),
    "strip_layout": oracle(["image_meta"], """select page_id, 0 as position, 'merged' as src, max(width) as width, cast(sum(height) as bigint) as height, cast(0 as bigint) as x_offset,
          cast(0 as bigint) as y_offset, 'Merged ' || cast(count(width) as string) || ' images' as alt from image_meta group by page_id having count(width) > 1
        union all
        select page_id, idx + 1, src, width, cast(height as bigint), cast(case when n > 1 and width is not null then (mw - width) // 2 end as bigint),
          cast(case when n > 1 and width is not null then y end as bigint), null
        from (select *, count(width) over (partition by page_id) as n, max(width) over (partition by page_id) as mw,
            coalesce(sum(height) over (partition by page_id order by idx rows between unbounded preceding and 1 preceding), 0) as y from image_meta)"""),
    "image_size_gate": oracle(["image_meta"], "select * from image_meta where n_bytes <= 10485760"),
    "safe_filename": oracle(["image_pages"], f"""select *, coalesce(nullif(regexp_replace(regexp_replace(filename, '\\.[^./]*\\z', ''), '[^a-zA-Z0-9_\\-]', '_', 'g'), ''), 'image')
        || '_' || cast(idx as string) || '.' || {_EXT.format(other="'jpg'")} as safe_name
        from (select *, 'image/' || split_part(filename, '.', -1) as mime from resolved)""", _RESOLVED),
    "ext_from_mime": oracle(["image_meta"], f"select page_id, idx, {_EXT.format(other=chr(10) + ' case when page_id % 2 = 0 then ' + chr(39) + 'png' + chr(39) + ' else ' + chr(39) + 'jpg' + chr(39) + ' end')} as ext from image_meta"),
    "image_base64": 'select doc_id, to_base64(encode(text)) as "base64" from documents',
    "paginate": """select doc_id, start_index, max_length, case when start_index >= n then '' when max_length = 0 then substr(text, start_index + 1) else substr(text, start_index + 1, max_length) end as content,
        cast(case when start_index >= n or max_length = 0 then 0 else greatest(0, n - start_index - max_length) end as int) as remaining_content
        from (select doc_id, text, length(text) as n, cast(doc_id * 37 % 3000 as int) as start_index,
              cast(case doc_id % 3 when 0 then 0 else doc_id * 53 % 2000 end as int) as max_length from documents)""",
    "all_slices": """select doc_id, cast(k as int) as slice_no, cast(k * 1500 as int) as start_index, substr(text, k * 1500 + 1, 1500) as slice,
        cast(greatest(0, length(text) - k * 1500 - 1500) as int) as remaining_content
        from (select doc_id, text, unnest(range(greatest(1, (length(text) + 1499) // 1500))) as k from documents)""",
    "format_results": oracle([], f"""select page_id, title, remaining_content, remaining_images, {RESPONSE_SQL} as response from (
        select page_id, title, substr(markdown, 1, 1500) as content, cast(greatest(0, length(markdown) - 1500) as int) as remaining_content,
          cast(greatest(0, page_id % 7 - 3) as int) as remaining_images
        from md join (select page_id, {title_sql('html')} as title from pages) using (page_id))""",
        [*region_sql("pages"), *markdown_sql("region")]),
    "fetch_flow": FLOW_ORACLE,
    "fetch_flow_images": IMAGE_FLOW_ORACLE,
}
