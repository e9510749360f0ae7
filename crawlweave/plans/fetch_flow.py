"""The whole flow over tables: from JSON requests to the answer each caller gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.durability import durable, written
from crawlweave.functions.times import epoch_us
from crawlweave.operators.admission import dns_guard, url_guard, url_parts
from crawlweave.operators.extract import extract_pages
from crawlweave.operators.fetchlog import error_messages, hop_chains, retry_outcome
from crawlweave.operators.freshness import fresh_snapshot
from crawlweave.operators.images import answer_images
from crawlweave.operators.ordered import newest_within
from crawlweave.operators.output import format_results, paginate, remaining_images
from crawlweave.operators.rate import rate_limit_admission
from crawlweave.operators.requests import parse_requests, validate_requests, with_cache_key
from crawlweave.operators.robots import robots_asof, robots_gate
from crawlweave.operators.spread import left_join_spread
from crawlweave.options import DEFAULTS, Options

RESULT_COLUMNS = [
    "request_id", "ts", "url", "host", "final_url", "from_cache", "admitted_us", "error_code", "error_message", "title",
    "content_type", "content", "remaining_content", "remaining_images", "response",
]


def admitted_requests(requests: DataFrame, resolutions: DataFrame | None = None,
                      blocked_hosts: DataFrame | None = None, options: Options = DEFAULTS) -> DataFrame:
    """Parse, check the limits and guard every URL. Row by row but for the two host look-ups."""
    parsed = validate_requests(parse_requests(requests, options=options))
    guarded = url_guard(parsed, options.allow_localhost, blocked_hosts=blocked_hosts)
    if resolutions is not None:
        guarded = dns_guard(guarded, resolutions, options.allow_private)
    parts = url_parts(guarded.drop("host"))
    return with_cache_key(parts.drop("scheme", "port", "origin", "query", "robots_url"))


def _fails(df: DataFrame, when, code, detail) -> DataFrame:
    """Set code and detail where no earlier step has failed."""
    new = F.col("error_code").isNull() & when
    return df.withColumn("error_detail", F.when(new, detail).otherwise(F.col("error_detail"))).withColumn(
        "error_code", F.when(new, code).otherwise(F.col("error_code"))
    )


def answers(requests: DataFrame, extracted: DataFrame) -> DataFrame:
    """Join the page texts by ``found_page`` and write the answers; failed requests need no text."""
    texts = extracted.select(
        F.col("page_id").alias("found_page"), "title", F.col("content").alias("_html"), "markdown",
        F.size("images").alias("_images"), F.col("error_code").alias("_page_code"),
    )
    joined = left_join_spread(requests, texts, "found_page")
    joined = _fails(joined, F.col("found_page").isNull(), "fetch_failed", F.lit("no landed page"))
    joined = _fails(joined, F.col("_page_code").isNotNull(), F.col("_page_code"), F.lit(None).cast("string"))
    failed = F.col("error_code").isNotNull()
    shaped = (
        joined.withColumn("title", F.when(~failed, F.col("title")))
        .withColumn("content", F.when(~failed, F.when(F.col("raw"), F.col("_html")).otherwise(F.col("markdown"))))
        .withColumn("content_type", F.when(~failed, F.when(F.col("raw"), "raw").otherwise("markdown")))
        .withColumn("remaining_images", F.when(~failed, remaining_images(F.col("_images"), F.col("image_start"), F.col("image_count"))))
    )
    sliced = paginate(shaped).withColumn("remaining_content", F.when(~failed, F.col("remaining_content")))
    return error_messages(format_results(sliced)).select(*RESULT_COLUMNS)


def image_answers(requests: DataFrame, extracted: DataFrame, image_meta: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The image table: the images of the requests that asked for some and got a page. ``requests`` as for ``answers``."""
    asked = requests.where(F.col("error_code").isNull() & F.col("found_page").isNotNull() & F.col("images_enabled")).select(
        "request_id", "ts", F.col("found_page").alias("page_id"), F.col("final_url").alias("url"), "image_start", "image_count",
        "image_max_width", "image_max_height", "image_quality", "allow_cross_origin", "output_base64", "save_to_file", "layout",
    )
    return answer_images(asked, extracted.where("error_code is null").select("page_id", "images"), image_meta, options.max_image_bytes)


def fetch_flow(requests: DataFrame, pages: DataFrame | None, **tables) -> DataFrame:
    """One answer or error per request.

    ``requests`` has request_id, ts and args (JSON). Every URL is guarded, also one that a stored
    snapshot could answer. A hit skips the rate limit, robots and the fetch outcome. The text of a
    page is worked out only if a request gets it, and once; pass ``extracted`` to use stored
    texts. ``newest`` and ``limit`` are the as-of join and the rate limit to use. The other tables
    and ``options`` are those of ``_routed``.
    """
    return answers(*_routed(requests, pages, **tables))


def fetch_flow_outputs(requests: DataFrame, pages: DataFrame | None, image_meta: DataFrame, **tables) -> tuple[DataFrame, DataFrame]:
    """The answers of ``fetch_flow`` and the table of their images, from one run of the flow.

    Requests on their way to a page and the texts of the pages they get are written once, and both results read them.
    ``image_meta`` has image_url, mime, width, height, n_bytes. A hit has images too.
    """
    rows, extracted = _routed(requests, pages, **tables)
    if not rows.isStreaming and tables.get("extracted") is None:
        extracted = durable(extracted)
    return answers(rows, extracted), image_answers(rows, extracted, image_meta, tables.get("options", DEFAULTS))


def _routed(requests: DataFrame, pages: DataFrame | None, *, extracted: DataFrame | None = None,
            snapshots: DataFrame | None = None, resolutions: DataFrame | None = None,
            robots_snapshots: DataFrame | None = None, hops: DataFrame | None = None,
            fetch_log: DataFrame | None = None, blocked_hosts: DataFrame | None = None,
            options: Options = DEFAULTS, newest=newest_within, limit=rate_limit_admission) -> tuple[DataFrame, DataFrame]:
    """Requests with the page that answers them or an error, and the texts of those pages."""
    rows = admitted_requests(requests, resolutions, blocked_hosts, options)
    if snapshots is not None:
        if not rows.isStreaming:
            # the as-of join reads the rows for their instants and again for its answers; parsing and guards run once
            rows = written(rows, "admitted")
        rows = fresh_snapshot(rows, snapshots, options.cache_ttl_s, newest).drop("age_us")
        rows = rows.withColumn("from_cache", F.col("cache_hit") & F.col("error_code").isNull()).drop("cache_hit")
    else:
        rows = rows.withColumn("snapshot_id", F.lit(None).cast("bigint")).withColumn("from_cache", F.lit(False))

    if not rows.isStreaming:
        # the rate limit uses the rows more than once; cut here, parsing, guards and freshness run once
        rows = durable(rows)
    # rows that do not fetch wait for nobody and leave no state behind
    fetches = F.col("error_code").isNull() & ~F.col("from_cache") & F.col("host").isNotNull() & F.lit(options.limit_rate)
    waiting, others = rows.where(fetches), rows.where(~fetches).withColumn("admitted_us", epoch_us("ts"))
    waiting = limit(waiting, options.rate_per_second, options.rate_burst, host="host", ts="ts").drop("arrival_us", "wait_us")
    rows = waiting.unionByName(others)

    if robots_snapshots is not None:
        rows = robots_asof(rows, robots_snapshots, options.robots_ttl_s, newest).drop("robots_age_us")
        asked = rows.withColumn("_ignore", F.col("ignore_robots"))
        asked = asked.withColumn("ignore_robots", F.col("_ignore") | F.col("error_code").isNotNull() | F.col("from_cache"))
        gated = robots_gate(asked, robots_snapshots, options.user_agent)
        verdict = F.col("robots_verdict")
        rows = _fails(
            gated, verdict != "allowed",
            F.when(verdict == "forbidden", "robots_forbidden").otherwise("robots_disallowed"),
            F.when(verdict == "disallowed", F.concat(F.lit("for URL "), F.col("url"))),
        ).drop("robots_verdict", "robots_id", "ignore_robots", "_ignore")

    if hops is not None:
        chains = hop_chains(hops, resolutions, blocked_hosts, options.max_redirects).select(
            "url", "final_url", F.col("error_code").alias("_hop_code"), F.col("error_detail").alias("_hop_detail")
        )
        rows = rows.join(chains, "url", "left")
        rows = _fails(rows, ~F.col("from_cache") & F.col("_hop_code").isNotNull(), F.col("_hop_code"), F.col("_hop_detail"))
        rows = rows.drop("_hop_code", "_hop_detail").withColumn("final_url", F.coalesce("final_url", "url"))
    else:
        rows = rows.withColumn("final_url", F.col("url"))

    if fetch_log is not None:
        outcome = retry_outcome(fetch_log, options.max_retries, options.max_html_bytes).select(
            "request_id", F.col("error_code").alias("_out_code"), F.col("error_detail").alias("_out_detail")
        )
        rows = rows.join(outcome, "request_id", "left")
        rows = _fails(rows, ~F.col("from_cache") & F.col("_out_code").isNotNull(), F.col("_out_code"), F.col("_out_detail"))
        rows = rows.drop("_out_code", "_out_detail")

    rows = _with_page(rows, extracted if pages is None else pages, snapshots)
    if extracted is None:
        if not rows.isStreaming:
            rows = durable(rows)
        wanted = rows.where("found_page is not null").select(F.col("found_page").alias("page_id")).distinct()
        extracted = extract_pages(pages.join(wanted, "page_id", "left_semi"), options.max_html_bytes)
    return rows, extracted


def _with_page(rows: DataFrame, pages: DataFrame, snapshots: DataFrame | None) -> DataFrame:
    """Add ``found_page``: of the snapshot for a hit, of the final URL for a fetch, none for an error.

    Of several pages of a URL the newest counts if pages have ``fetched_at``, otherwise the greatest id.
    """
    good = F.col("error_code").isNull()
    newest = F.max_by("page_id", F.struct("fetched_at", "page_id")) if "fetched_at" in pages.columns else F.max("page_id")
    landed = pages.groupBy(F.col("url").alias("final_url")).agg(newest.alias("_landed"))
    rows = rows.join(landed, "final_url", "left")
    if snapshots is None:
        return rows.withColumn("found_page", F.when(good, F.col("_landed"))).drop("_landed")
    stored = snapshots.select("snapshot_id", F.col("page_id").alias("_stored"))
    return (
        left_join_spread(rows, stored, "snapshot_id")
        .withColumn("found_page", F.when(good, F.when(F.col("from_cache"), F.col("_stored")).otherwise(F.col("_landed"))))
        .drop("_landed", "_stored")
    )
