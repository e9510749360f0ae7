"""Attempt logs and redirect tables: outcomes, waiting times, final URLs, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.codes import ERROR_CODES, MESSAGES, PERMANENT, error_text
from crawlweave.functions.urls import resolve_url
from crawlweave.operators.admission import dns_guard, url_guard
from crawlweave.options import DEFAULTS


def response_code(status: Column, n_bytes: Column, max_bytes: int) -> Column:
    """Null for a good response; a body of exactly the limit is good."""
    return (
        F.when(status >= 500, "http_server_error")
        .when(status >= 400, "http_client_error")
        .when(n_bytes > max_bytes, "content_too_large")
    )


def classify_response(df: DataFrame, max_bytes: int = DEFAULTS.max_html_bytes) -> DataFrame:
    """Fill ``error_code`` and ``error_detail`` from ``status`` and ``n_bytes`` (or the bytes of ``html``)."""
    size = F.col("n_bytes") if "n_bytes" in df.columns else F.octet_length("html")
    known = F.col("error_code") if "error_code" in df.columns else F.lit(None).cast("string")
    code = F.coalesce(known, response_code(F.col("status"), size, max_bytes))
    detail = F.col("error_detail") if "error_detail" in df.columns else F.lit(None).cast("string")
    status = F.when(F.col("error_code").startswith("http_"), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return df.withColumn("error_code", code).withColumn("error_detail", F.coalesce(detail, status))


def retry_outcome(fetch_log: DataFrame, max_retries: int = DEFAULTS.max_retries,
                  max_bytes: int = DEFAULTS.max_html_bytes) -> DataFrame:
    """One row per request: the attempt that decided, its code and status.

    The first attempt that succeeds, fails for good or is number ``max_retries`` decides.
    """
    coded = classify_response(fetch_log, max_bytes)
    ends = (
        F.col("error_code").isNull() | F.col("error_code").isin(*PERMANENT) | (F.col("attempt") >= max_retries)
    )
    result = F.struct("attempt", "error_code", "error_detail", "status", "n_bytes", "url")
    decided = F.min_by(F.when(ends, result), F.when(ends, F.col("attempt")))
    # a log that stops early: its last attempt is all there is
    chosen = F.coalesce(F.col("_decided"), F.col("_last"))
    return (
        coded.groupBy("request_id")
        .agg(decided.alias("_decided"), F.max_by(result, "attempt").alias("_last"))
        .select(
            "request_id",
            (chosen["attempt"] + 1).alias("attempts_used"),
            chosen["error_code"].alias("error_code"),
            chosen["error_detail"].alias("error_detail"),
            chosen["status"].alias("status"),
            chosen["n_bytes"].alias("n_bytes"),
            F.col("_decided").isNotNull().alias("finished"),
        )
    )


def backoff_us(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    """Wait after an attempt: doubled each time up to the cap, less one eighth."""
    doubled = F.call_function("shiftleft", F.lit(base_ms * 1000).cast("bigint"), F.least(attempt, F.lit(30)).cast("int"))
    held = F.least(doubled, F.lit(cap_ms * 1000).cast("bigint"))
    return held - F.call_function("div", held, F.lit(8))


def backoff_schedule(fetch_log: DataFrame, base_ms: int = DEFAULTS.retry_base_ms, cap_ms: int = DEFAULTS.retry_cap_ms,
                     max_retries: int = DEFAULTS.max_retries) -> DataFrame:
    """Add ``delay_us`` after each attempt and ``planned_us`` before it. A window is one request's attempts."""
    before = Window.partitionBy("request_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return (
        fetch_log.select("request_id", "attempt")
        .withColumn("delay_us", F.when(F.col("attempt") < max_retries, backoff_us(F.col("attempt"), base_ms, cap_ms)).otherwise(F.lit(0)))
        .withColumn("planned_us", F.coalesce(F.sum("delay_us").over(before), F.lit(0)))
    )


def code_table(spark) -> DataFrame:
    rows = [(code, category, base, MESSAGES.get(code, "{}")) for code, category, base in ERROR_CODES]
    return spark.createDataFrame(rows, "error_code string, category string, base_text string, message string")


def error_messages(df: DataFrame) -> DataFrame:
    """Add ``error_category`` and ``error_message``. The code table has sixteen fixed rows."""
    text = error_text(F.col("base_text"), F.col("error_detail"))
    # a failed status shows as its base text with the status behind it
    return (
        df.join(F.broadcast(code_table(df.sparkSession)), "error_code", "left")
        .select(
            *df.columns,
            F.col("category").alias("error_category"),
            F.replace(F.col("message"), F.lit("{}"), text).alias("error_message"),
        )
    )


def hop_chains(hops: DataFrame, resolutions: DataFrame | None = None, blocked_hosts: DataFrame | None = None,
               max_redirects: int = DEFAULTS.max_redirects) -> DataFrame:
    """Where each redirecting ``url`` ends: final_url, n_redirects, error_code, error_detail.

    ``max_redirects`` self-joins of the hop table; every hop target is guarded first. Targets may be relative to
    ``url``. Of several targets the newest counts if hops have ``ts``, otherwise the first in order.
    """
    target = F.max_by("location", F.struct("ts", "location")) if "ts" in hops.columns else F.min("location")
    edges = hops.groupBy("url").agg(target.alias("_to"))
    # what can't be resolved is left as it is, for the guard to refuse
    edges = edges.withColumn("_to", F.coalesce(resolve_url(F.col("_to"), F.col("url")), "_to"))
    guarded = url_guard(edges, blocked_hosts=blocked_hosts, url="_to")
    if resolutions is not None:
        guarded = dns_guard(guarded, resolutions)
    step = guarded.select(
        F.col("url").alias("_key"), F.col("_to").alias("_next"),
        F.col("error_code").alias("_code"), F.col("error_detail").alias("_detail"),
    )
    ok = F.col("_code").isNull()
    chains = step.select(
        F.col("_key").alias("url"),
        F.when(ok, F.col("_next")).alias("_at"), F.when(ok, 1).otherwise(0).alias("n_redirects"),
        ok.alias("_live"), F.col("_code").alias("error_code"), F.col("_detail").alias("error_detail"),
    )
    for taken in range(1, max_redirects + 1):
        more = F.col("_live") & F.col("_next").isNotNull()
        over = more & F.lit(taken == max_redirects)
        refused = more & ~over & F.col("_code").isNotNull()
        moves = more & ~over & F.col("_code").isNull()
        # a finished chain gets a key of its own that no hop has, so finished rows spread evenly
        key = F.when(F.col("_live"), F.col("_at")).otherwise(F.concat(F.lit("\x00"), F.col("url")))
        chains = (
            chains.withColumn("_key", key).join(step, "_key", "left")
            .select(
                "url",
                F.when(moves, F.col("_next")).otherwise(F.col("_at")).alias("_at"),
                (F.col("n_redirects") + moves.cast("int")).alias("n_redirects"),
                moves.alias("_live"),
                F.when(over, "too_many_redirects").when(refused, F.col("_code")).otherwise(F.col("error_code")).alias("error_code"),
                F.when(over, f"exceeded {max_redirects} redirects").when(refused, F.col("_detail"))
                .otherwise(F.col("error_detail")).alias("error_detail"),
            )
        )
    return chains.select(
        "url", F.when(F.col("error_code").isNull(), F.col("_at")).alias("final_url"), "n_redirects", "error_code", "error_detail"
    )


def redirect_chains(urls: DataFrame, hops: DataFrame, resolutions: DataFrame | None = None,
                    blocked_hosts: DataFrame | None = None, max_redirects: int = DEFAULTS.max_redirects) -> DataFrame:
    """Follow hops from each distinct ``url``; one without a hop is its own final URL.

    Chains are worked out on the hop table alone, so the URLs, most of which do not redirect,
    are joined once.
    """
    chains = hop_chains(hops, resolutions, blocked_hosts, max_redirects)
    return (
        urls.select("url").distinct().join(chains, "url", "left")
        .select(
            "url",
            F.when(F.col("error_code").isNull(), F.coalesce("final_url", "url")).alias("final_url"),
            F.coalesce("n_redirects", F.lit(0)).alias("n_redirects"),
            "error_code", "error_detail",
        )
    )


def outcome_metrics(outcomes: DataFrame, window: str = "10 minutes", exact: bool = False,
                    host: str = "host", ts: str = "ts") -> DataFrame:
    """Requests, error share and latency per host and tumbling window.

    ``exact`` keeps a count per distinct millisecond value, which the request time limit bounds.
    """
    def quantile(q: float) -> Column:
        if exact:
            return F.percentile("latency_ms", F.lit(q))
        return F.percentile_approx("latency_ms", F.lit(q)).cast("double")

    failed = F.count_if(F.col("error_code").isNotNull())
    return (
        outcomes.groupBy(F.window(ts, window).alias("_w"), F.col(host).alias("host"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            failed.alias("errors"),
            (failed / F.count(F.lit(1))).alias("error_rate"),
            quantile(0.5).alias("p50_ms"),
            quantile(0.95).alias("p95_ms"),
            F.max("latency_ms").alias("max_ms"),
        )
        .select(F.col("_w.start").alias("window_start"), "host", "requests", "errors", "error_rate", "p50_ms", "p95_ms", "max_ms")
    )
