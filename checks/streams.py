"""Queries that run as streams over the given tables, into a table that is read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.inputs import oracle, table
from checks.shaping import FLOW_OPTIONS, FLOW_ORACLE
from checks.timeline import DAY, ORACLES as TIMELINE
from crawlweave.durability import shared_folder
from crawlweave.operators.extract import extract_pages
from crawlweave.sources.results import write_result_stream
from crawlweave.streaming.flow import fetch_flow_stream, outcome_metrics_stream, run_available
from crawlweave.streaming.stateful import rate_limit_stream, ttl_admission_stream, use_rocksdb


def _streamed(s, d, name, columns):
    """A derived table as a stream: stored once, then read as new files."""
    folder = shared_folder(s, f"in-{name}")
    rows = table(s, d, name).select(*columns)
    rows.write.parquet(folder)
    return s.readStream.schema(rows.schema).parquet(folder)


def _result(s, stream, name):
    use_rocksdb(s)
    folder = shared_folder(s, f"out-{name}")
    run_available(stream, f"{folder}/rows", f"{folder}/state")
    return s.read.schema(stream.schema).parquet(f"{folder}/rows")


def _ttl(s, d):
    stream = ttl_admission_stream(_streamed(s, d, "requests", ["request_id", "ts", "url_key"]), ttl_s=DAY)
    return _result(s, stream, "ttl").drop("late")


def _rate(s, d):
    stream = rate_limit_stream(
        _streamed(s, d, "arrivals", ["request_id", "host", "arrival_us"]), per_second=0.5, burst=3, arrival_us="arrival_us")
    return _result(s, stream, "rate").drop("late")


def _flow(s, d):
    pages = shared_folder(s, "extracted")
    extract_pages(table(s, d, "pages")).write.parquet(pages)
    stream = fetch_flow_stream(
        _streamed(s, d, "request_json", ["request_id", "ts", "args"]), s.read.parquet(pages), snapshots=table(s, d, "snapshots"),
        resolutions=table(s, d, "resolutions"), robots_snapshots=table(s, d, "robots_snapshots"), hops=table(s, d, "hops"),
        fetch_log=table(s, d, "fetch_log"), blocked_hosts=table(s, d, "blocked_hosts"), options=FLOW_OPTIONS)
    return _result(s, stream, "flow")


def _metrics(s, d):
    stream = outcome_metrics_stream(_streamed(s, d, "outcomes", ["ts", "host", "error_code", "latency_ms"]))
    return _result(s, stream, "metrics").select("window_start", "host", "requests", "errors", "error_rate", "max_ms")


def _written(s, d):
    folder = shared_folder(s, "written")
    write_result_stream(_streamed(s, d, "requests", ["request_id", "ts", "host", "url"]), f"{folder}/rows", f"{folder}/state", host_buckets=4).awaitTermination()
    rows = s.read.parquet(f"{folder}/rows")
    return rows.select("request_id", "ts", "host", "url", F.col("fetch_date").cast("date").alias("fetch_date"))


QUERIES = {
    "ttl_admission_stream": _ttl, "rate_limit_stream": _rate, "fetch_flow_stream": _flow, "outcome_metrics_stream": _metrics,
    "write_result_stream": _written,
}

# a stream over all rows has to give what the batch form gives
ORACLES = {
    "ttl_admission_stream": TIMELINE["ttl_admission"],
    "rate_limit_stream": TIMELINE["rate_limit_admission"],
    "fetch_flow_stream": FLOW_ORACLE,
    # windows that the watermark, an hour behind the newest row, has passed
    "outcome_metrics_stream": oracle(["outcomes"], """select time_bucket(interval '10 minutes', ts) as window_start, host, count(*) as requests,
        count(error_code) as errors, count(error_code) / count(*) as error_rate, max(latency_ms) as max_ms from outcomes group by 1, 2
        having window_start + interval '10 minutes' <= (select max(ts) - interval '1 hour' from outcomes)"""),
    "write_result_stream": oracle(["requests"], "select request_id, ts, host, url, cast(ts as date) as fetch_date from requests"),
}
