"""The whole flow on a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlweave.functions.times import epoch_us, from_epoch_us
from crawlweave.operators.fetchlog import outcome_metrics
from crawlweave.operators.ordered import newest_within_lookup
from crawlweave.options import DEFAULTS, Options
from crawlweave.plans.fetch_flow import fetch_flow
from crawlweave.streaming.stateful import rate_limit_stream


def _limited(rows: DataFrame, per_second: float, burst: int, *, host: str, ts: str) -> DataFrame:
    return rate_limit_stream(rows, per_second, burst, host=host, ts=ts).drop("late")


def fetch_flow_stream(requests: DataFrame, extracted: DataFrame, *, snapshots: DataFrame | None = None,
                      resolutions: DataFrame | None = None, robots_snapshots: DataFrame | None = None,
                      hops: DataFrame | None = None, fetch_log: DataFrame | None = None,
                      blocked_hosts: DataFrame | None = None, options: Options = DEFAULTS) -> DataFrame:
    """Answers for a stream of requests, in append mode.

    ``extracted`` is the stored result of ``extract_pages``, so that no micro-batch works out page
    texts again. Look-ups join the stream with the other tables as they stand at the micro-batch;
    the token bucket is the one step with state.
    """
    return fetch_flow(
        requests, None, extracted=extracted, snapshots=snapshots, resolutions=resolutions,
        robots_snapshots=robots_snapshots, hops=hops, fetch_log=fetch_log, blocked_hosts=blocked_hosts, options=options,
        newest=newest_within_lookup, limit=_limited,
    )


def outcome_metrics_stream(outcomes: DataFrame, delay: str = "1 hour", window: str = "10 minutes",
                           host: str = "host", ts: str = "ts") -> DataFrame:
    """Windowed metrics of a stream; a window is final once the watermark has passed it.

    A watermark needs an instant, so times without zone are read as UTC and given back as they were.
    """
    instants = outcomes.withColumn(ts, F.timestamp_micros(epoch_us(ts))).withWatermark(ts, delay)
    metrics = outcome_metrics(instants, window, host=host, ts=ts)
    return metrics.withColumn("window_start", from_epoch_us(F.unix_micros("window_start")))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there into parquet and stop; a later run goes on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
