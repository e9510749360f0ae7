"""Per-host request rates: a crawl plan, and admission times under a token bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.times import US_PER_S, epoch_us
from crawlweave.operators.ordered import numbered, segmented
from crawlweave.options import DEFAULTS


def interval_us(per_second: float) -> int:
    return int(round(US_PER_S / per_second))


def politeness_schedule(urls: DataFrame, per_second: float = DEFAULTS.rate_per_second,
                        burst: int = DEFAULTS.rate_burst, *, host: str = "host", order: str = "page_id",
                        chunk_width: int | None = None) -> DataFrame:
    """Add ``n`` and ``start_us``: the n-th URL of a host starts after the burst, one per interval."""
    step = interval_us(per_second)
    return numbered(urls, host, order, order, chunk_width).withColumn(
        "start_us", F.greatest(F.lit(0), F.col("n") - burst) * F.lit(step).cast("bigint")
    )


def rate_limit_admission(requests: DataFrame, per_second: float = DEFAULTS.rate_per_second,
                         burst: int = DEFAULTS.rate_burst, *, host: str = "host", ts: str | None = "ts",
                         arrival_us: str | None = None, request_id: str = "request_id",
                         chunk_s: int | None = None) -> DataFrame:
    """Add ``arrival_us``, ``admitted_us`` and ``wait_us`` under one token bucket per host.

    With interval T, burst B and arrivals t(1) <= t(2) <= ..., the n-th request starts at
    max(t(n), (n-1)T + M(n-1) - (B-1)T), where M(n) is the greatest t(i) - (i-1)T so far. Counts and
    maxima add up over pieces, so the rows are cut into segments of about equal row counts, also within one instant of one host:
    each is scanned on its own and shifted by what came before. With ``chunk_s`` no segment is longer than that either.
    """
    step = interval_us(per_second)
    at = F.col(arrival_us) if arrival_us else epoch_us(ts)
    rows = segmented(requests.withColumn("_at", at), host, "_at", request_id, chunk_s * US_PER_S if chunk_s else None)
    inside = Window.partitionBy(host, "_segment").orderBy("_at", request_id)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        rows.withColumn("_r", F.row_number().over(inside).cast("bigint"))
        .withColumn("_lead", F.col("_at") - (F.col("_r") - 1) * step)
    )
    before = Window.partitionBy(host).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        scanned.groupBy(host, "_segment")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("_lead").alias("_peak"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_peak_before", F.max(F.col("_peak") - F.col("_offset") * step).over(before))
        .select(host, "_segment", "_offset", "_peak_before")
    )
    peak = F.greatest(F.col("_peak_before"), F.max("_lead").over(earlier) - F.col("_offset") * step)
    n = F.col("_offset") + F.col("_r")
    # a row without a host meets no border and waits for nobody; a left join also leaves both uses
    # of the scanned rows alike, so their shuffle can be shared
    admitted = F.greatest(F.col("_at"), (n - 1) * step + peak - (burst - 1) * step)
    return (
        scanned.join(borders, [host, "_segment"], "left")
        .withColumn("_admitted", admitted)
        .select(
            *[c for c in requests.columns if c != "arrival_us"],
            F.col("_at").alias("arrival_us"), F.col("_admitted").alias("admitted_us"),
            (F.col("_admitted") - F.col("_at")).alias("wait_us"),
        )
    )
