"""Results as parquet, laid out by day and host bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def laid_out(df: DataFrame, ts: str = "ts", host: str = "host", host_buckets: int = 16) -> DataFrame:
    """Add ``fetch_date`` and ``host_bucket``."""
    return df.withColumn("fetch_date", F.to_date(ts)).withColumn(
        "host_bucket", F.pmod(F.xxhash64(host), F.lit(host_buckets)).cast("int")
    )


def write_results(df: DataFrame, path: str, mode: str = "append", ts: str = "ts", host: str = "host",
                  host_buckets: int = 16, rows_per_file: int = 1_000_000) -> None:
    """Write in folders ``fetch_date=…/host_bucket=…``.

    Rows are spread over their folders by AQE's rebalance, which splits a folder with most of the
    rows over several tasks and joins small ones.
    """
    (
        laid_out(df, ts, host, host_buckets)
        .hint("rebalance", "fetch_date", "host_bucket")
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file)
        .partitionBy("fetch_date", "host_bucket").parquet(path)
    )


def write_result_stream(df: DataFrame, path: str, checkpoint: str, ts: str = "ts", host: str = "host",
                        host_buckets: int = 16, available_now: bool = True) -> StreamingQuery:
    """The same layout from a stream; the file sink writes each row exactly once."""
    writer = (
        laid_out(df, ts, host, host_buckets).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("fetch_date", "host_bucket")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
