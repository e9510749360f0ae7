"""Landed pages and requests, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave import schemas


def load_pages(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """``page_id, url, html`` from parquet; only the columns a query uses are read."""
    if not stream:
        return spark.read.schema(schemas.PAGES).parquet(path)
    reader = spark.readStream.schema(schemas.PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def load_page_dumps(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """One row per file of a raw dump: its path as url, its bytes as html."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"),
        F.decode("content", charset).alias("html"), F.col("modificationTime").alias("fetched_at"),
    )


def load_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``request_id, ts, args`` from JSON lines; ``args`` is kept as text."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.REQUEST_JSON).json(path)
