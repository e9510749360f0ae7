"""Slices of long text and the answer shown to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_text(text: Column, start: Column, max_length: Column) -> Column:
    """Characters from ``start``; a length of 0 takes the rest."""
    return F.when(start >= F.length(text), F.lit("")).when(
        max_length == 0, F.substring(text, start + 1, F.length(text))
    ).otherwise(F.substring(text, start + 1, max_length))


def left_after(text: Column, start: Column, max_length: Column) -> Column:
    size = F.length(text)
    return F.when((start >= size) | (max_length == 0), F.lit(0)).otherwise(
        F.greatest(F.lit(0), size - start - max_length)
    )


def paginate(df: DataFrame, text: str = "content") -> DataFrame:
    """Replace ``content`` by the requested slice and add ``remaining_content``."""
    col, start, length = F.col(text), F.col("start_index"), F.col("max_length")
    return df.withColumn("remaining_content", left_after(col, start, length)).withColumn(
        text, slice_text(col, start, length)
    )


def all_slices(df: DataFrame, max_length: int, text: str = "content") -> DataFrame:
    """One row per continuation slice: ``slice_no``, ``start_index``, ``slice``, ``remaining_content``."""
    size = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(max_length))
    keep = [c for c in df.columns if c != text]
    return (
        df.select(*keep, text, F.posexplode(starts).alias("slice_no", "start_index"))
        .select(
            *keep, "slice_no", "start_index",
            F.substring(F.col(text), F.col("start_index") + 1, F.lit(max_length)).alias("slice"),
            F.greatest(F.lit(0), size - F.col("start_index") - max_length).alias("remaining_content"),
        )
    )


def remaining_images(total: Column, start: Column, count: Column) -> Column:
    return F.when(start >= total, F.lit(0)).otherwise(total - start - F.least(count, total - start))


def format_results(df: DataFrame) -> DataFrame:
    """Add ``response``: heading, content and the notes on what is left."""
    heading = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))).otherwise("")
    more_text = F.when(
        F.col("remaining_content") > 0,
        F.concat(F.lit("\n\n[Content truncated. "), F.col("remaining_content").cast("string"),
                 F.lit(" characters remaining. Use start_index to continue.]")),
    ).otherwise("")
    more_images = F.when(
        F.col("remaining_images") > 0,
        F.concat(F.lit("\n\n["), F.col("remaining_images").cast("string"),
                 F.lit(" more images available. Use imageStartIndex to continue.]")),
    ).otherwise("")
    return df.withColumn("response", F.concat(heading, F.col("content"), more_text, more_images))
