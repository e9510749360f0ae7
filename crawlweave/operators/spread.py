"""Left joins on a key that many rows lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_spread(rows: DataFrame, other: DataFrame, key: str, row_id: str = "request_id") -> DataFrame:
    """``rows`` left join ``other`` on ``key``; rows with a null key are dealt out by ``row_id`` instead of meeting in one task."""
    filler = F.when(F.col(key).isNull(), F.col(row_id).cast("string")).otherwise("")
    left = rows.withColumn("_filler", filler)
    right = other.where(F.col(key).isNotNull()).withColumn("_filler", F.lit(""))
    return left.join(right, [key, "_filler"], "left").drop("_filler")
