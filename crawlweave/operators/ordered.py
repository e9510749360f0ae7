"""Ordered work per key that survives one key, or one instant of a key, holding most of the rows.

Rows are put in order of key and time and cut into segments of about equal row counts, whatever keys and times they have. Each
(key, segment) is a window partition of its own; what crosses a border is one small row per (key, segment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.durability import written
from crawlweave.functions.times import epoch_us, floor_div


def segmented(df: DataFrame, key: str, order: str, tie: str | None = None, chunk_width: int | None = None) -> DataFrame:
    """``df`` with ``_segment``, a bigint that grows with (key, order, tie) and is shared by about the same number of rows.

    A range partitioning draws the borders from a sample, as many segments as ``spark.sql.shuffle.partitions`` says, and
    the table is written once, so that all that read it see the same borders. Only rows equal in key, order and tie
    can't be parted. With ``chunk_width`` no segment reaches over a multiple of that many units of the bigint ``order`` either.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, order] + ([tie] if tie and tie != order else [])
    segment = F.spark_partition_id().cast("bigint")
    cut = written(df.repartitionByRange(parts, *by).withColumn("_segment", segment), "segments")
    if chunk_width:
        # chunks and segments both grow with the order, and so does their sum, within a key
        cut = cut.withColumn("_segment", F.col("_segment") + floor_div(F.col(order), chunk_width))
    return cut


def numbered(df: DataFrame, key: str, order: str, tie: str, chunk_width: int | None = None) -> DataFrame:
    """Add ``n``: the 1-based rank of a row within its key, by ``order``, then ``tie``."""
    rows = segmented(df, key, order, tie, chunk_width)
    counts = rows.groupBy(key, "_segment").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("_of_key"), F.col("_segment").alias("_of_segment"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    # rows without a key are numbered among themselves
    same = F.col(key).eqNullSafe(F.col("_of_key")) & (F.col("_segment") == F.col("_of_segment"))
    inside = Window.partitionBy(key, "_segment").orderBy(order, tie)
    return (
        rows.join(offsets, same)
        .withColumn("n", F.col("_offset") + F.row_number().over(inside))
        .select(*df.columns, "n")
    )


def newest_within(probes: DataFrame, marks: DataFrame, *, key: str, probe_ts: str, mark_ts: str,
                  mark_id: str, ttl_us: int, strict: bool = False) -> DataFrame:
    """As-of join with a time limit.

    Each probe row gets ``mark_id`` and ``age_us`` of the newest mark of its key at or before it,
    if that mark is at most ``ttl_us`` old (younger than it, if ``strict``); of marks at one time the greatest counts. A probe
    without key or time finds none.

    Instants decide, not rows: probes and marks are first reduced to one row per key and time, which are scanned in
    segments; the last mark before a segment comes over its border. The answers then meet the probes by key and time.
    """
    asked = probes.select(
        F.col(key).alias("_key"), epoch_us(probe_ts).alias("_t"), F.lit(True).alias("_asked"),
        F.lit(None).cast("struct<_t:bigint,_mark:bigint>").alias("_stored"),
    )
    stored = marks.select(F.col(key).alias("_key"), epoch_us(mark_ts).alias("_t"), F.col(mark_id).cast("bigint").alias("_mark"))
    stored = stored.select("_key", "_t", F.lit(False).alias("_asked"), F.struct("_t", "_mark").alias("_stored"))
    instants = (
        asked.unionByName(stored).where("_key IS NOT NULL AND _t IS NOT NULL")
        .groupBy("_key", "_t").agg(F.max("_asked").alias("_asked"), F.max("_stored").alias("_stored"))
    )
    rows = segmented(instants, "_key", "_t")
    before = Window.partitionBy("_key").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        rows.groupBy("_key", "_segment").agg(F.max("_stored").alias("_last"))
        .withColumn("_carried", F.max("_last").over(before)).where("_carried IS NOT NULL").drop("_last")
    )
    running = Window.partitionBy("_key", "_segment").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    age = F.col("_t") - F.col("_seen._t")
    fits = (age < ttl_us) if strict else (age <= ttl_us)
    answers = (
        rows.withColumn("_seen", F.last("_stored", ignorenulls=True).over(running))
        .where("_asked")
        .join(borders, ["_key", "_segment"], "left")
        .withColumn("_seen", F.coalesce("_seen", "_carried"))
        .where(fits)
        .select("_key", "_t", F.lit(0).alias("_filler"), F.col("_seen._mark").alias("_mark"), age.alias("_age"))
    )
    # probes without a key meet no answer; they are dealt out instead of meeting in one task
    spread = F.pmod(F.xxhash64(*[f.name for f in probes.schema if isinstance(f.dataType, T.AtomicType)]), F.lit(1 << 20)).cast("int")
    filler = F.when(F.col(key).isNull() | F.col(probe_ts).isNull(), spread).otherwise(0)
    at = probes.withColumns({"_key": F.col(key), "_t": epoch_us(probe_ts), "_filler": filler})
    return at.join(answers, ["_key", "_t", "_filler"], "left").select(
        *probes.columns, F.col("_mark").alias(mark_id), F.col("_age").alias("age_us")
    )


def newest_within_lookup(probes: DataFrame, marks: DataFrame, *, key: str, probe_ts: str, mark_ts: str,
                         mark_id: str, ttl_us: int, strict: bool = False) -> DataFrame:
    """``newest_within`` without a window over the probes, so that they may be a stream.

    The marks of a chunk, and the last one of the chunk before, come as one sorted array per
    (key, chunk); a probe joins its chunk's array and takes the last mark not after it. An array
    holds the marks of one key within one TTL.
    """
    placed = marks.select(
        F.col(key).alias("_key"), epoch_us(mark_ts).alias("_t"), F.col(mark_id).cast("bigint").alias("_mark")
    ).withColumn("_chunk", floor_div(F.col("_t"), ttl_us))
    carried = placed.groupBy("_key", "_chunk").agg(F.max(F.struct("_t", "_mark")).alias("_m")).select(
        "_key", "_m._t", "_m._mark", (F.col("_chunk") + 1).alias("_chunk")
    )
    arrays = (
        placed.unionByName(carried).groupBy("_key", "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_mark"))).alias("_marks"))
    )
    rows = probes.withColumn("_at", epoch_us(probe_ts)).withColumn("_chunk", floor_div(F.col("_at"), ttl_us))
    seen = F.array_max(F.filter("_marks", lambda m: m["_t"] <= F.col("_at")))
    age = F.col("_at") - F.col("_seen._t")
    fits = (age < ttl_us) if strict else (age <= ttl_us)
    return (
        rows.withColumn("_key", F.col(key)).join(arrays, ["_key", "_chunk"], "left")
        .withColumn("_seen", seen)
        .select(*probes.columns, F.when(fits, F.col("_seen._mark")).alias(mark_id), F.when(fits, age).alias("age_us"))
    )
