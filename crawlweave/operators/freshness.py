"""Stored snapshots: which one answers a request, and what a time-limited store would hold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.durability import durable
from crawlweave.functions.times import US_PER_S, epoch_us, floor_div
from crawlweave.operators.ordered import newest_within
from crawlweave.options import DEFAULTS


def fresh_snapshot(requests: DataFrame, snapshots: DataFrame, ttl_s: int = DEFAULTS.cache_ttl_s,
                   newest=newest_within) -> DataFrame:
    """Add ``snapshot_id``, ``age_us`` and ``cache_hit``; an entry is still good at exactly its TTL."""
    found = newest(
        requests, snapshots, key="url_key", probe_ts="ts", mark_ts="fetched_at",
        mark_id="snapshot_id", ttl_us=ttl_s * US_PER_S,
    )
    return found.withColumn("cache_hit", F.col("snapshot_id").isNotNull())


def invalidate(snapshots: DataFrame, keys: DataFrame, key: str = "url_key") -> DataFrame:
    """Drop every snapshot of the listed keys."""
    return snapshots.join(keys.select(key), key, "left_anti").select(*snapshots.columns)


def hot_set(log: DataFrame, n: int = DEFAULTS.cache_entries, key: str = "url_key", ts: str = "ts") -> DataFrame:
    """The n keys used last: the content of a store of that capacity at the end of the log."""
    return (
        log.groupBy(key).agg(F.max(ts).alias("last_used"), F.count(F.lit(1)).alias("uses"))
        .orderBy(F.col("last_used").desc(), F.col(key))
        .limit(n)
    )


def ttl_admission(requests: DataFrame, ttl_s: int = DEFAULTS.cache_ttl_s, *, key: str = "url_key",
                  ts: str = "ts", request_id: str = "request_id", fold_rows: int = 10_000) -> DataFrame:
    """Replay requests against a store with a time limit; add ``verdict`` miss or hit.

    A miss stores the key until ``ts + ttl``; hits do not prolong it. Time is cut into chunks of
    one TTL, so a chunk holds at most one miss, and a run of chunks whose borders are closer than
    one TTL is a session that starts with a miss whatever came before. A session of one chunk
    is done then. Sessions of up to ``fold_rows`` arrivals are folded in order; longer ones are
    followed by pointer doubling over all executors, so no session has to fit one task.
    """
    ttl = ttl_s * US_PER_S
    # narrow and used several times below: worked out once
    arrivals = durable(
        requests.groupBy(F.col(key).alias("_key"), epoch_us(ts).alias("_t"))
        .agg(F.min(request_id).alias("_id"))
        .withColumn("_chunk", floor_div(F.col("_t"), ttl))
    )
    chunks = arrivals.groupBy("_key", "_chunk").agg(
        F.min(F.struct("_t", "_id")).alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_rows"),
    )
    in_key = Window.partitionBy("_key").orderBy("_chunk")
    linked = (F.lag("_chunk").over(in_key) == F.col("_chunk") - 1) & (
        F.col("_lo._t") - F.lag("_hi").over(in_key) <= ttl
    )
    in_session = Window.partitionBy("_key", "_session")
    sessions = (
        chunks.withColumn("_starts", (~F.coalesce(linked, F.lit(False))).cast("int"))
        .withColumn("_session", F.sum("_starts").over(in_key))
        .withColumn("_n_chunks", F.count(F.lit(1)).over(in_session))
        .withColumn("_n_rows", F.sum("_rows").over(in_session))
    )
    roots = sessions.where("_starts = 1").select(F.col("_lo._id").alias("_id"))
    several = sessions.where("_n_chunks > 1")

    short = _tagged(arrivals, several.where(F.col("_n_rows") <= fold_rows))
    folded = (
        short.groupBy("_key", "_session")
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_id"))).alias("_all"))
        .select(F.explode(_fold_misses("_all", ttl)).alias("_id"))
    )
    misses = roots.union(folded)

    long_sessions = several.where(F.col("_n_rows") > fold_rows)
    longest = long_sessions.agg(F.max("_n_chunks")).first()[0]
    if longest:
        misses = misses.union(_doubled_misses(arrivals, long_sessions, ttl, int(longest)))

    marks = misses.distinct().select(F.col("_id").alias(request_id), F.lit("miss").alias("verdict"))
    return requests.join(marks, request_id, "left").select(
        *requests.columns, F.coalesce("verdict", F.lit("hit")).alias("verdict")
    )


def _tagged(arrivals: DataFrame, sessions: DataFrame) -> DataFrame:
    of = sessions.select(F.col("_key").alias("_of_key"), F.col("_chunk").alias("_of_chunk"), "_session")
    same = F.col("_key").eqNullSafe(F.col("_of_key")) & (F.col("_chunk") == F.col("_of_chunk"))
    return arrivals.join(of, same).drop("_of_key", "_of_chunk")


def _fold_misses(arrivals: str, ttl: int):
    state = F.struct(F.lit(None).cast("bigint").alias("live_from"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        expired = acc["live_from"].isNull() | (x["_t"] > acc["live_from"] + ttl)
        return F.when(
            expired, F.struct(x["_t"].alias("live_from"), F.concat(acc["ids"], F.array(x["_id"])).alias("ids"))
        ).otherwise(acc)

    return F.aggregate(F.col(arrivals), state, step, lambda acc: acc["ids"])


def _doubled_misses(arrivals: DataFrame, sessions: DataFrame, ttl: int, longest: int) -> DataFrame:
    """Misses of long sessions: each arrival points to the next arrival after it has expired."""
    rows = _tagged(arrivals, sessions)
    none = F.lit(None).cast("struct<_t:bigint,_id:bigint>")
    # an arrival of chunk c looks for its successor in chunk c+1, or else takes the head of c+2
    targets = rows.select("_key", "_session", "_chunk", F.col("_t").alias("_at"), F.lit(1).alias("_side"),
                          F.struct("_t", "_id").alias("_target"), F.lit(None).cast("bigint").alias("_id"))
    heads = sessions.where("_starts = 0").select(
        "_key", "_session", (F.col("_chunk") - 1).alias("_chunk"), F.col("_lo._t").alias("_at"),
        F.lit(1).alias("_side"), F.col("_lo").alias("_target"), F.lit(None).cast("bigint").alias("_id"))
    probes = rows.select("_key", "_session", (F.col("_chunk") + 1).alias("_chunk"), (F.col("_t") + ttl).alias("_at"),
                         F.lit(0).alias("_side"), none.alias("_target"), F.col("_id"))
    backwards = (
        Window.partitionBy("_key", "_session", "_chunk").orderBy(F.col("_at").desc(), F.col("_side"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    jump = durable(
        targets.unionByName(heads).unionByName(probes)
        .withColumn("_next", F.last("_target", ignorenulls=True).over(backwards)["_id"])
        .where("_side = 0 AND _next IS NOT NULL")
        .select("_id", "_next")
    )
    jumps = [jump]
    for _ in range(max(0, math.ceil(math.log2(longest)) - 1)):
        far = jump.select(F.col("_id").alias("_next"), F.col("_next").alias("_far"))
        jump = durable(jump.join(far, "_next").select("_id", F.col("_far").alias("_next")))
        jumps.append(jump)
    reached = sessions.where("_starts = 1").select(F.col("_lo._id").alias("_id"))
    for jump in reversed(jumps):
        reached = durable(reached.union(reached.join(jump, "_id").select(F.col("_next").alias("_id"))))
    return reached
