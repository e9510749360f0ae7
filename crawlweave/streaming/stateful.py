"""The two steps that need memory between micro-batches: time-limited store and token bucket.

Both take a streaming DataFrame and keep one bigint per key in the RocksDB state store. Rows of a key
are put in time order inside a micro-batch; rows that come after later ones are flagged ``late`` and
still answered. With ``idle_s`` a state not touched for that long is dropped; this makes Spark run
batches for the clock alone, so leave it unset for runs that stop when the input is used up.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crawlweave.functions.times import US_PER_S, epoch_us
from crawlweave.operators.rate import interval_us
from crawlweave.options import DEFAULTS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("seen", T.LongType())])


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful steps need this provider; set it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Ordered(StatefulProcessor):
    """Feeds the rows of a key in time order; a subclass says what a row does to the state."""

    def __init__(self, request_id: str, idle_s: int | None):
        self._request_id = request_id
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", _STATE, self.idle_s * 1000 if self.idle_s else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, seen = self._state.get() if self._state.exists() else (None, None)
        for row in sorted(rows, key=lambda r: (r["arrival_us"], r[self._request_id])):
            t = row["arrival_us"]
            late = seen is not None and t < seen
            seen = t if seen is None else max(seen, t)
            at, result = self.step(at, t)
            yield Row(**row.asDict(), **{self.result: result}, late=late)
        self._state.update((at, seen))

    def close(self) -> None:
        pass


class _TimedStore(_Ordered):
    result = "verdict"

    def __init__(self, request_id: str, idle_s: int | None, ttl_us: int):
        super().__init__(request_id, idle_s)
        self._ttl_us = ttl_us

    def step(self, live_from, t):
        if live_from is None or t > live_from + self._ttl_us:
            return t, "miss"
        return live_from, "hit"


class _TokenBucket(_Ordered):
    result = "admitted_us"

    def __init__(self, request_id: str, idle_s: int | None, step_us: int, burst: int):
        super().__init__(request_id, idle_s)
        self._step_us = step_us
        self._spare_us = (burst - 1) * step_us

    def step(self, full_again, t):
        # full_again: when the bucket would be full if nothing more came
        if full_again is None:
            return t + self._step_us, t
        return max(full_again, t) + self._step_us, max(t, full_again - self._spare_us)


def _stateful(rows: DataFrame, key: str, processor: _Ordered, result_type: T.DataType) -> DataFrame:
    result = T.StructField(processor.result, result_type)
    schema = T.StructType([*rows.schema.fields, result, T.StructField("late", T.BooleanType())])
    clock = "ProcessingTime" if processor.idle_s else "None"
    return rows.groupBy(key).transformWithState(processor, schema, "append", clock)


def ttl_admission_stream(stream: DataFrame, ttl_s: int = DEFAULTS.cache_ttl_s, *, key: str = "url_key", ts: str = "ts",
                         request_id: str = "request_id", idle_s: int | None = None) -> DataFrame:
    """The streaming form of ``ttl_admission``: adds ``verdict`` and ``late``."""
    processor = _TimedStore(request_id, idle_s, ttl_s * US_PER_S)
    return _stateful(stream.withColumn("arrival_us", epoch_us(ts)), key, processor, T.StringType()).drop("arrival_us")


def rate_limit_stream(stream: DataFrame, per_second: float = DEFAULTS.rate_per_second, burst: int = DEFAULTS.rate_burst, *,
                      host: str = "host", ts: str | None = "ts", arrival_us: str | None = None,
                      request_id: str = "request_id", idle_s: int | None = None) -> DataFrame:
    """The streaming form of ``rate_limit_admission``: adds arrival_us, admitted_us, wait_us and ``late``."""
    rows = stream.withColumn("arrival_us", F.col(arrival_us) if arrival_us else epoch_us(ts))
    processor = _TokenBucket(request_id, idle_s, interval_us(per_second), burst)
    out = _stateful(rows, host, processor, T.LongType())
    return out.withColumn("wait_us", F.col("admitted_us") - F.col("arrival_us"))
