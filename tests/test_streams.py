import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from crawlweave.operators import freshness, rate
from crawlweave.streaming.flow import outcome_metrics_stream, run_available
from crawlweave.streaming.stateful import rate_limit_stream, ttl_admission_stream, use_rocksdb

SCHEMA = "request_id long, url_key string, ts timestamp_ntz"


def rows(n, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.uniform(0, 3000) for _ in range(n))
    return [(i, rnd.choice("aab"), datetime(2024, 1, 1) + timedelta(seconds=round(t, 3))) for i, t in enumerate(times)]


def feed(spark, data, folder, parts):
    size = len(data) // parts
    for p in range(parts):
        piece = data[p * size:(p + 1) * size if p < parts - 1 else None]
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        yield


def test_streams_give_what_the_batch_gives_over_restarts(spark, tmp_path):
    use_rocksdb(spark)
    data = rows(120, 3)
    source = str(tmp_path / "in")
    for _ in feed(spark, data, source, 3):
        # each round is a new query that goes on from the checkpoint
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        run_available(ttl_admission_stream(stream, 200), str(tmp_path / "ttl"), str(tmp_path / "ttl-state"))
        run_available(rate_limit_stream(stream, 0.05, 3, host="url_key"), str(tmp_path / "rate"), str(tmp_path / "rate-state"))
    batch = spark.createDataFrame(data, SCHEMA)
    want = {r.request_id: r.verdict for r in freshness.ttl_admission(batch, 200).collect()}
    got = {r.request_id: (r.verdict, r.late) for r in spark.read.parquet(str(tmp_path / "ttl")).collect()}
    assert got == {i: (v, False) for i, v in want.items()}
    want = {r.request_id: r.admitted_us for r in rate.rate_limit_admission(batch, 0.05, 3, host="url_key").collect()}
    got = {r.request_id: r.admitted_us for r in spark.read.parquet(str(tmp_path / "rate")).collect()}
    assert got == want


def test_late_rows_are_flagged(spark, tmp_path):
    use_rocksdb(spark)
    source = str(tmp_path / "in")
    start = datetime(2024, 1, 1)
    for data in ([(1, "a", start + timedelta(seconds=100))], [(2, "a", start)]):
        spark.createDataFrame(data, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        run_available(ttl_admission_stream(stream, 10), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.request_id: r.late for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True}


def test_metrics_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    data = [(i, "h", datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(120)]
    for _ in feed(spark, data, source, 2):
        stream = spark.readStream.schema(SCHEMA).parquet(source).select(
            "ts", F.col("url_key").alias("host"), F.lit(5).alias("latency_ms"), F.lit(None).cast("string").alias("error_code"))
        run_available(outcome_metrics_stream(stream, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.requests for r in out.collect()} == {10} and out.count() >= 10
