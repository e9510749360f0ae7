"""One key with most rows, also all at one instant, is cut into segments of about equal row counts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from crawlweave.operators import rate
from crawlweave.operators.ordered import newest_within, numbered, segmented

START = datetime(2024, 3, 10, 1, 30)


def sizes(df):
    return [r["count"] for r in df.groupBy("_segment").count().collect()]


def test_one_instant_of_one_key_uses_every_segment(spark):
    df = spark.range(8000).select(F.col("id"), F.lit("hot").alias("k"), F.lit(5).cast("bigint").alias("at")).repartition(6)
    counts = sizes(segmented(df, "k", "at", "id"))
    assert len(counts) == 4 and sum(counts) == 8000 and max(counts) < 2 * 8000 / 4


def test_segments_follow_the_order(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 7).alias("at"))
    for width in (None, 2):
        rows = segmented(df, "k", "at", "id", width).collect()
        for key in "012":
            ordered = [r["_segment"] for r in sorted((r for r in rows if r.k == key), key=lambda r: (r["at"], r.id))]
            assert ordered == sorted(ordered)


def test_numbers_and_admissions_cross_borders_within_an_instant(spark):
    df = spark.range(4000).select(F.col("id").alias("request_id"), F.lit("hot").alias("host"), F.lit(0).cast("bigint").alias("arrival_us")).repartition(5)
    assert all(r.n == r.request_id + 1 for r in numbered(df, "host", "arrival_us", "request_id").collect())
    got = rate.rate_limit_admission(df, 2, 3, arrival_us="arrival_us").collect()
    assert len(got) == 4000
    assert all(r.admitted_us == max(0, r.request_id - 2) * 500_000 for r in got)


def test_a_mark_crosses_many_segments(spark):
    """The only mark of a key comes before thousands of probes; a key in between and rows without key or time find nothing of it."""
    times = [(i, "hot", START + timedelta(milliseconds=i)) for i in range(1, 4001)]
    times += [(5000 + i, "hot", START + timedelta(seconds=4)) for i in range(500)]
    times += [(9001, "other", START + timedelta(seconds=1)), (9002, None, START + timedelta(seconds=1)), (9003, "hot", None)]
    probes = spark.createDataFrame(times, "id long, k string, ts timestamp_ntz").repartition(5)
    marks = spark.createDataFrame([(7, "hot", START), (6, "hot", START), (8, None, START), (9, "hot", None)], "m long, k string, f timestamp_ntz")
    found = newest_within(probes, marks, key="k", probe_ts="ts", mark_ts="f", mark_id="m", ttl_us=3_000_000)
    got = {r.id: (r.m, r.age_us) for r in found.collect()}
    assert len(got) == len(times)
    assert all(got[i] == ((7, i * 1000) if i <= 3000 else (None, None)) for i in range(1, 4001))
    assert all(got[i] == (None, None) for i in [*range(5000, 5500), 9001, 9002, 9003])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, k string, ts timestamp_ntz")
    marks = spark.createDataFrame([], "m long, k string, f timestamp_ntz")
    assert newest_within(none, marks, key="k", probe_ts="ts", mark_ts="f", mark_id="m", ttl_us=1).count() == 0
    assert numbered(none, "k", "id", "id").count() == 0
