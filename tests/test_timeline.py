import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crawlweave.functions.times import epoch_us, from_epoch_us
from crawlweave.operators import fetchlog, freshness, rate
from crawlweave.operators.ordered import newest_within, newest_within_lookup, numbered

START = datetime(2024, 3, 10, 1, 30)


def at(seconds):
    return START + timedelta(seconds=seconds)


def skewed_times(n, span, seed):
    """One key holds most rows."""
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot", "hot", "hot", "a", "b", "c"]), round(rnd.uniform(0, span), 3)) for i in range(n)]


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(START,), (datetime(1969, 12, 31, 23, 59, 59, 1),)], "ts timestamp_ntz")
    rows = df.select("ts", epoch_us("ts").alias("us"), from_epoch_us(epoch_us("ts")).alias("back")).collect()
    assert [r.us for r in rows] == [1710034200000000, -999999]
    assert all(r.ts == r.back for r in rows)


@pytest.mark.parametrize("join", [newest_within, newest_within_lookup])
@pytest.mark.parametrize("strict", [False, True])
def test_newest_within(spark, join, strict):
    marks = [(i, k, float(int(t))) for i, k, t in skewed_times(200, 3000, 1)]
    probes = [(i, k, float(int(t))) for i, k, t in skewed_times(300, 3000, 2)] + [(1000, "hot", max(t for _, k, t in marks if k == "hot") + 100)]
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in probes], "request_id long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([(i, k, at(t)) for i, k, t in marks], "m long, k string, f timestamp_ntz")
    got = {r.request_id: r.m for r in join(left, right, key="k", probe_ts="ts", mark_ts="f", mark_id="m", ttl_us=100_000_000, strict=strict).collect()}
    for i, k, t in probes:
        before = [(mt, mi) for mi, mk, mt in marks if mk == k and mt <= t]
        want = None
        if before:
            mt, mi = max(before)
            want = mi if (t - mt < 100 if strict else t - mt <= 100) else None
        assert got[i] == want
    assert got[1000] is (None if strict else got[1000]) and (strict or got[1000] is not None)


def brute_ttl(rows, ttl):
    live, verdicts = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in live or t > live[k] + ttl:
            live[k] = t
            verdicts[i] = "miss"
        else:
            verdicts[i] = "hit"
    return verdicts


@pytest.mark.parametrize("fold_rows", [10_000, 3])
@pytest.mark.parametrize("span", [2_000, 20_000])
def test_ttl_admission_by_fold_and_by_doubling(spark, fold_rows, span):
    rows = [(i, None if k == "c" else k, int(t)) for i, k, t in skewed_times(400, span, span)]
    df = spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "request_id long, url_key string, ts timestamp_ntz")
    got = {r.request_id: r.verdict for r in freshness.ttl_admission(df, 120, fold_rows=fold_rows).collect()}
    assert got == brute_ttl(rows, 120)


def test_ttl_hit_at_exact_expiry(spark):
    df = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(300)), (3, "k", at(300.000001)), (4, "k", at(301))],
                               "request_id long, url_key string, ts timestamp_ntz")
    got = [r.verdict for r in freshness.ttl_admission(df, 300).orderBy("request_id").collect()]
    assert got == ["miss", "hit", "miss", "hit"]


def brute_bucket(rows, step, burst):
    """Continuous token bucket in whole microseconds times step."""
    state, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        full_again = state.get(k, t)
        out[i] = max(t, full_again - (burst - 1) * step)
        state[k] = max(full_again, t) + step
    return out


@pytest.mark.parametrize("chunk_s", [1, 7, 3600])
def test_rate_limit_does_not_depend_on_the_chunk(spark, chunk_s):
    rows = [(i, k, int(t * 1e6)) for i, k, t in skewed_times(500, 60, 5)]
    df = spark.createDataFrame(rows, "request_id long, host string, arrival_us long")
    got = {r.request_id: r.admitted_us for r in rate.rate_limit_admission(df, 2, 3, arrival_us="arrival_us", chunk_s=chunk_s).collect()}
    want = brute_bucket(rows, 500_000, 3)
    assert got == want
    # no window of n-1 intervals ever sees more than burst + n - 1 starts
    hot = sorted(got[i] for i, k, _ in rows if k == "hot")
    for n in (1, 5, 20):
        assert all(b - a >= n * 500_000 for a, b in zip(hot, hot[3 + n - 1:]))


def test_rate_burst(spark):
    df = spark.createDataFrame([(i, "h", at(0)) for i in range(5)], "request_id long, host string, ts timestamp_ntz")
    waits = [r.wait_us for r in rate.rate_limit_admission(df, 1, 3).orderBy("request_id").collect()]
    assert waits == [0, 0, 0, 1_000_000, 2_000_000]


def test_numbered_over_chunks(spark):
    rows = [(i * 3, None if i % 10 == 0 else "hot" if i % 4 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = {r.id: r.n for r in numbered(df, "k", "id", "id", 50).collect()}
    for key in ("hot", "b", None):
        assert [got[i] for i, k in rows if k == key] == list(range(1, 1 + sum(k == key for _, k in rows)))


def test_hot_set_and_invalidate(spark):
    log = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("c", at(3)), ("a", at(2))], "url_key string, ts timestamp_ntz")
    assert [r.url_key for r in freshness.hot_set(log, 2).collect()] == ["c", "a"]
    kept = freshness.invalidate(log, spark.createDataFrame([("a",)], "url_key string"))
    assert sorted(r.url_key for r in kept.collect()) == ["b", "c"]


def log(spark, *attempts, max_retries=3):
    rows = [(1, n, 200 if a == "ok" else a if isinstance(a, int) else None, 10, a if isinstance(a, str) and a != "ok" else None)
            for n, a in enumerate(attempts)]
    df = spark.createDataFrame(rows, "request_id long, attempt int, status int, n_bytes long, error_code string").withColumn("url", F.lit("u"))
    return fetchlog.retry_outcome(df, max_retries).first()


def test_retry_outcomes(spark):
    assert log(spark, "ok").attempts_used == 1
    third = log(spark, "fetch_failed", "timeout", "ok")
    assert (third.attempts_used, third.error_code) == (3, None)
    spent = log(spark, *["fetch_failed"] * 4, max_retries=2)
    assert (spent.attempts_used, spent.error_code) == (3, "fetch_failed")
    assert log(spark, "ssrf_blocked", "ok").attempts_used == 1
    assert log(spark, "robots_disallowed", "ok").attempts_used == 1
    assert (log(spark, 503, 404, 200).attempts_used, log(spark, 503, 404, 200).error_code) == (2, "http_client_error")


def test_backoff(spark):
    df = spark.createDataFrame([(1, n) for n in range(7)], "request_id long, attempt int")
    rows = fetchlog.backoff_schedule(df, max_retries=6).orderBy("attempt").collect()
    assert [r.delay_us for r in rows] == [437_500, 875_000, 1_750_000, 3_500_000, 7_000_000, 8_750_000, 0]
    assert [r.planned_us for r in rows][:4] == [0, 437_500, 1_312_500, 3_062_500]


def test_size_limit_is_inclusive(spark):
    df = spark.createDataFrame([(200, 10), (200, 11), (404, 5), (500, 99), (301, 1)], "status int, n_bytes long")
    assert [r.error_code for r in fetchlog.classify_response(df, 10).collect()] == [None, "content_too_large", "http_client_error", "http_server_error", None]


def test_redirects(spark):
    def page(i):
        return f"http://h/{i}"

    hops = [(page(i), page(i + 1)) for i in range(0, 5)] + [(page(i), page(i + 1)) for i in range(10, 17)]
    hops += [("http://h/l1", "http://h/l2"), ("http://h/l2", "http://h/l1"), ("http://h/bad", "http://10.0.0.1/"), ("http://h/via", "http://h/bad")]
    urls = [page(0), page(3), page(10), page(99), "http://h/l1", "http://h/bad", "http://h/via"]
    out = {r.url: r for r in fetchlog.redirect_chains(
        spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(hops, "url string, location string"),
        spark.createDataFrame([], "host string, ip string")).collect()}
    assert (out[page(0)].final_url, out[page(0)].n_redirects) == (page(5), 5)
    assert (out[page(3)].final_url, out[page(3)].n_redirects) == (page(5), 2)
    assert (out[page(99)].final_url, out[page(99)].n_redirects) == (page(99), 0)
    assert out[page(10)].error_code == out["http://h/l1"].error_code == "too_many_redirects"
    assert (out["http://h/bad"].error_code, out["http://h/bad"].n_redirects) == ("ssrf_blocked", 0)
    assert (out["http://h/via"].error_code, out["http://h/via"].n_redirects) == ("ssrf_blocked", 1)


def test_messages(spark):
    df = spark.createDataFrame([(1, "ssrf_blocked", "h resolves to 10.0.0.1"), (2, "http_client_error", "HTTP 404"), (3, None, None)],
                               "id int, error_code string, error_detail string")
    a, b, c = fetchlog.error_messages(df).orderBy("id").collect()
    assert a.error_message == ("Security blocked: URL resolves to private/reserved address: h resolves to 10.0.0.1. "
                               "This URL resolves to a private or reserved address and cannot be fetched.")
    assert (b.error_category, b.error_message) == ("http", "HTTP client error: HTTP 404")
    assert c.error_message is None
