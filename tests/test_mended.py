"""Relative redirect targets, kept details, folders on a cluster, and what the flow reads."""

from datetime import datetime

import pytest

from crawlweave.durability import shared_root
from crawlweave.operators import fetchlog
from crawlweave.operators.spread import left_join_spread
from crawlweave.plans.fetch_flow import fetch_flow


def test_relative_redirects(spark):
    hops = spark.createDataFrame(
        [("http://a.example/x/y", "/login"), ("http://a.example/login", "//c.example/z"), ("http://b.example/p/q?r", "../s?t#u"),
         ("http://d.example/", "ftp://x.example")], "url string, location string")
    rows = {r.url: (r.final_url, r.n_redirects, r.error_code) for r in fetchlog.hop_chains(hops).collect()}
    assert rows["http://a.example/x/y"] == ("http://c.example/z", 2, None)
    assert rows["http://b.example/p/q?r"] == ("http://b.example/s?t#u", 1, None)
    assert rows["http://d.example/"][2] == "scheme_not_allowed"


def test_newest_target_counts(spark):
    rows = [("http://a.example/", "http://z.example/", datetime(2024, 1, 2)), ("http://a.example/", "http://b.example/", datetime(2024, 1, 1))]
    hops = spark.createDataFrame(rows, "url string, location string, ts timestamp_ntz")
    assert fetchlog.hop_chains(hops).first().final_url == "http://z.example/"


def test_known_detail_is_kept(spark):
    log = spark.createDataFrame([("fetch_failed", "connection reset", None, None), (None, None, 503, 1)], "error_code string, error_detail string, status int, n_bytes bigint")
    rows = sorted(r.error_detail for r in fetchlog.classify_response(log).collect())
    assert rows == ["HTTP 503", "connection reset"]


def test_rows_without_a_key_keep_their_row(spark):
    left = spark.createDataFrame([(1, None), (2, 5), (3, 6), (4, None)], "request_id int, k int")
    right = spark.createDataFrame([(5, "five"), (None, "none")], "k int, v string")
    assert sorted((r.request_id, r.v) for r in left_join_spread(left, right, "k").collect()) == [(1, None), (2, "five"), (3, None), (4, None)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_root(Session())


def test_flow_extracts_only_pages_that_a_request_gets(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<p>text {i}") for i in range(5)], "page_id bigint, url string, html string")
    requests = spark.createDataFrame([(1, datetime(2024, 1, 1), '{"url": "http://h.example/3"}'), (2, datetime(2024, 1, 1), '{"url": "ftp://h.example/1"}')], "request_id bigint, ts timestamp_ntz, args string")
    df = fetch_flow(requests, pages)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Generate")
    rows = {r.request_id: (r.content, r.error_code) for r in df.collect()}
    assert rows == {1: ("text 3", None), 2: (None, "scheme_not_allowed")}
