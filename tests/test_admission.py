import json

import pytest
from pyspark.sql import functions as F

from crawlweave.functions.addresses import ip_is_private
from crawlweave.functions.urls import cache_key, filename_from_url
from crawlweave.operators import admission, requests


def guard(spark, urls, **kw):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    return [r.error_code for r in admission.url_guard(df, **kw).orderBy("id").collect()]


def test_guard_lets_web_addresses_pass(spark):
    assert guard(spark, ["https://tide.example", "http://a.b-c.example/x/y.html", "https://pier.example:444/s?p=2&q="]) == [None] * 3


def test_guard_verdicts(spark):
    cases = {
        "ftp://pier.example/x": "scheme_not_allowed", "file:///srv/notes.txt": "scheme_not_allowed",
        "javascript:void 0": "scheme_not_allowed", "pier.example": "scheme_not_allowed",
        "https://me:secret@pier.example/": "invalid_url", "http://": "invalid_url", "http://a b/": "invalid_url",
        "http://x:8a/": "invalid_url", "http://x/%zz": "invalid_url",
        "http://localhost": "localhost_blocked", "http://LOCALHOST:81/": "localhost_blocked", "http://localhost./": "localhost_blocked",
        "http://x.y.localhost": "localhost_blocked", "http://printer.local": "localhost_blocked",
        "http://notlocal": None, "HTTP://Example.com": None,
    }
    assert guard(spark, list(cases)) == list(cases.values())
    assert guard(spark, ["http://localhost"], allow_localhost=True) == [None]
    blocked = spark.createDataFrame([("bad.example.com",)], "host string")
    assert guard(spark, ["http://BAD.example.com/x", "http://sub.bad.example.com"], blocked_hosts=blocked) == ["ssrf_blocked", None]


def test_addresses(spark):
    cases = {
        "127.0.0.1": True, "10.0.0.1": True, "192.168.1.1": True, "172.16.0.1": True, "172.32.0.1": False, "169.254.1.1": True,
        "0.0.0.0": True, "224.0.0.1": True, "240.0.0.1": True, "8.8.8.8": False, "1.1.1.1": False, "::1": True, "fe80::1": True,
        "fc00::1": True, "ff02::1": True, "2001:4860:4860::8888": False, "::ffff:127.0.0.1": True, "::ffff:8.8.8.8": False,
        "0:0:0:0:0:ffff:a00:1": True, "::": False, "100.64.0.1": False, "256.1.1.1": None, "1:2": None, "x": None, "1::2::3": None,
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, ip string")
    got = [r.p for r in df.withColumn("p", ip_is_private("ip")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_dns_guard(spark):
    urls = spark.createDataFrame(
        [(1, "http://a.com"), (2, "http://b.com"), (3, "http://none.com"), (4, "http://[::ffff:127.0.0.1]/"), (5, "http://10.1.1.1"),
         (6, "ftp://a.com"), (7, "http://[fe80::1%25eth0]/"), (8, "http://127.0.0.1./"), (9, "http://a.com./")], "id int, url string")
    answers = spark.createDataFrame([("a.com", "8.8.8.8"), ("a.com", "10.0.0.9"), ("b.com", "1.1.1.1")], "host string, ip string")
    rows = admission.dns_guard(admission.url_guard(urls), answers).orderBy("id").collect()
    assert [r.error_code for r in rows] == ["ssrf_blocked", None, None, "ssrf_blocked", "ssrf_blocked", "scheme_not_allowed"] + ["ssrf_blocked"] * 3
    assert rows[0].error_detail == "a.com resolves to 10.0.0.9"


def test_url_parts(spark):
    df = spark.createDataFrame([("HTTPS://Example.com:8443/a/b?q=1#f",), ("http://[::1]:80",), ("/only/path",)], "url string")
    a, b, c = admission.url_parts(df).collect()
    assert (a.scheme, a.host, a.port, a.host_key, a.path, a.query) == ("https", "example.com", "8443", "example.com:8443", "/a/b", "q=1")
    assert a.robots_url == "https://Example.com:8443/robots.txt" and a.origin == "https://Example.com:8443"
    assert (b.host, b.port) == ("::1", "80")
    assert c.origin is None and c.robots_url is None


def test_cache_key_and_names(spark, column):
    a, b, c = column(["https://x/a", "https://x/a#top", "https://x/a"], cache_key)
    assert a == c != b and len(a) == 64
    assert column(
        ["https://example.com/image.png", "https://example.com/path/to/img.jpg?size=large", "https://example.com/", "",
         "https://e.com/x.png?u=/a/b.jpg#t"], filename_from_url,
    ) == ["image.png", "img.jpg", "image.jpg", "image.jpg", "b.jpg#t"]


def parsed(spark, *args):
    texts = [a if isinstance(a, str) else json.dumps(a) for a in args]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "request_id int, args string")
    return requests.parse_requests(df).orderBy("request_id").collect()


def test_parse_requests(spark):
    plain, full, wrong, empty, broken, switch = parsed(
        spark, {"url": "u"},
        {"url": "u", "text": {"maxLength": 5.9, "startIndex": 3, "raw": True},
         "images": {"output": "file", "layout": "both", "maxCount": 1, "originPolicy": "same-origin", "size": {"quality": 7}},
         "security": {"ignoreRobotsTxt": False}},
        {"url": "u", "text": {"maxLength": "5", "raw": 1}, "images": "yes", "security": []},
        {"url": ""}, '{"url": "u"', {"url": "u", "images": True})
    assert (plain.max_length, plain.start_index, plain.raw, plain.images_enabled, plain.image_count) == (20000, 0, False, False, 3)
    assert (plain.image_quality, plain.allow_cross_origin, plain.output_base64, plain.layout, plain.ignore_robots) == (80, True, True, "merged", True)
    assert (full.max_length, full.start_index, full.raw, full.images_enabled, full.image_count) == (5, 3, True, True, 1)
    assert (full.output_base64, full.save_to_file, full.layout, full.allow_cross_origin, full.image_quality) == (False, True, "both", False, 7)
    assert full.ignore_robots is False
    assert (wrong.max_length, wrong.raw, wrong.images_enabled, wrong.ignore_robots) == (20000, False, False, True)
    assert empty.error_code == broken.error_code == "url_required"
    assert switch.images_enabled is True


@pytest.mark.parametrize("change, detail", [
    ({}, None), ({"url": ""}, "URL is required"), ({"max_length": -1}, "maxLength must be between 0 and 1,000,000"),
    ({"image_count": 20}, "imageMaxCount must be between 0 and 10"), ({"image_quality": 0}, "imageQuality must be between 1 and 100"),
    ({"image_max_width": 99}, "imageMaxWidth must be between 100 and 10000"), ({"start_index": -1}, "startIndex must not be negative"),
    ({"max_length": -1, "image_count": 20}, "maxLength must be between 0 and 1,000,000"),
])
def test_validate(spark, change, detail):
    good = {"url": "https://example.com", "max_length": 1000, "start_index": 0, "image_count": 3, "image_start": 0,
            "image_quality": 80, "image_max_width": 1000, "image_max_height": 1600}
    row = requests.validate_requests(spark.createDataFrame([{**good, **change}])).first()
    assert row.error_detail == detail and row.error_code == ("invalid_url" if detail else None)
