"""The image table of the flow: selection, addresses, origins, sizes, strips and names per request."""

from datetime import datetime

import pytest

from crawlweave.operators.images import answer_images
from crawlweave.plans.fetch_flow import fetch_flow, fetch_flow_outputs

TS = datetime(2024, 3, 1, 23, 30)
ARGS = "request_id bigint, ts timestamp_ntz, page_id bigint, url string, image_start int, image_count int, image_max_width int, image_max_height int, image_quality int, allow_cross_origin boolean, output_base64 boolean, save_to_file boolean, layout string"


def asked(rid, start=0, count=3, w=1000, h=1600, cross=True, base64=True, file=False, layout="merged", page=1):
    return (rid, TS, page, "https://a.example/p/q.html", start, count, w, h, 80, cross, base64, file, layout)


@pytest.fixture(scope="module")
def run(spark):
    img = lambda src, name: {"src": src, "alt": f"alt {name}", "filename": name}
    pages = [(1, [img("/one.png", "one.png"), img("two.jpg?x", "two.jpg"), img("https://b.example/three.gif", "three.gif"), img("data:image/png;base64,AA", "AA"), img("../gone.webp", "gone.webp")]), (2, [])]
    landed = [("https://a.example/one.png", "image/png", 100, 100, 50), ("https://a.example/p/two.jpg?x", "image/jpeg", 2000, 1000, 60),
              ("https://b.example/three.gif", "image/gif", 30, 90, 11 << 20), ("https://b.example/three.gif", "image/gif", 40, 90, 5), ("https://c.example/", "image/png", 1, 1, 1)]
    page_images = spark.createDataFrame(pages, "page_id bigint, images array<struct<src:string,alt:string,filename:string>>")
    table = spark.createDataFrame(landed, "image_url string, mime string, width int, height int, n_bytes bigint")

    def rows(*requests):
        out = answer_images(spark.createDataFrame(list(requests), ARGS), page_images, table)
        return [r.asDict() for r in out.orderBy("request_id", "position").collect()]

    return rows


def test_strip_first_then_singles_with_their_place(run):
    rows = run(asked(1, count=2, w=50, h=50, file=True))
    assert [(r["position"], r["src"], r["width"], r["height"], r["x_offset"], r["y_offset"]) for r in rows] == [
        (0, "merged", 50, 75, 0, 0), (1, "/one.png", 50, 50, 0, 0), (2, "two.jpg?x", 50, 25, 0, 50)]
    assert [r["name"] for r in rows] == ["merged.jpg", "one_0.png", "two_1.jpg"] and rows[0]["alt"] == "Merged 2 images" and rows[1]["alt"] == "alt one.png"
    assert [r["saved_as"] for r in rows] == ["2024-03-01/1/merged.jpg", "2024-03-01/1/one_0.png", "2024-03-01/1/two_1.jpg"]
    assert {r["quality"] for r in rows} == {80} and all(r["as_base64"] for r in rows) and rows[0]["mime"] == "image/jpeg"


def test_start_count_and_layout(run):
    rows = run(asked(1, start=1, count=1), asked(2, start=0, count=2, layout="individual", base64=False), asked(3, start=9), asked(4, count=0), asked(5, page=2), asked(6, page=3))
    assert [(r["request_id"], r["position"], r["src"], r["width"]) for r in rows] == [(1, 1, "two.jpg?x", 1000), (2, 1, "/one.png", 100), (2, 2, "two.jpg?x", 1000)]
    assert not any(r["as_base64"] for r in rows[1:]) and all(r["saved_as"] is None for r in rows)


def test_images_that_cannot_be_shown(run):
    rows = run(asked(1, count=10, file=True), asked(2, count=10, cross=False, layout="both"))
    assert [(r["position"], r["src"], r["image_error"]) for r in rows if r["request_id"] == 1] == [
        (0, "merged", None), (1, "/one.png", None), (2, "two.jpg?x", None), (3, "https://b.example/three.gif", "image_too_large"), (5, "../gone.webp", "fetch_failed")]
    assert [r["src"] for r in rows if r["request_id"] == 2] == ["merged", "/one.png", "two.jpg?x", "../gone.webp"]
    assert all((r["width"] is None) == (r["image_error"] is not None) == (r["saved_as"] is None) for r in rows if r["request_id"] == 1)


def test_both_outputs_come_from_one_flow(spark):
    html = '<html><title>t</title><body><article><p>' + "word " * 60 + '<img src="/1.png"><img src="/2.png" alt="two"></p></article></body></html>'
    pages = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id bigint, url string, html string")
    args = ['{"url": "https://a.example/x", "images": true}', '{"url": "https://a.example/x"}', '{"url": "https://a.example/none", "images": true}',
            '{"url": "https://a.example/x", "images": {"maxCount": 1, "output": "file"}}', '{"url": "ftp://a.example/x", "images": true}']
    requests = spark.createDataFrame([(i, TS, a) for i, a in enumerate(args)], "request_id bigint, ts timestamp_ntz, args string")
    landed = spark.createDataFrame([(f"https://a.example/{i}.png", "image/png", 10, 20, 5) for i in (1, 2)], "image_url string, mime string, width int, height int, n_bytes bigint")
    texts, images = fetch_flow_outputs(requests, pages, landed)
    assert sorted(map(str, texts.collect())) == sorted(map(str, fetch_flow(requests, pages).collect()))
    found = sorted((r["request_id"], r["position"], r["image_url"]) for r in images.collect())
    assert found == [(0, 0, None), (0, 1, "https://a.example/1.png"), (0, 2, "https://a.example/2.png"), (3, 1, "https://a.example/1.png")]
    left = {r["request_id"]: r["remaining_images"] for r in texts.collect()}
    assert left[3] == 1 and left[0] == 0


def test_no_requests_and_no_landed_images(spark, run):
    assert run(asked(1, page=99)) == []
    empty = answer_images(spark.createDataFrame([], ARGS), spark.createDataFrame([], "page_id bigint, images array<struct<src:string,alt:string,filename:string>>"),
                          spark.createDataFrame([], "image_url string, mime string, width int, height int, n_bytes bigint"))
    assert empty.collect() == []
