from datetime import datetime

from crawlweave.sources.pages import load_page_dumps, load_pages, load_requests
from crawlweave.sources.results import write_result_stream, write_results


def test_load_pages_reads_only_what_is_used(spark):
    df = load_pages(spark, "/root/testdata/sf0.001/pages.parquet").where("page_id > 3").select("url")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "GreaterThan(page_id,3)" in plan


def test_dumps_and_requests(spark, tmp_path):
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "a.html").write_text("<p>é</p>", encoding="utf-8")
    assert load_page_dumps(spark, str(tmp_path / "dump")).first().html == "<p>é</p>"
    (tmp_path / "r.json").write_text('{"request_id": 1, "ts": "2024-01-01T00:00:00", "args": "{\\"url\\": \\"u\\"}"}\n')
    assert load_requests(spark, str(tmp_path / "r.json")).first().args == '{"url": "u"}'


def test_results_round_trip(spark, tmp_path):
    rows = [(i, f"h{i % 3}", datetime(2024, 1, 1 + i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "request_id long, host string, ts timestamp_ntz")
    write_results(df, str(tmp_path / "out"), host_buckets=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.request_id for r in back.collect()) == list(range(50))
    assert "PartitionFilters: [isnotnull(fetch_date" in back.where("fetch_date = date'2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = write_result_stream(stream, str(tmp_path / "s"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50
