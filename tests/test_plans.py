"""What plans may hold, and the registered queries beside their SQL."""

import pytest

import __spark_entry__ as entry
from checks import admission, content, shaping, streams, timeline
from checks.compare import compare

SF = "/root/testdata/sf0.001"
LAZY = ["dns_guard", "robots_gate", "fresh_snapshot", "rate_limit_admission", "redirect_chains", "retry_outcome",
        "host_boilerplate", "to_markdown", "select_images", "format_results"]


@pytest.mark.parametrize("name", LAZY)
def test_batch_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert word not in plan


def test_extraction_shuffles_once(spark):
    from crawlweave.operators.extract import extract_pages

    df = extract_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1


OWN = sorted(n for m in (admission, timeline, content, shaping, streams) for n in m.QUERIES)


def test_every_query_has_a_name_in_both_tables():
    assert set(OWN) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert "response" in df.columns and df.count() == 50


@pytest.mark.parametrize("name", OWN)
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ["events", "pages", "documents"]:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text
