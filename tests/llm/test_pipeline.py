"""The stages of the pipeline, each judged on its own input, and what is registered."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from checks.compare import compare
from crawlweave.llm import oracles, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, docs.schema).repartition(2), SF)
        assert out.columns[: len(columns)] == columns and (name == "sharding" or len(out.columns) == len(columns))
        found = [tuple(r) for r in out.collect()]
        if name == "language_id":
            assert sorted(found) == sorted(r for r in rows if any(c.isalpha() for c in r[1]))
        elif name == "jaccard_join":
            stay = {c for _, _, c in brute.components(rows)}
            assert sorted(found) == sorted(r for r in rows if r[0] in stay) and len(found) < len(rows)
        elif name == "decontamination":
            bad = {r[0] for r in brute.contamination(rows, items) if r[5]}
            assert sorted(found) == sorted(r for r in rows if r[0] not in bad) and bad
        elif name == "mixing":
            sizes, wanted = brute.targets(rows)
            taken, per = Counter(), Counter()
            for r in found:
                taken[r[3]] += len(brute.GAP.findall(r[1]))
                per[r[0]] += len(brute.GAP.findall(r[1]))
            assert all(abs(taken[s] - t) <= max(64, 0.02 * t) for s, t in wanted.items())
            size = {r[0]: len(brute.GAP.findall(r[1])) for r in rows}
            assert all(n <= 3 * size[i] for i, n in per.items())
        else:
            shards = Counter(r[len(columns)] for r in found)
            assert max(shards.values()) - min(shards.values()) <= 1 and sorted(r[: len(columns)] for r in found) == sorted(rows)
        rows = [r[: len(columns)] for r in found]


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ok, text = compare(spark, con, SF, name, queries.QUERIES[name], oracles.ORACLES[name])
    assert ok, text
