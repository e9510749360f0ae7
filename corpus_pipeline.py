"""From raw documents to shards: language ID, near-duplicate removal, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlweave.llm.decontaminate import decontaminated
from crawlweave.llm.hilbert import sharded
from crawlweave.llm.jaccard_trie import one_per_component
from crawlweave.llm.language import with_known_language
from crawlweave.llm.mixing import mixed
from crawlweave.llm.staging import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_known_language(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def shard_by_hilbert_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs, carry=True)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_by_hilbert_curve),
]

#: Trained scores, hashes of shingles and pseudorandom draws are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
