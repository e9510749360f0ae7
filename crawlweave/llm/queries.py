"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from crawlweave.llm import decontaminate, hilbert, jaccard_trie, language, line_dedup, mixing, oracles, ranking, render, rlbwt, seed_extend, simhash, syncmers, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_run_length_index(spark, sf_dir):
    return rlbwt.repeat_report(table(spark, sf_dir, "documents"))


def op2_seed_extend(spark, sf_dir):
    return seed_extend.repeat_report(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark, sf_dir):
    return hilbert.sharded(table(spark, sf_dir, "documents"))


def op5_visible_text(spark, sf_dir):
    return render.text_report(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_mixed_blocks(spark, sf_dir):
    return mixing.mixed_blocks(table(spark, sf_dir, "documents"))


def op7_closed_syncmers(spark, sf_dir):
    return syncmers.fingerprint_report(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


def op9_jaccard_trie(spark, sf_dir):
    return jaccard_trie.component_report(table(spark, sf_dir, "documents"))


def op10_line_join(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_simhash_balls(spark, sf_dir):
    return simhash.component_report(table(spark, sf_dir, "documents"))


def op12_hybrid_search(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_spans(spark, sf_dir):
    return tokens.alignment_report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_run_length_index": op1_run_length_index,
    "op2_seed_extend": op2_seed_extend,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_decontaminate": op4_decontaminate,
    "op5_visible_text": op5_visible_text,
    "op6_mix_sources": op6_mix_sources,
    "op6_mixed_blocks": op6_mixed_blocks,
    "op7_closed_syncmers": op7_closed_syncmers,
    "op8_language": op8_language,
    "op9_jaccard_trie": op9_jaccard_trie,
    "op10_line_join": op10_line_join,
    "op11_simhash_balls": op11_simhash_balls,
    "op12_hybrid_search": op12_hybrid_search,
    "op13_token_spans": op13_token_spans,
    "pipeline": pipeline,
}

#: Without SQL: 3 (checksums), 5 (a tree), 6 and 7 (64-bit hashes), 8 (a trained model), 11 (64-bit hashes), 13 (tokenizers), pipeline; tests/llm has plain versions.
ORACLES: dict[str, str] = oracles.ORACLES
