"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing to target weights, tokenisation.

Every stage takes all that its predecessor kept. Stages are functions (spark, docs, sf_dir) -> DataFrame; each result is
written as Parquet and read again as the next one's input, so that a lost executor costs no more than one stage's tasks.
What a stage left in the shared folder goes when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestead.llm import bpe_automaton, mixing, near_dedup, quality_rules, suffix_dedup
from lodestead.llm.common import WRITTEN, clear, scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe_encoding", bpe_automaton.stage),
]

#: SQL cannot express the automaton, the suffix arrays or the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since, path = len(WRITTEN), scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, since, keep=(path,))
        docs = spark.read.parquet(path)
    return docs
