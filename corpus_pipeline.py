"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Rejecting stages keep every other document with all its columns; the last adds n_tokens and rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontaminate, exact_dedup, ngram_join, source_mix, toxicity
from veldspar.llm.store import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word shingles the one with the least id stays."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate at which it is drawn so that domains meet their target shares of tokens."""
    return source_mix.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", keep_one_near_copy),
    ("decontaminate", drop_benchmark_leaks),
    ("source_mix", mix),
]

#: SQL can't express the trained stages; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
