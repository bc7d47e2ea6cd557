"""Corpus preparation from documents to a training mix; every stage reads all that the one before it kept.

1. quality_rules: documents that fail the rules, or whose host is rejected, go.
2. ngram_join: of each component of near-duplicates the document with the least id stays.
3. decontaminate: documents in which a benchmark item is found go.
4. personal_data: personal data is replaced by its kind in brackets.
5. mix_sources: documents are repeated to the sources' target weights and globally shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.cluster import ship
from gleanery.llm import decontam, mixing, ngram_join, pii, quality_rules
from gleanery.llm.tables import cut, discard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass their own rules and whose host passes; see :func:`quality_rules.quality_filter`, also for nulls, empty
    texts, repeated rows and empty tables."""
    ship(spark)
    return quality_rules.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the least id; see :func:`ngram_join.deduplicated`, also for nulls,
    empty texts, repeated rows and empty tables."""
    ship(spark)
    return ngram_join.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; see :func:`decontam.decontaminated`, also for nulls, empty texts, repeated rows and
    empty tables on either side."""
    ship(spark)
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind and ``n_chars`` counted anew; see :func:`pii.redacted`, also for nulls,
    empty texts, repeated rows and empty tables."""
    ship(spark)
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the sources' weights and shuffled, with the columns ``mix_*``; see :func:`mixing.mix_sources`, also
    for nulls, empty texts, repeated rows and empty tables."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rule_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("mix_sources", mixing_stage),
]

#: Alignment and the tagger are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
