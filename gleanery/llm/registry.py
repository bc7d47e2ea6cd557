"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.cluster import ship
from gleanery.llm import chat, compression, decontam, mixing, ngram_join, pii, quality_rules, secret_scan, substring, warc

_OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_private_data": pii.op4_private_data,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_warc_index": warc.op7_warc_index,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_preference_format": chat.op9_preference_format,
    "op10_quality_classifier": compression.op10_quality_classifier,
}

QUERIES = {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, f in _OPERATORS.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_mix_sources": mixing.SQL,
    "op7_warc_index": warc.SQL,
    "op8_substring_dedup": substring.SQL,
    "op9_preference_format": chat.SQL,
}
