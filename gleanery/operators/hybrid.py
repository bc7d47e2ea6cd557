"""Reciprocal rank fusion, and search by words and vectors together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import fts, vector
from gleanery.operators.index import Index

RRF_K = 60


def fuse(ranked: DataFrame, keys: tuple[str, ...], k: int = RRF_K) -> DataFrame:
    """For (query_id, list_no, rank from 1, ...) rows: each distinct ``keys`` once, as its first row has it, with
    ``fused`` = sum of 1 / (k + rank) and ``fused_rank``; equal sums stay in order of first appearance."""
    mine = ["query_id", *keys]
    rest = [c for c in ranked.columns if c not in mine]
    first = F.min_by(F.struct(*rest), F.struct("list_no", "rank"))
    out = ranked.groupBy(*mine).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"), first.alias("f"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "f.list_no", "f.rank")
    return out.withColumn("fused_rank", F.row_number().over(order)).select(*mine, *(F.col(f"f.{c}").alias(c) for c in rest), "fused", "fused_rank")


def search(index: Index, queries: DataFrame, *, limit: int = 10, per_page: int = 2, section: str | None = None, kind: str | None = None) -> DataFrame:
    """Both searches for (query_id, query, vec) rows, fused, cut to ``limit`` and thinned; a row keeps the score of the
    list it came from first."""
    pool = max(4 * limit, 40)
    a = fts.search(index, queries.select("query_id", "query"), limit=pool, per_page=per_page, section=section, kind=kind).drop("stage").withColumn("list_no", F.lit(0))
    b = vector.search(index, queries.select("query_id", "vec"), limit=pool, per_page=per_page, section=section, kind=kind).withColumn("list_no", F.lit(1))
    top = fuse(a.unionByName(b), ("id", "chunk_id")).where(F.col("fused_rank") <= limit)
    kept = fts.thinned(top.withColumn("pos", F.col("fused_rank")), per_page)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return kept.withColumn("rank", rank).select("query_id", "rank", *fts.RESULT, "fused")
