"""Ranked full-text search for batches of queries.

Every query runs down a ladder from strict to soft: its tokens near one another, all of them, all but one, any, any by
prefix, and last as substrings; first in titles, then in all columns.  The strict steps are computed together from one
join of the queries' terms with the postings, the soft ones for those queries that are still short of their limit; all
are numbered, united, cut to the limit, and then thinned to distinct chunks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import storage
from gleanery.functions import text
from gleanery.operators.index import COLUMNS, Index

# Weights of the columns, BM25's parameters, most tokens of a query, score of substring hits.
WEIGHTS = {"title": 9.0, "description": 3.0, "body": 1.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
MAX_TOKENS = 4
SUBSTRING_SCORE = 1e9
#: Queries that one pass over the chunks looks for as substrings.
QUERY_BLOCK = 50_000

RESULT = ("id", "title", "snippet", "source_path", "section", "kind", "score", "chunk_id", "chunk_index", "total_chunks", "chunk_title")


_WEIGHT = "CASE col " + " ".join(f"WHEN {code} THEN {WEIGHTS[name]}D" for name, code in COLUMNS.items()) + " END"


def idf(n: str, rows: int) -> str:
    return f"greatest(ln(({rows}D - {n} + 0.5D) / ({n} + 0.5D)), {IDF_FLOOR}D)"


def part(f: str, idf_: str, size: str, mean: float) -> str:
    """One phrase's share of BM25, negative so that less is better."""
    return f"-{idf_} * {f} * {K1 + 1}D / ({f} + {K1}D * ({1 - B}D + {B}D * {size} / {mean or 1.0!r}D))"


def document_frequency(index: Index, terms: DataFrame) -> DataFrame:
    """``term, df`` of those of ``terms``, a written table, that the index has: chunks with the term in any column."""
    return index.dictionary.join(storage.small(terms), "term", "left_semi")


def hint(terms: DataFrame):
    """What marks tables of a few rows a query, as ``terms`` (written) is one, for a broadcast; it does so only if there
    are few of those."""
    return F.broadcast if storage.rows_of(terms) <= storage.BROADCAST_ROWS else lambda df: df


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, i, k, token, term``: the tokens of each query, at most ``MAX_TOKENS``, the rarest if there are more."""
    tokens = queries.select("query_id", text.query_tokens(F.col("query")).alias("t"))
    rows = tokens.select("query_id", F.size("t").alias("k"), F.posexplode("t").alias("i", "token")).withColumn("term", text.folded(F.col("token")))
    wanted = storage.written(rows.select("term").distinct(), "wanted")
    counted = rows.join(document_frequency(index, wanted), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "token")) - 1
    capped = counted.withColumn("r", rank).withColumn("i", F.when(F.col("k") > MAX_TOKENS, F.col("r")).otherwise(F.col("i"))).where(f"i < {MAX_TOKENS}")
    return capped.select("query_id", "i", F.least("k", F.lit(MAX_TOKENS)).alias("k"), "token", "term")


def _chosen(index: Index, section: str | None, kind: str | None) -> DataFrame:
    rows = index.chunks.select("chunk_id", "section", "kind")
    rows = rows.where(F.col("section") == section) if section else rows
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.select("chunk_id")


def beginning_so(index: Index, terms: DataFrame) -> DataFrame:
    """``query_id, i, k, term``: the dictionary's terms that begin with a query's term.  Each dictionary term is put under
    its own beginnings, of the lengths that are asked for, so the join is by equality whatever letters are common."""
    lengths = sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())  # a row a word length
    known = index.dictionary.select("term", F.expr(f"explode(filter(array({', '.join(map(str, lengths))}), n -> n <= length(term)))").alias("n"))
    wanted = terms.select("query_id", "i", "k", F.col("term").alias("start"))
    return known.select("term", F.expr("substring(term, 1, n)").alias("start")).join(hint(terms)(wanted), "start").select("query_id", "i", "k", "term").distinct()


_EACH = range(MAX_TOKENS)
_TITLED = f"col = {COLUMNS['title']}"


def _sums(value: str, all_: str, titles: str) -> list[Column]:
    """For phrase j, the sum of ``value`` over its rows (``<all_>j``) and over those of titles (``<titles>j``)."""
    return [F.expr(f"sum(CASE WHEN i = {j}{more} THEN {value} ELSE 0D END)").alias(f"{name}{j}") for name, more in ((all_, ""), (titles, f" AND {_TITLED}")) for j in _EACH]


def found_chunks(index: Index, terms: DataFrame) -> DataFrame:
    """``query_id, k, chunk_id`` and, for phrase j, its weighted count in all columns (``f<j>``) and in titles (``t<j>``).
    A row for each query and chunk; places are not read.  ``terms`` is a written table."""
    hits = index.postings.select("term", "chunk_id", "col", "n").join(hint(terms)(terms.select("query_id", "i", "k", "term")), "term")
    return hits.groupBy("query_id", "k", "chunk_id").agg(*_sums(f"n * {_WEIGHT}", "f", "t"))


def _scored(index: Index, terms: DataFrame, allowed: DataFrame | None, few=lambda df: df) -> DataFrame:
    """:func:`found_chunks` with each phrase's idf over all columns (``w<j>``) and over titles (``v<j>``), the chunk's
    ``size``, and how many phrases it has in all (``m``) and in its title (``mt``)."""
    rows, _ = index.corpus()
    found = found_chunks(index, terms)
    n = found.groupBy("query_id").agg(*(F.expr(idf(f"count_if({f}{j} > 0)", rows)).alias(f"{w}{j}") for f, w in (("f", "w"), ("t", "v")) for j in _EACH))
    out = found.join(few(n), "query_id")
    out = out if allowed is None else out.join(allowed, "chunk_id", "left_semi")
    out = out.join(index.sizes.withColumnRenamed("n_terms", "size"), "chunk_id")
    return out.selectExpr("*", *(" + ".join(f"int({f}{j} > 0)" for j in _EACH) + f" AS {m}" for f, m in (("f", "m"), ("t", "mt"))))


def _score(f: str, w: str, mean: float, drop: str = "-1") -> Column:
    """The sum of the phrases' parts, by the columns that begin with ``f`` and ``w``, without phrase ``drop``."""
    return F.expr(" + ".join(f"CASE WHEN {f}{j} > 0 AND {drop} <> {j} THEN {part(f'{f}{j}', f'{w}{j}', 'size', mean)} ELSE 0D END" for j in _EACH))


def near_counts(index: Index, terms: DataFrame, whole: DataFrame) -> DataFrame:
    """``query_id, chunk_id``, ``g<j>`` and ``h<j>``: weighted counts, in all columns and in titles, of the places that take
    part in some set of one place a phrase, in one column, with at most ``5k + 3`` words between the first and the last.

    Only chunks in ``whole`` (query_id, chunk_id; all phrases are there) are read.  Two running windows over a column's
    places in order find them in one sweep each: a place begins a set if the next place of every phrase from there on lies
    within reach, and a place takes part if it lies within reach of the last beginning up to it."""
    hits = index.postings.join(hint(terms)(terms.select("query_id", "i", "k", "term")), "term").join(whole, ["query_id", "chunk_id"], "left_semi")
    hits = hits.select("query_id", "k", "chunk_id", "col", "i", F.explode("places").alias("pos"))
    one = "(PARTITION BY query_id, chunk_id, col ORDER BY pos"
    ahead = hits.selectExpr("*", *(f"min(CASE WHEN i = {j} THEN pos END) OVER {one} DESC) AS n{j}" for j in _EACH))
    seen, last = " + ".join(f"int(n{j} IS NOT NULL)" for j in _EACH), ", ".join(f"n{j}" for j in _EACH)
    begins = ahead.selectExpr("*", f"CASE WHEN {seen} = k AND greatest({last}) - pos <= 5 * k + 4 THEN pos END AS begin")
    inside = begins.selectExpr("*", f"max(begin) OVER {one}) AS start").where("pos - start <= 5 * k + 4")
    return inside.groupBy("query_id", "chunk_id").agg(*_sums(_WEIGHT, "g", "h"))


def ladder(index: Index, terms: DataFrame, section: str | None = None, kind: str | None = None, stages: tuple[int, ...] = tuple(range(1, 9))) -> DataFrame:
    """``query_id, stage, chunk_id, score`` of ``stages`` (of 1 to 8); a chunk comes in every stage that it satisfies.
    ``terms`` is a written table."""
    _, mean = index.corpus()
    allowed = _chosen(index, section, kind) if section or kind else None
    few = hint(terms)
    row = lambda df, n, score: df.select("query_id", F.lit(n).alias("stage"), "chunk_id", score.alias("score"))
    out = []
    if set(stages) & set(range(1, 8)):
        base = storage.written(_scored(index, terms, allowed, few), "scored")
        if {1, 4} & set(stages):
            near = near_counts(index, terms, base.where("k >= 2 AND m = k").select("query_id", "chunk_id"))
            near = base.join(near, ["query_id", "chunk_id"])
        for first, f, w, m, g in ((1, "t", "v", "mt", "h"), (4, "f", "w", "m", "g")):
            if first in stages:
                out.append(row(near.where(" + ".join(f"{g}{j}" for j in _EACH) + " > 0"), first, _score(g, w, mean)))
            if first + 1 in stages:
                out.append(row(base.where(f"{m} = k"), first + 1, _score(f, w, mean)))
            if first + 2 in stages:
                # all but one: the drop that leaves most chunks, the first of equals
                some = base.where(f"k >= 2 AND {m} >= k - 1")
                left = [f"(k > {j} AND ({m} = k OR {f}{j} = 0))" for j in _EACH]
                best = some.groupBy("query_id").agg(F.expr("greatest(" + ", ".join(f"struct(count_if({x}) AS c, -{j} AS j)" for j, x in enumerate(left)) + ")").alias("b"))
                kept = some.join(few(best.selectExpr("query_id", "-b.j AS miss")), "query_id").where(f"element_at(array({', '.join(left)}), miss + 1)")
                out.append(row(kept, first + 2, _score(f, w, mean, "miss")))
        if 7 in stages:
            out.append(row(base, 7, _score("f", "w", mean)))
    if 8 in stages:
        wider = storage.written(beginning_so(index, terms), "prefixed")
        out.append(row(_scored(index, wider, allowed, few), 8, _score("f", "w", mean)))
    return functools.reduce(DataFrame.unionByName, out)


def _matcher(asked):
    """Rows (query_id, chunk_id, titled) of (chunk_id, title, body, description) rows for (query_id, raw tokens) pairs.

    The longest token of each query is sought, of all queries at once; only where it is found are the others looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for n, (_, raw) in enumerate(asked.value):
            anchor = max(raw, key=len)
            held = machine.get(anchor, None)
            if held is None:
                machine.add_word(anchor, [n])
            else:
                held.append(n)
        machine.make_automaton()
        for batch in batches:
            which, rows, titled = [], [], []
            for r, texts in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                found: dict[int, bool] = {}
                for in_title, content in zip((True, False, False), texts, strict=True):
                    here = {n for _, held in machine.iter(content) for n in held} if content else ()
                    for n in here:
                        if n not in found and all(t in content for t in asked.value[n][1]):
                            found[n] = in_title
                which += [asked.value[n][0] for n in found]
                titled += found.values()
                rows += [r] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(titled, pa.bool_())], names=["query_id", "chunk_id", "titled"])

    return run


def substring_hits(index: Index, queries: DataFrame, section: str | None = None, kind: str | None = None) -> DataFrame:
    """Stages 9 and 10: every raw token within the title; or within the title, the body or the description.

    The stated queries go out in blocks of ``QUERY_BLOCK``; a pass over the chunks looks for a whole block at once."""
    spark = index.spark
    rows = index.chunks.join(_chosen(index, section, kind), "chunk_id", "left_semi") if section or kind else index.chunks
    rows = rows.select("chunk_id", *(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body", "description")))
    raw = queries.select(F.col("query_id").cast("long"), F.transform(text.raw_tokens(F.col("query")), F.lower).alias("raw")).where(F.size("raw") > 0)
    schema = "query_id long, chunk_id long, titled boolean"
    found = spark.createDataFrame([], schema)
    asked = iter(raw.toLocalIterator())
    while block := [(r["query_id"], r["raw"]) for r in itertools.islice(asked, QUERY_BLOCK)]:
        found = found.unionByName(rows.mapInArrow(_matcher(spark.sparkContext.broadcast(block)), schema))
    step = F.explode(F.when(F.col("titled"), F.array(F.lit(9), F.lit(10))).otherwise(F.array(F.lit(10)))).alias("stage")
    return found.select("query_id", step, "chunk_id", F.lit(SUBSTRING_SCORE).alias("score"))


def thinned(rows: DataFrame, per_page: int, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Each chunk once, and at most ``per_page`` chunks of a page (0: all), in order."""
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))
    rows = rows.withColumn("__n", first).where("__n = 1")
    if per_page > 0:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*order))).where(f"__n <= {per_page}")
    return rows.drop("__n")


def search(index: Index, queries: DataFrame, *, limit: int = 10, per_page: int = 2, section: str | None = None, kind: str | None = None, strict_limit: bool = False) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``stage`` and the eleven result columns, for (query_id, query) rows.

    As asked for, the limit cuts before repeats are dropped, so fewer rows may come back than match; ``strict_limit`` drops
    them first.  Queries without any letter or digit are only sought as substrings.
    """
    def best(rows: DataFrame) -> DataFrame:
        if strict_limit:
            rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY stage, score) AS __n").where("__n = 1").drop("__n")
        rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY stage, score, chunk_id) AS pos")
        return storage.written(rows.where(F.col("pos") <= limit), "best", keep=True)

    with storage.scope():
        asked = storage.written(queries.select("query_id", "query"), "asked")
        many, few = storage.rows_of(asked), hint(asked)
        terms = storage.written(query_terms(index, asked), "terms")
        top = best(ladder(index, terms, section, kind, tuple(range(1, 8))))
        # later stages are for queries that earlier ones leave short of the limit
        full = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= limit).select("query_id")
        if full.count() < many:
            short = terms.join(few(full), "query_id", "left_anti")
            short.row_count = storage.rows_of(terms)  # at most
            top, before = best(top.drop("pos").unionByName(ladder(index, short, section, kind, (8,)))), top
            storage.discard(before)
            full = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= limit).select("query_id")
            if full.count() < many:
                worded = terms.select("query_id").distinct().withColumn("worded", F.lit(True))
                more = substring_hits(index, asked.join(few(full), "query_id", "left_anti"), section, kind)
                more = more.join(few(worded), "query_id", "left").where("worded or stage = 10").drop("worded")
                top, before = best(top.drop("pos").unionByName(more)), top
                storage.discard(before)
    heads = index.chunks.select("chunk_id", F.col("filename").alias("id"), "title", "source_path", "section", "kind", "chunk_index", "total_chunks", F.col("title").alias("chunk_title"), "body", "description")
    found = heads.join(storage.small(top), "chunk_id").join(few(queries.select("query_id", "query")), "query_id")
    kept = thinned(found, per_page)
    token = F.lower(F.get(text.raw_tokens(F.col("query")), F.lit(0)))
    in_title, in_body = (text.all_within(F.col(c), text.raw_tokens(F.col("query"))) for c in ("title", "body"))
    window = F.coalesce(F.when(in_body, text.around(F.col("body"), token)).otherwise(text.around(F.col("description"), token)), F.col("title"))
    shown = F.when(F.col("stage") <= 8, text.snippet(F.col("body"), F.col("title"), F.col("query"))).when(in_title, F.col("title")).otherwise(window)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return kept.withColumn("snippet", shown).select("query_id", rank.alias("rank"), "stage", *RESULT)
