"""Host-level quality rules.

Every document is measured and put to rules of its own; the failures are then aggregated by host, each host's failure
rate is shrunk towards a beta prior that is fitted to all hosts (so a host of three documents is not condemned by two of
them), and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk
from gleanery.llm.tables import anti_join, column_at, cut, schema_of, small

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A host is rejected when its shrunken rate of failed documents reaches this.
MAX_HOST_FAILURE = 0.6
#: Prior strength, in documents, when hosts differ no more than chance would have it.
FLAT_STRENGTH = 1e6


def repeat_words(h: np.ndarray, words: list[bytes] | None = None, k: int = WINDOW) -> int:
    """How many words lie in a window of ``k`` words whose sequence is found twice or more among the same words."""
    w = tk.window_hashes(h, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twin = np.zeros(len(w), bool)
    if words is None:
        twin[order[1:][same]] = twin[order[:-1][same]] = True
    else:  # equal hashes are only candidates: the words decide
        seen: dict[tuple[bytes, ...], int] = {}
        near = np.zeros(len(w), bool)
        near[order[1:][same]] = near[order[:-1][same]] = True
        for i in np.flatnonzero(near).tolist():
            first = seen.setdefault(tuple(words[i : i + k]), i)
            if first != i:
                twin[first] = twin[i] = True
    reach = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twin)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + k, -1)
    return int((np.cumsum(reach)[:-1] > 0).sum())


def measure(text: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[int, int, int, int, int]:
    points = len(text.decode()) if not text.isascii() else len(text)
    spaces = len(text) - int((end - start).sum())
    lines: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in lines:
            dup += not line.isspace() and line != b""
        else:
            lines.add(line)
    n = len(h)
    many = n >= WINDOW + 1 and repeat_words(h, None) > 0
    return n, points - spaces, sum(text.count(c) for c in SYMBOLS_EACH), dup, repeat_words(h, text.split()) if many else 0


SYMBOLS_EACH = [bytes([c]) for c in SYMBOLS]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(*doc) for doc in tk.hashed_docs(tk.as_bytes(batch.column(batch.num_columns - 1)))]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measured(docs: DataFrame, keep: dict[str, Column], text: Column) -> DataFrame:
    """The columns ``keep`` and the five measures of each whole text. A null text has no words and counts as empty."""
    narrow = docs.select(*(c.alias(k) for k, c in keep.items()), text.cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_measured, f"{fields}, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(docs: DataFrame, host: str, failed: str, max_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """One row a host: its documents, failures, shrunken failure rate and verdict.

    ``failed`` counts as no failure where it is null; rows with a null host belong to no host and are left out.  The
    prior Beta(a, b) is fitted by moments to the hosts' rates, less the spread that drawing alone gives; hosts that do
    not differ beyond chance get the common rate.  Empty input gives no rows.
    """
    hosts = (
        docs.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(failed).cast("long"), F.lit(0))).alias("x"))
    )
    prior = hosts.agg(
        F.sum("n").alias("_n"),
        F.sum("x").alias("_x"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("x") * F.col("x") / F.col("n")).alias("_xx"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("_nn"),
    )
    m = F.col("_x") / F.col("_n")
    spread = F.col("_xx") - m * F.col("_x")  # sum of n * (rate - m)^2
    room = F.col("_n") - F.col("_nn") / F.col("_n")
    between = F.when(room > 0, F.greatest(F.lit(0.0), (spread - (F.col("_k") - 1) * m * (1 - m)) / room)).otherwise(0.0)
    strength = F.when(between > 0, F.least(F.lit(FLAT_STRENGTH), F.greatest(F.lit(0.0), m * (1 - m) / between - 1))).otherwise(FLAT_STRENGTH)
    prior = prior.select(m.alias("_m"), strength.alias("_s"))
    rate = (F.col("x") + F.col("_m") * F.col("_s")) / (F.col("n") + F.col("_s"))
    # the prior is one row, whatever the input
    return hosts.crossJoin(F.broadcast(prior)).select(host, "n", "x", rate.alias("rate"), (rate < max_failure).alias("host_ok"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """Measures, own verdict and host verdict of every document: id, measures, ``base_failed``, ``host``,
    ``host_rate``, ``host_ok``, ``kept``.

    * null or empty text: no words, so it fails; null host: judged by its own rules alone (``host_rate`` null);
    * repeated rows each count and each come back; other columns are ignored; an empty table gives an empty table.
    """
    each = measured(docs, {id_col: docs[id_col], "host": docs[host_col].cast("string")}, docs[text_col])
    each = cut(each.withColumn("base_failed", base_failed()), "rules")
    bad = cut(host_verdicts(each, "host", "base_failed", max_host_failure), "hosts")
    joined = each.join(small(bad).select("host", F.col("rate").alias("host_rate"), "host_ok"), "host", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))
    return joined.select(id_col, *(m.split()[0] for m in MEASURES.split(", ")), "base_failed", kept.alias("kept"), "host", "host_rate", F.coalesce("host_ok", F.lit(True)).alias("host_ok"))


def passing(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for doc in tk.hashed_docs(tk.as_bytes(batch.column(text_at))):
                n, _, _, _, repeated = measure(*doc)
                ok.append(n >= 20 and 100 * repeated <= 30 * n)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def quality_filter(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host is not rejected, with all their columns.

    Nulls and repeated rows as in :func:`quality_rules`.  Whole rows are not shuffled: hosts are judged from narrow rows
    first, and the rows then pass by.
    """
    each = measured(docs, {"host": docs[host_col].cast("string")}, docs[text_col])
    bad = host_verdicts(each.withColumn("base_failed", base_failed()), "host", "base_failed", max_host_failure).where(~F.col("host_ok"))
    kept = docs.mapInArrow(passing(column_at(docs, text_col)), schema_of(docs))
    return anti_join(kept, bad.select(F.col("host").alias(host_col)), host_col)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("host_rate", F.round("host_rate", 6))


_BLANK = "\\x20\\x09-\\x0D"
SQL = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}) x),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + {WINDOW})) AS p FROM g JOIN twice USING (doc_id, g)) x GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) x WHERE regexp_matches(l, '[^{_BLANK}]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source AS host, len(w.w)::BIGINT AS n_words, length(regexp_replace(w.text, '[{_BLANK}]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INTEGER)::DOUBLE AS x FROM f WHERE host IS NOT NULL GROUP BY host),
t AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) - sum(x) / sum(n) * sum(x) AS spread, sum(n) - sum(n * n) / sum(n) AS room FROM h),
b AS (SELECT m, CASE WHEN room > 0 THEN greatest(0.0, (spread - (k - 1) * m * (1 - m)) / room) ELSE 0.0 END AS between_ FROM t),
p AS (SELECT m, CASE WHEN between_ > 0 THEN least({FLAT_STRENGTH}, greatest(0.0, m * (1 - m) / between_ - 1)) ELSE {FLAT_STRENGTH} END AS s FROM b),
r AS (SELECT host, (x + m * s) / (n + s) AS rate FROM h, p)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, NOT f.base_failed AND coalesce(r.rate < {MAX_HOST_FAILURE}, TRUE) AS kept, f.host, round(r.rate, 6) AS host_rate, coalesce(r.rate < {MAX_HOST_FAILURE}, TRUE) AS host_ok
FROM f LEFT JOIN r USING (host)
"""
