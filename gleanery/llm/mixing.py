"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source's target repetition rate is its share of the token budget over what it holds.  A document's number of copies is
Poisson with that mean: the inverse of the Poisson distribution function at a uniform number hashed from the seed and the
document's id, so it is the same on every run, partitioning and retry.  Copies are exploded and dealt out by a hash of
seed, id and copy number, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.tables import clash_free, cut

#: A mean is drawn as a sum of Poisson pieces of at most this mean each; their sum is Poisson with the whole mean.
PIECE_MEAN = 16.0
#: Counts that a piece's table reaches: beyond 96 a piece has less than 1e-38 of its mass, below a double's resolution.
PIECE_TOP = 96
#: Default target: weights in proportion to a source's size to this power (1: as it is, 0: all alike).
TEMPERATURE = 0.5
SEED = 20240


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. PIECE_TOP."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(PIECE_TOP)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf")),
    )
    return step["cdf"]


def source_rates(docs: DataFrame, source: Column, size: Column, weights: DataFrame | None, epochs: float, temperature: float) -> DataFrame:
    """A row for each source (null is one): rate, pieces, and the distribution table of a piece."""
    held = docs.groupBy(source.cast("string").alias("_src")).agg(F.sum(size.cast("double")).alias("_mass"))
    if weights is None:
        held = held.withColumn("_w", F.when(F.col("_mass") > 0, F.pow("_mass", F.lit(temperature))).otherwise(0.0))
    else:
        w = weights.groupBy(weights[weights.columns[0]].cast("string").alias("_name")).agg(F.sum(weights[weights.columns[1]].cast("double")).alias("_w"))
        held = held.join(w, held["_src"].eqNullSafe(w["_name"]), "left").select("_src", "_mass", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    total = held.agg(F.sum("_mass").alias("_all"), F.sum(F.when(F.col("_mass") > 0, F.col("_w"))).alias("_ws"))
    rate = F.when((F.col("_mass") > 0) & (F.col("_ws") > 0), F.col("_w") / F.col("_ws") * F.col("_all") * epochs / F.col("_mass")).otherwise(0.0)
    rates = held.crossJoin(F.broadcast(total)).select("_src", rate.alias("_rate"))  # total is one row
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PIECE_MEAN)).cast("int")
    rates = rates.withColumn("_pieces", pieces)
    return rates.withColumn("_cdf", poisson_table(F.col("_rate") / F.col("_pieces")))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, once for each copy, with ``mix_rate``, ``mix_copies``, ``mix_copy`` (from 1) and
    ``mix_key``, globally shuffled by the last.  Columns of those names are replaced.

    ``weights`` has a source and a weight in its first two columns (sources it lacks get 0, rows of a source add up, and sources
    without documents take no share);
    without it, weights follow ``temperature``.  Sizes are code points of text and the result's expected size is
    ``epochs`` times the input's.

    * a null source is a source of its own; a null or empty text has no size, and a source without size has rate 0;
    * rows with equal ids, null ones too, draw equal counts and keys; each row is replicated on its own;
    * the join with the rates is by source: the table of rates is written first, so Spark broadcasts it only below
      ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles and splits hot sources.
    """
    rates = cut(source_rates(docs, docs[source_col], F.coalesce(F.length(docs[text_col]), F.lit(0)), weights, epochs, temperature), "rates")
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    joined = docs.join(rates, docs[source_col].cast("string").eqNullSafe(rates["_src"]), "inner")
    draws = F.transform(F.sequence(F.lit(1), rates["_pieces"]), lambda j: uniform(F.lit(str(seed)), key, j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(rates["_cdf"], lambda c: c <= u)))
    made = {"mix_rate", "mix_copies", "mix_copy", "mix_key"}
    own = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in made]
    drawn = joined.where(rates["_rate"] > 0).select(*own, rates["_rate"].alias("mix_rate"), copies.alias("mix_copies")).where("mix_copies > 0")
    spread = clash_free(drawn, mix_copy=F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    mixed = clash_free(spread, mix_key=F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("mix_copy").cast("string"))))
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.withColumn("mix_rate", F.round("mix_rate", 6))


SQL = f"""
WITH held AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS mass FROM documents GROUP BY source),
w AS (SELECT source, mass, CASE WHEN mass > 0 THEN pow(mass, {TEMPERATURE}) ELSE 0 END AS w FROM held),
rates AS (SELECT source, CASE WHEN mass > 0 THEN w / sum(w) OVER () * sum(mass) OVER () / mass ELSE 0 END AS rate FROM w),
piece AS (SELECT source, rate, greatest(1, ceil(rate / {PIECE_MEAN}))::INTEGER AS pieces FROM rates WHERE rate > 0),
terms AS (SELECT source, k, exp(-(rate / pieces) + k * ln(rate / pieces) - lgamma(k + 1.0)) AS p FROM piece, range(0, {PIECE_TOP + 1}) AS t(k)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, p.rate, j,
    ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || j::VARCHAR), 1, 13))::BIGINT / {1 << 52}.0 AS u
  FROM documents d JOIN piece p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.pieces + 1)) AS j) q),
counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, count(c.c)::INTEGER AS n
  FROM draws d LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, n AS mix_copies, i::INTEGER AS mix_copy,
  md5('{SEED}:order|' || coalesce(doc_id::VARCHAR, '') || '|' || i::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM counts WHERE n > 0) x
"""
