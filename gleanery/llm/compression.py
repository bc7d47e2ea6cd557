"""Quality by compression: how much better a dictionary of good text compresses a text than one of bad text does.

Two zstandard dictionaries are trained on labelled text of either kind.  A text is compressed with both, in blocks so that
the dictionary and not the text's own past decides, over its whole length.  The difference of the sizes over the text's
length, drawn towards the mean for texts too short to tell, is the only feature; a logistic curve fitted to other labelled
rows turns it into a probability.  The dictionaries come from at most ``DICT_ROWS`` rows of each kind (at most
``DICT_BYTES_A_ROW`` bytes of each) and the curve from at most ``FIT_ROWS`` rows, chosen by the hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk
from gleanery.llm.tables import cut

DICT_ROWS = 1500
DICT_BYTES_A_ROW = 16_384
FIT_ROWS = 20_000
DICT_SIZE = 110 << 10
LEVEL = 3
BLOCK = 1024
#: Bytes of an average text that are put to each text's account.
PULL = 64
THRESHOLD = 0.7


@dataclass
class Dictionaries:
    good: bytes
    bad: bytes

    def compressors(self) -> list[zstandard.ZstdCompressor] | None:
        if not self.good or not self.bad:
            return None
        out = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def dictionary(texts: list[bytes], size: int = DICT_SIZE) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    samples = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[:size]


def size_difference(text: bytes, compressors: list[zstandard.ZstdCompressor] | None) -> int:
    """Compressed bytes by the bad dictionary less those by the good one, over all blocks."""
    if not compressors:
        return 0
    good, bad = compressors
    out = 0
    for i in range(0, len(text), BLOCK):
        part = text[i : i + BLOCK]
        out += len(bad.compress(part)) - len(good.compress(part))
    return out


def differ(dicts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = dicts.value.compressors()
        for batch in batches:
            texts = [t or b"" for t in tk.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([size_difference(t, compressors) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "diff", "size"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps; one class alone gives a flat curve at its smoothed rate."""
    if len(y) == 0:
        return 0.0, 0.0
    rate = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max() or np.ptp(x) == 0:
        return float(np.log(rate / (1 - rate))), 0.0
    mean, sd = x.mean(), x.std()
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.array([np.log(rate / (1 - rate)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * mean / sd), float(w[1] / sd)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row.

    Labels are learnt only from rows that are not held out; a document labelled both ways counts as bad, null labels and
    null ids teach nothing.  Null and empty texts and texts of a few bytes score near the share of good rows; without
    labels of both kinds every score is the smoothed share of good rows (0.5 without labels).  Rows with a null id are
    scored and are not held out; repeated rows score alike; other columns are ignored.
    """
    spark = docs.sparkSession
    y = labels.select(labels["doc_id"].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    y = y.groupBy("id").agg(F.min("y").alias("y")).withColumn("turn", F.md5(F.col("id").cast("string")))
    half = F.conv(F.substring("turn", 1, 1), 16, 10).cast("int") % 2  # dictionaries and curve learn from different rows
    y = cut(y.withColumn("half", half), "labels")  # a row a labelled document
    picked = cut(y.where("y = 1 and half = 0").orderBy("turn").limit(DICT_ROWS).unionByName(y.where("y = 0 and half = 0").orderBy("turn").limit(DICT_ROWS)), "picked")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    texts = rows.join(F.broadcast(picked), "id").select("turn", "y", F.substring(F.col("text"), 1, DICT_BYTES_A_ROW).alias("text")).where("text is not null")  # 2 * DICT_ROWS rows
    sample = sorted({(r["turn"], r["y"], r["text"]) for r in texts.orderBy("turn", "text").limit(8 * DICT_ROWS).collect()})
    good, bad = ([t.encode()[:DICT_BYTES_A_ROW] for _, v, t in sample if v == k] for k in (1, 0))
    dicts = spark.sparkContext.broadcast(Dictionaries(dictionary(good) if good else b"", dictionary(bad) if bad else b""))

    kind = rows.schema["id"].dataType.simpleString()
    seen = cut(rows.mapInArrow(differ(dicts), f"id {kind}, diff long, size long"), "sizes")
    fit = y.where("half = 1").orderBy("turn").limit(FIT_ROWS)
    got = seen.join(F.broadcast(fit.select("id", "y", "turn")), "id").orderBy("turn", "diff").limit(2 * FIT_ROWS).select("diff", "size", "y").toPandas()
    diff, size, label = (got[c].to_numpy(float) for c in ("diff", "size", "y"))
    mean = float(diff.sum() / size.sum()) if size.sum() else 0.0
    if not len(label) and sample:
        label, diff, size = np.array([float(v) for _, v, _ in sample]), np.zeros(len(sample)), np.zeros(len(sample))
    a, b = fit_logistic((diff + PULL * mean) / (size + PULL), label)
    x = (F.col("diff") + PULL * mean) / (F.col("size") + PULL)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * x)))
    out = seen.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
