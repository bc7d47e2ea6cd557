"""Benchmark decontamination: seeds of word pairs, then local alignment.

Test items are a stated query set that is held against every passage of the corpus, in blocks of ``BLOCK_ITEMS`` items, so
that what a task is sent is bounded.  For a block, one pass over the corpus counts in how many texts each of the items'
word pairs (neighbours, and words with one between them) occurs; a second pass looks for an item's rarest ones and aligns
the item with the text around them by Smith-Waterman over words, so that edited and paraphrased copies are scored as well.
Nothing is shuffled but the counts.

No alignment of the threshold avoids the seeds.  One of m matched and e other words scores m - e/2; at t * n or more, e is
2 (m - t n) at most, so that of its m - 1 steps from match to match no more than m - t n pass over two or more words, and
t n - 1 or more are a pair of the item and of the text (see :func:`sure_steps`).  Of an item's c pairs that stand in any
text, the c - (t n - 1) + ``AGREE`` rarest therefore hold ``AGREE`` of every alignment's steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanery.llm import textkit as tk
from gleanery.llm.tables import column_at, cut, schema_of

#: Words of an item from which it is aligned; a shorter one is only found where it is the whole text.
SEED = 3
BLOCK_ITEMS = 20_000
#: Seeds of an item, at different words of it, that a place must show (fewer where an item has no more sure steps).
AGREE = 3
MISMATCH = GAP = 0.5
#: Alignment score over the item's words from which a text counts as contaminated.
THRESHOLD = 0.5
_FILTER = 1 << 22

#: ASCII punctuation parts words; letters are compared in lower case (A-Z).
_FLAT = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def flat(text: bytes | None) -> bytes:
    return (text or b"").translate(_FLAT).lower()


def pair_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every two neighbouring words and of every two with one word between them, and where they begin.  The
    distance is not hashed: where a word was put in or left out, the two kinds meet."""
    near, far = (tk.mix(h[: max(0, len(h) - d)] * np.uint64(0xFF51AFD7ED558CCD) + h[d:]) for d in (1, 2))
    return np.concatenate([near, far]), np.concatenate([np.arange(len(near)), np.arange(len(far))])


def sure_steps(n: int, threshold: float) -> int:
    """Steps over at most one other word in every alignment of ``threshold`` with an item of ``n`` words (MISMATCH and GAP
    are one half)."""
    return max(1, math.ceil(threshold * n - 1e-9) - 1)


@dataclass
class Items:
    """A block of items: word hashes, and their distinct pairs in order with the places where they stand."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray

    def short(self) -> dict[tuple, list[int]]:
        """Items without seeds, by their words."""
        out: dict[tuple, list[int]] = {}
        for i, h in enumerate(self.words):
            if 0 < len(h) < SEED:
                out.setdefault(tuple(h.tolist()), []).append(i)
        return out

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        ids = [i for i, _ in rows]
        words = [h.copy() for *_, h in tk.hashed_docs(flat(t.encode()) for _, t in rows)]
        pairs = [pair_hashes(h if len(h) >= SEED else h[:0]) for h in words]
        all_ = np.concatenate([*(g for g, _ in pairs), np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(ids)), [len(g) for g, _ in pairs])
        at = np.concatenate([*(p for _, p in pairs), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(all_, kind="stable")
        distinct, first = np.unique(all_[order], return_index=True)
        return cls(ids, words, distinct, np.append(first, len(all_)), item[order], at[order])

    def seen_filter(self) -> np.ndarray:
        out = np.zeros(_FILTER, bool)
        out[(self.grams & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        return out

    def seeds(self, counts: np.ndarray, threshold: float) -> Items:
        """Only the pairs at each item's rarest words, by ``counts`` of the distinct pairs, of those that occur: so many
        that every alignment of ``threshold`` shows ``AGREE`` of them."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        occurs = counts[gram] > 0
        width = max((len(w) for w in self.words), default=0) + 1
        word = self.item * width + self.at
        words, which = np.unique(word[occurs], return_inverse=True)
        common = np.bincount(which, counts[gram[occurs]], len(words))
        item = words // width
        order = np.lexsort((words, common, item))
        held = np.bincount(item, minlength=len(self.ids))
        start = np.concatenate([[0], np.cumsum(held)])[:-1]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(order)) - start[item[order]]
        sure = np.array([sure_steps(len(w), threshold) for w in self.words], np.int64)
        most = held - sure + np.minimum(AGREE, sure)
        keep = occurs.copy()
        keep[occurs] = ((held >= sure)[item] & (rank < most[item]))[which]
        kept, first = np.unique(gram[keep], return_index=True)
        return Items(self.ids, self.words, self.grams[kept], np.append(first, keep.sum()), self.item[keep], self.at[keep])


def found_grams(h: np.ndarray, items: Items, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a text where one of the items' pairs stands, and which."""
    g, place = pair_hashes(h)
    at = np.flatnonzero(maybe[(g & np.uint64(_FILTER - 1)).astype(np.int64)])
    if not len(at) or not len(items.grams):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i = np.minimum(np.searchsorted(items.grams, g[at]), len(items.grams) - 1)
    ok = items.grams[i] == g[at]
    return place[at[ok]], i[ok]


def counter(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        maybe, counts = block.seen_filter(), np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for *_, h in tk.hashed_docs(flat(t) for t in tk.as_bytes(batch.column(0))):
                counts[np.unique(found_grams(h, block, maybe)[1])] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["gram", "n"])

    return run


def align_rows(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of ``a`` in ``b``: score, and last words of both (exclusive)."""
    k = GAP * np.arange(len(b) + 1)
    prev = np.zeros(len(b) + 1)
    best, end_a, end_b = 0.0, 0, 0
    for i, w in enumerate(a):
        t = np.maximum(prev - GAP, 0.0)
        np.maximum(t[1:], prev[:-1] + np.where(b == w, 1.0, -MISMATCH), out=t[1:])
        prev = np.maximum.accumulate(t + k) - k
        j = int(prev.argmax())
        if prev[j] > best:
            best, end_a, end_b = float(prev[j]), i + 1, j
    return best, end_a, end_b


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score (match 1) and the range of ``b`` that the best alignment covers."""
    best, end_a, end_b = align_rows(a, b)
    if not best:
        return 0.0, 0, 0
    _, _, back = align_rows(a[:end_a][::-1], b[:end_b][::-1])
    return best, end_b - back, end_b


def matches_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Words that ``a`` and ``b`` have in common, with repeats: no alignment scores more."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    i = np.searchsorted(v, u)
    hit = (i < len(v)) & (v[np.minimum(i, len(v) - 1)] == u)
    return int(np.minimum(n[hit], m[i[hit]]).sum())


def places(h: np.ndarray, items: Items, maybe: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int]]]:
    """(item, the places in the text where it would begin, in order) for hits of an item's seeds that lie so close that
    one alignment could hold them and that show enough different seeds."""
    at, gram = found_grams(h, items, maybe)
    if not len(at):
        return
    many = items.first[gram + 1] - items.first[gram]
    x = np.repeat(items.first[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, word, start = items.item[x], items.at[x], np.repeat(at, many) - items.at[x]
    order = np.lexsort((start, item))
    item, word, start = item[order], word[order], start[order]
    length = np.array([len(items.words[i]) for i in item.tolist()])
    cuts = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (np.diff(start) > length[1:]), [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        least = min(AGREE, sure_steps(int(length[a]), threshold))
        if b - a >= least and len(set(word[a:b].tolist())) >= least:
            yield int(item[a]), start[a:b].tolist()


def alignments(h: np.ndarray, items: Items, maybe: np.ndarray, threshold: float, short: dict[tuple, list[int]]) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, last word plus one) of every place of a text that aligns with an item."""
    out = [(i, 1.0, 0, len(h)) for i in short.get(tuple(h.tolist()), ())] if len(h) < SEED else []
    for item, starts in places(h, items, maybe, threshold):
        a = items.words[item]
        need = threshold * len(a)

        def aligned(first: int, last: int, slack: int):
            low, high = max(0, first - slack), min(len(h), last + len(a) + slack)  # noqa: B023
            if matches_bound(a, h[low:high]) < need:  # noqa: B023
                return None
            score, x, y = align(a, h[low:high])  # noqa: B023
            return (item, score / len(a), low + x, low + y) if score >= need else None  # noqa: B023

        if matches_bound(a, h[max(0, starts[0] - len(a)) : starts[-1] + 2 * len(a)]) < need:
            continue
        slack = len(a) // 2 + 3
        groups = [[starts[0], starts[0]]]
        for s in starts[1:]:
            if s - groups[-1][1] <= slack:
                groups[-1][1] = s
            else:
                groups.append([s, s])
        found, rest = [], []
        for first, last in groups:
            hit = aligned(first, last, slack)
            found += [hit] if hit else []
            rest += [] if hit else [(first, last)]
        found += filter(None, (aligned(first, last, len(a)) for first, last in rest))  # copies with long insertions reach further
        out += found
    return apart(out)


def apart(found: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
    """Places of which no two of one item overlap: the better one stays, of equal ones the earlier."""
    kept: dict[int, list] = {}
    for place in sorted(found, key=lambda p: (-p[1], p[2], p[3])):
        mine = kept.setdefault(place[0], [])
        if not any(x < place[3] and place[2] < y for *_, x, y in mine):
            mine.append(place)
    return [p for mine in kept.values() for p in mine]


def finder(items, threshold: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        maybe, short = block.seen_filter(), block.short()
        for batch in batches:
            rows, which, score, first, last = [], [], [], [], []
            for i, (*_, h) in enumerate(tk.hashed_docs(flat(t) for t in tk.as_bytes(batch.column(1)))):
                for item, s, a, b in alignments(h, block, maybe, threshold, short):
                    rows.append(i)
                    which.append(block.ids[item])
                    score.append(s)
                    first.append(a)
                    last.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, kind), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["id", "item_id", "score", "first_word", "last_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for every place of a text that aligns with a test item: ``id_col``, ``item_id``, ``score`` (alignment score
    over the item's words, at most 1), ``first_word`` and ``last_word`` (exclusive; words as :func:`flat` parts them).
    Places of an item do not overlap.  A ``threshold`` must be more than one word of each item.

    Null and empty texts hold nothing; an item of fewer than ``SEED`` words is found in texts that consist of it alone;
    items without text are not looked for; repeated items are looked for once each; item ids keep their type; repeated rows
    and null ids, of texts and items, come back as they are; other columns are ignored; an empty table on either side gives
    no rows.
    """
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    item = benchmark.schema[column_at(benchmark, item_col)].dataType
    schema = f"id {kind}, item_id {item.simpleString()}, score double, first_word long, last_word long"
    out = None
    for seeds in seed_blocks(narrow, benchmark, item_col, threshold):
        found = narrow.mapInArrow(finder(seeds, threshold, to_arrow_type(item)), schema)
        out = found if out is None else cut(out, "contaminated").unionByName(found)
    return out.withColumnRenamed("id", id_col)


def seed_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", threshold: float = THRESHOLD):
    """Broadcasts of the items with their seeds, block by block; ``docs`` has a column ``text``."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for n in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).orderBy("item_id", "text").collect()  # about BLOCK_ITEMS rows
        block = Items.of([(r["item_id"], r["text"]) for r in mine])
        shared = spark.sparkContext.broadcast(block)
        counts = np.zeros(len(block.grams), np.int64)
        for r in docs.select("text").mapInArrow(counter(shared), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # the block's pairs at most
            counts[r["gram"]] = r["n"]
        yield spark.sparkContext.broadcast(block.seeds(counts, threshold))


def without_items(items, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        maybe, short = block.seen_filter(), block.short()
        for batch in batches:
            ok = [not alignments(h, block, maybe, threshold, short) for *_, h in tk.hashed_docs(flat(t) for t in tk.as_bytes(batch.column(text_at)))]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item is found (see :func:`contaminated`, also for
    nulls).  Texts, repeated rows and columns of any other name stay as they are; an empty table on either side takes
    nothing away."""
    narrow = docs.select(docs[text_col].cast("string").alias("text"))
    for seeds in seed_blocks(narrow, benchmark, item_col, threshold):
        docs = docs.mapInArrow(without_items(seeds, column_at(docs, text_col), threshold), schema_of(docs))
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The best place for each document and item."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.max(F.struct("score", -F.col("first_word"), F.col("last_word")))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_places"))
    return found.select("doc_id", "item_id", F.round("b.score", 6).alias("score"), (-F.col("b.col2")).alias("first_word"), F.col("b.last_word").alias("last_word"), "n_places")
