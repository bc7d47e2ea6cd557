"""Exact self-join on the Jaccard similarity of word n-gram sets, by prefix filtering.

1. Every text becomes its set of shingle hashes; equal sets are one class from then on.  The same pass counts shingles in
   a fixed table of counters, over all rows.
2. A set is ordered rarest first by those counts.  Sets that are similar enough share a shingle among the first
   ``n - ceil(t n) + 1`` of both, so only that prefix is posted, in compressed blocks, to the shingle's bucket.
3. Within a shingle's group, the length filter and the positional filter decide which pairs are candidates, and what two
   prefixes share in all which of them are worth a look at the texts.  A candidate
   pair is verified once, whatever shingles it shares: a suffix filter first, then the intersection of the sets.
4. Groups are not expanded into all their pairs.  Members are first compared with a hub of their group; once links have
   merged classes into components, only pairs across components can still matter.  Hub rounds go on with other hubs while
   those pairs are many, and whatever is left is then compared in full, so no component is missed.
5. Every link lies within a component.  Where the verified links of one are not all its pairs, its sets are dealt to blocks
   by size and salt, and every two blocks whose sizes allow it are intersected in full, as a product of incidence matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk
from gleanery.llm.components import components
from gleanery.llm.tables import anti_join, cut, has_key, key_bits, release, scope, small, spread_join

SHINGLE = 5
#: The threshold as a fraction: similar when 5 * both >= 4 * either.
NUM, DEN = 4, 5
SKETCH = 1 << 20
SEGMENTS = 64
BUFFER_POSTINGS = 1_000_000
#: A block of a component's sets for counting links holds about so many sets, and shingles, whichever is reached first.
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000
_COLUMNS = 4096
#: Hub rounds at most, before what is left is compared in full.
HUB_ROUNDS = 2
#: Hubs of a group and size class in each of them.
HUBS = 16
#: Members of a block of a group, where all its pairs are looked at.
GROUP_BLOCK = 2000


def enough(nx: int, ny: int) -> int:
    """Least size of the intersection of similar sets of these sizes."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


def text_sets(texts) -> Iterator[np.ndarray]:
    for _, _, _, h in tk.hashed_docs((t or b"").lower() for t in texts):
        yield tk.shingle_set(h, SHINGLE)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.uint32)
    names = ["id", "text_key", "set_key", "n", "segment", "counts"]
    kind = pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        keys, sizes, held = [], [], []
        for s in text_sets(tk.as_bytes(batch.column(2))):
            keys.append(set_key(s))
            sizes.append(len(s))
            held.append(s & np.uint64(SKETCH - 1))
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        rows = len(keys)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    if counts.any():
        parts = [p.tobytes() for p in np.split(counts, SEGMENTS)]
        none = [pa.nulls(SEGMENTS, t) for t in (kind, pa.binary(), pa.binary(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for seg, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[seg] = held.get(seg, 0) + np.frombuffer(part, np.uint32).astype(np.uint64)
    if held:
        parts = [np.minimum(v, np.uint64(2**32 - 1)).astype(np.uint32).tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(parts, pa.binary())], names=["segment", "counts"])


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """The counters of all rows, ``SKETCH`` of them whatever the input."""
    rows = sets.where("segment is not null").select("segment", "counts").repartition(SEGMENTS, "segment").mapInArrow(_summed, "segment int, counts binary").collect()
    out = np.zeros(SKETCH, np.uint32)
    for r in rows:
        out[r["segment"] * (SKETCH // SEGMENTS) :][: SKETCH // SEGMENTS] = np.frombuffer(r["counts"], np.uint32)
    return out


def rare_first(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set, rarest first; equal counts by hash, so that all sets agree."""
    return s[np.argsort(counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")]


def poster(counts, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        done: set[bytes] = set()
        held: list[tuple] = []
        size = 0

        def flush():
            token, key, n, at = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = (token >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            token, key, n, at, bucket = (x[order] for x in (token, key, n, at, bucket))
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            z = zstandard.ZstdCompressor(level=1)
            ids, blobs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids.append(int(bucket[a]))
                # tokens that agree in their low half here only make candidates; the sets decide
                blobs.append(z.compress(np.uint32(b - a).tobytes() + token[a:b].astype(np.uint32).tobytes() + key[a:b].tobytes() + n[a:b].tobytes() + at[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for s in text_sets(tk.as_bytes(batch.column(0))):
                n = len(s)
                key = set_key(s)
                if not n or key in done:
                    continue
                done.add(key)
                p = n - -(-NUM * n // DEN) + 1
                held.append((rare_first(s, table)[:p], np.full(p, int.from_bytes(key[:8]), np.uint64), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32)))
                size += p
                if size > BUFFER_POSTINGS:
                    yield flush()
                    held, size, done = [], 0, set()
        if held:
            yield flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of shingles that two or more sets have in their prefixes."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(bucket, []).append(blob)
    for bucket in list(held):
        parts = []
        for blob in held.pop(bucket):
            data = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(data, np.uint32, 1)[0])
            at, cols = 4, []
            for kind in (np.uint32, np.uint64, np.uint32, np.uint32):
                cols.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
            parts.append(cols)
        token, key, n, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((pos, key, token))
        token, key, n, pos = (x[order] for x in (token, key, n, pos))
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])])
        token, key, n, pos = (x[first] for x in (token, key, n, pos))  # several tasks post the same set
        same = token[1:] == token[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if shared.any():
            gid = (np.int64(bucket) << np.int64(32)) | token[shared].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(key[shared].view(np.int64)), pa.array(n[shared].view(np.int32)), pa.array(pos[shared].view(np.int32))], names=["gid", "key", "n", "pos"])


def candidates(left: DataFrame, right: DataFrame, more=None) -> DataFrame:
    """Distinct pairs of a member and another of its group that pass the length and the positional filter."""
    x, y = left.alias("x"), right.alias("y")
    on = (F.col("x.gid") == F.col("y.gid")) & (F.col("x.key") != F.col("y.key"))
    nx, ny = F.col("x.n"), F.col("y.n")
    length = DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)
    rest = F.least(nx - F.col("x.pos"), ny - F.col("y.pos"))
    positional = (NUM + DEN) * rest >= NUM * (nx + ny)
    on = on & length & positional if more is None else on & length & positional & more
    return x.join(y, on).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def promising(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs whose prefixes have enough shingles in common: of two similar sets, the one whose prefix ends first in the
    common order shares with the other only what both prefixes show and what its own suffix holds."""
    x = prefixes.select(F.col("key").alias("a"), F.col("n").alias("nx"), F.col("gids").alias("gx"), F.col("extra").alias("ex"))
    y = prefixes.select(F.col("key").alias("b"), F.col("n").alias("ny"), F.col("gids").alias("gy"), F.col("extra").alias("ey"))
    both = pairs.join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("gx", "gy")) + F.least("ex", "ey")  # what a prefix holds twice counts twice
    suffix = F.ceil(F.greatest("nx", "ny") * NUM / DEN).cast("int") - 1
    return both.where((NUM + DEN) * (shared + suffix) >= NUM * (F.col("nx") + F.col("ny"))).select("a", "b")


def size_class(n: Column) -> Column:
    """Sets that can be similar are of one class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(DEN / NUM))).cast("int")


def blocked_pairs(rows: DataFrame) -> DataFrame:
    """:func:`candidates` of all members of a group with all others of other components, each pair once.

    The members of a group are dealt to blocks by size class and salt, and every two blocks whose classes allow it are one
    key, so no key holds a hot group."""
    rows = rows.withColumn("size", size_class(F.col("n")))
    blocks = rows.groupBy("gid", "size").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks"))
    salt = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    placed = rows.join(blocks, ["gid", "size"]).withColumn("salt", salt).drop("blocks")
    beside = blocks.select("gid", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), F.col("size").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_salt"))
    each = placed.join(beside, ["gid", "size"])
    mine, other = F.struct("size", "salt"), F.struct(F.col("other").alias("size"), F.col("other_salt").alias("salt"))
    sent = each.select("gid", "key", "n", "pos", "comp", F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"))
    x, y = sent.alias("x"), sent.alias("y")
    on = (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.key") < F.col("y.key"))
    return candidates(sent, sent, on)


def hubs(groups: DataFrame, turn: int, many: int = 1) -> DataFrame:
    """``many`` members (fewer if they coincide) for each group and size class, others at every turn; neighbouring classes
    see each other's hubs."""
    least = [F.min(F.struct(F.xxhash64("key", F.lit(turn), F.lit(j)).alias("r"), "key", "n", "pos")).alias(f"h{j}") for j in range(many)]
    hub = groups.withColumn("size", size_class(F.col("n"))).groupBy("gid", "size").agg(*least)
    each = F.array_distinct(F.array(*(F.struct(f"h{j}.key", f"h{j}.n", f"h{j}.pos") for j in range(many))))
    return hub.select("gid", F.explode(each).alias("h")).select("gid", "h.key", "h.n", "h.pos")


def compressor(wanted):
    """(text_key, z): the lower-cased text of each distinct key that the filter passes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, done = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            some = has_key(wanted.value, np.frombuffer(b"".join(k[:8] for k in keys), ">u8").astype(np.uint64))
            done = set() if len(done) > 1_000_000 else done
            rows = [i for i in np.flatnonzero(some).tolist() if keys[i] not in done and not done.add(keys[i])]
            part = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([z.compress((t or b"").lower()) for t in tk.as_bytes(part.column(1))], pa.binary())], names=["text_key", "z"])

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """No intersection of the sorted arrays is larger: they are split at a middle element again and again, and each pair
    of parts shares no more than the smaller one holds."""
    if not len(x) or not len(y):
        return 0
    if depth == 0 or len(x) < 16 or len(y) < 16:
        return min(len(x), len(y))
    mid = y[len(y) // 2]
    at = int(np.searchsorted(x, mid))
    return suffix_bound(x[:at], y[: len(y) // 2], depth - 1) + suffix_bound(x[at:], y[len(y) // 2 :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    need = enough(len(x), len(y))
    if suffix_bound(x, y) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    held: dict[bytes, np.ndarray] = {}
    for batch in batches:
        a, b, za, zb = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i in range(len(a)):
            if a[i] not in held:
                if len(held) > 64:
                    held.clear()
                held[a[i]] = next(text_sets([d.decompress(za[i])]))
            if similar(held[a[i]], next(text_sets([d.decompress(zb[i])]))):
                keep.append(i)
        at = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``."""
    one, other = np.unique(np.concatenate(x)), np.unique(np.concatenate(y))
    shared = np.intersect1d(one, other, assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float32)

    def places(sets):
        row, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        ok = shared[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    if len(shared):
        (rx, cx), (ry, cy) = places(x), places(y)
        for low in range(0, len(shared), _COLUMNS):
            width = min(_COLUMNS, len(shared) - low)
            parts = []
            for rows, row, at in ((len(x), rx, cx), (len(y), ry, cy)):
                a, b = np.searchsorted(at, (low, low + width))
                part = np.zeros((rows, width), np.float32)
                part[row[a:b], at[a:b] - low] = 1
                parts.append(part)
            out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their pair of blocks: for each set the copies of the sets that are similar to it."""
    d = zstandard.ZstdDecompressor()

    def counted(rows):
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        x, y = sides[0], sides[1] or sides[0]
        if not x:
            return
        sx, sy = ([next(text_sets([d.decompress(r[3])])) for r in side] for side in (x, y))
        nx, ny = (np.array([len(s) for s in side], np.int64) for side in (sx, sy))
        alike = (NUM + DEN) * intersections(sx, sy) >= NUM * (nx[:, None] + ny[None, :])
        if not sides[1]:
            np.fill_diagonal(alike, False)
        others = [alike @ np.array([r[2] for r in y], np.int64)] + ([np.array([r[2] for r in x], np.int64) @ alike] if sides[1] else [])
        keys = [r[1] for r in (x + y if sides[1] else x)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(others), pa.int64())], names=["a", "others"])

    now, held = None, []
    for batch in batches:
        for pair, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if pair != now:
                yield from counted(held)
                now, held = pair, []
            held.append(row)
    yield from counted(held)


class _Join:
    """Texts and links of ``classes``: a row a distinct set, with its copies, their least id and one of their texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.classes = docs, classes
        self.texts: DataFrame | None = None

    def fetch(self, pairs: DataFrame) -> DataFrame:
        """Compressed texts of the sets in ``pairs`` that have not been fetched before.  Texts that a filter of their keys
        does not pass are not compressed, and whole texts are not shuffled."""
        want = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        if self.texts is not None:
            want = want.join(self.texts.select("key").distinct(), "key", "left_anti")
        want = cut(self.classes.withColumnRenamed("short", "key").join(want, "key", "left_semi").select("text_key", "set_key"), "want")
        bits = self.spark.sparkContext.broadcast(key_bits(want.select(short("text_key"))))
        got = self.docs.mapInArrow(compressor(bits), "text_key binary, z binary").join(small(want), "text_key")
        got = got.groupBy("text_key", "set_key").agg(F.first("z").alias("z")).select(short("set_key").alias("key"), "set_key", "z")
        got = cut(got, "texts")
        self.texts = got if self.texts is None else self.texts.unionByName(got)
        return self.texts

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs of set keys that are similar."""
        texts = self.fetch(pairs)
        b = texts.select(F.col("key").alias("b"), F.col("set_key").alias("kb"), F.col("z").alias("zb"))
        a = texts.select(F.col("key").alias("a"), F.col("set_key").alias("ka"), F.col("z").alias("za"))
        both = pairs.join(b, "b").join(a, "a").select("ka", "kb", "za", "zb")
        return cut(both.mapInArrow(_verified, "a binary, b binary"), "links")


    def linked(self, links: DataFrame, comps: DataFrame) -> DataFrame:
        """``a`` and ``others``: the rows of all other sets that are similar to ``a``.  Sets without any may be missing."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        known = both.groupBy("a").agg(F.count(F.lit(1)).alias("known"))
        size = self.classes.select("set_key", "n", "copies")
        nodes = comps.join(size, comps["node"] == size["set_key"]).join(known, F.col("node") == known["a"], "left")
        nodes = cut(nodes.select("root", "set_key", "n", "copies", F.coalesce("known", F.lit(0)).alias("known"), size_class(F.col("n")).alias("size")), "nodes")
        whole = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("known").alias("known"))
        part = cut(whole.where("known < m * (m - 1)").select("root"), "part")
        copies = cut(nodes.join(small(part), "root", "left_anti").select(F.col("set_key").alias("b"), "copies", "known"), "copies")
        total = copies.agg(F.sum("known")).first()[0] or 0
        out = spread_join(both, copies, "b", "known", total).where("copies is not null").groupBy("a").agg(F.sum("copies").alias("others"))
        if not part.take(1):
            return out

        nodes = nodes.join(small(part), "root", "left_semi")
        blocks = nodes.groupBy("root", "size").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
        blocks = cut(blocks.select("root", "size", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_SHINGLES)).alias("blocks")), "blocks")
        each = blocks.select("root", "size", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("salt"))
        x, y = each.alias("x"), each.alias("y")
        on = (F.col("x.root") == F.col("y.root")) & (((F.col("x.size") == F.col("y.size")) & (F.col("x.salt") <= F.col("y.salt"))) | (F.col("x.size") + 1 == F.col("y.size")))
        pair = F.concat_ws(" ", F.hex("x.root"), "x.size", "x.salt", "y.size", "y.salt")
        sides = F.array_distinct(F.array(F.struct("x.size", "x.salt"), F.struct("y.size", "y.salt")))
        sides = x.join(y, on).select(F.col("x.root").alias("root"), pair.alias("pair"), F.posexplode(sides).alias("side", "s")).select("root", "s.size", "s.salt", "pair", "side")
        salt = F.pmod(F.xxhash64("set_key", F.lit("salt")), F.col("blocks")).cast("int").alias("salt")
        placed = nodes.join(small(blocks), ["root", "size"]).select("root", "size", salt, "set_key", "copies")
        sent = placed.join(self.texts.select("set_key", "z").dropDuplicates(["set_key"]), "set_key")
        sides = cut(sides, "sides")
        sent = sent.join(small(sides), ["root", "size", "salt"]).select("pair", "side", "set_key", "copies", "z")
        found = sent.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(_block_links, "a binary, others long")
        return out.unionByName(found.groupBy("a").agg(F.sum("others").alias("others")))


def short(key):
    """The first eight bytes of a set's key, as the postings have it."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """Of every row: ``id_col``, ``n_shingles``, ``component_id`` (least id reachable by links) and ``n_links``, which is
    neither counted nor returned without ``links``.

    Two rows link when their sets of lower-cased (A-Z) ``SHINGLE``-word shingles have a Jaccard similarity of
    ``NUM/DEN`` or more; a text with fewer words is one shingle.  ``n_links`` counts the other
    rows that a row links with, all of them.

    * null and empty texts have no shingles, link with nothing and are their own component;
    * repeated rows and ids link like any equal texts; a null id is passed on and never becomes a ``component_id`` unless
      its component has no other; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].alias("id"), F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))).alias("text_key"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with scope():
        read = cut(rows.mapInArrow(_sets, f"id {kind}, text_key binary, set_key binary, n int, segment int, counts binary"), "sets")
        sets = read.where("segment is null").select("id", "text_key", "set_key", "n", short(F.col("set_key")).alias("short"))
        counts = spark.sparkContext.broadcast(shingle_counts(read))
        blobs = rows.select("text").mapInArrow(poster(counts, 4 * parts), "bucket int, blob binary")
        groups = cut(blobs.repartition(parts, "bucket").mapInArrow(_groups, "gid long, key long, n int, pos int"), "groups")
        del blobs
        release(spark)
        each = [F.min("text_key").alias("text_key"), F.first("short").alias("short"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")]
        classes = cut(sets.where("n > 0").groupBy("set_key").agg(*each), "classes")
        join = _Join(rows.select("text_key", "text"), classes)
        edges, comps = _linked(join, groups)
        release(spark)
        return cut(_numbered(sets, classes, comps, join.linked(edges, comps) if links else None, id_col), "joined", keep=True)


def _linked(join: _Join, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links, enough of them to join every component, and the components."""
    prefixes = cut(groups.groupBy("key", "n").agg(F.collect_set("gid").alias("gids"), F.count(F.lit(1)).alias("many")).select("key", "n", "gids", (F.col("many") - F.size("gids")).cast("int").alias("extra")), "prefixes")
    pairs = cut(promising(candidates(groups, hubs(groups, 0)), prefixes), "pairs")
    edges = join.verify(pairs)
    comps = cut(components(edges), "components")
    members = groups.count()
    for turn in range(1, HUB_ROUNDS + 2):
        comp = comps.select(short(F.col("node")).alias("key"), short(F.col("root")).alias("comp")).groupBy("key").agg(F.min("comp").alias("comp"))
        placed = groups.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        mixed = placed.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("g")).groupBy("gid").agg(F.sum("g").alias("g"), F.sum(F.col("g").cast("double") * F.col("g")).alias("gg"), F.count(F.lit(1)).alias("k")).where("k > 1")
        across = mixed.agg(F.sum((F.col("g").cast("double") * F.col("g") - F.col("gg")) / 2)).first()[0] or 0
        if not across:
            break
        open_ = cut(placed.join(mixed.select("gid"), "gid", "left_semi"), "open")
        last = across <= 8 * members or turn > HUB_ROUNDS
        if last:
            more = blocked_pairs(open_)
        else:
            chosen = hubs(open_, turn, HUBS).join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
            more = candidates(open_, chosen, F.col("x.comp") != F.col("y.comp"))
        more = cut(promising(more, prefixes).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = join.verify(more)
        pairs = pairs.unionByName(more)
        if found.take(1):
            edges = edges.unionByName(found)
            comps = cut(components(edges), "components")
        if last:
            break
    return edges, comps


def _numbered(sets: DataFrame, classes: DataFrame, comps: DataFrame, linked: DataFrame | None, id_col: str) -> DataFrame:
    """The result's columns.  Only sets with copies or links need a look-up, and neither a hot set nor a hot component
    sends all its rows to one task."""
    known = classes.join(comps, classes["set_key"] == comps["node"], "left").where("copies > 1 or root is not null")
    known = cut(known.select("set_key", "copies", "least", F.coalesce("root", "set_key").alias("root")), "known")
    roots = cut(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("many")), "roots")
    known = spread_join(known, roots, "root", "many", known.count()).select("set_key", "copies", "component_id")
    if linked is not None:
        known = known.join(linked.groupBy(F.col("a").alias("set_key")).agg(F.sum("others").alias("others")), "set_key", "left")
        known = known.select("set_key", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = spread_join(sets.select("id", "set_key", "n"), cut(known, "known"), "set_key", "copies", sets.count())
    columns = [F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    return out.select(*columns) if linked is None else out.select(*columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar texts, the one of the least id.

    Rows with a null id and texts without words stay.  Only ids that go are joined to whole rows.  Where an id repeats,
    one of its rows stays; that costs a shuffle of whole rows, made only if there are such ids.
    """
    found = ngram_join(docs, id_col=id_col, text_col=text_col, links=False)
    kept = anti_join(docs, found.where(F.col(id_col) != F.col("component_id")), id_col)
    ids = found.where("n_shingles > 0").where(F.col(id_col).isNotNull())
    if ids.groupBy(id_col).count().where("count > 1").take(1):
        empty = ~F.coalesce(docs[text_col], F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col)))
        apart = F.col(id_col).isNull() | empty
        kept = kept.where(~apart).withColumn("__turn", turn).where("__turn = 1").drop("__turn").unionByName(kept.where(apart))
    return kept


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
