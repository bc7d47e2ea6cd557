"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of a text.  Its minimiser is the least hash among the ``m``-word grams in it, so equal
windows have equal minimisers wherever they stand, and neighbouring windows mostly share theirs.  A run of windows with one
minimiser (a super-k-mer) travels as a single packed string to the minimiser's bucket: about three times the text is sent
instead of ``k`` times.  A bucket holds every occurrence of each of its windows; sorting their hashes brings equal ones
together and the words themselves decide.  A bucket that is too large for a task (a hot minimiser) is dealt out once more by
its windows.  What comes back is word ranges by text, which are joined to those documents that a filter of the texts' keys
passes.

Identical texts share a key (96 bits of MD5): in a task's buffer they are packed once, marked as many, and the ranges that
come back serve all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk
from gleanery.llm.tables import cut, has_key, key_bits, release, scope, spread_join

WINDOW = 35
GRAM = 8
#: A run is packed in pieces of at most this many windows; pieces of a run go to the same bucket.
MAX_RUN = 128
#: A task packs and sends its buckets whenever it holds this many bytes.
BUFFER_BYTES = 48 << 20
#: Or has seen this many texts.
BUFFER_TEXTS = 400_000
#: A bucket of more packed bytes than this (a minimiser that stands in very many contexts) is not sorted in one task: its
#: windows are dealt out once more, one by one.
BUCKET_BYTES = 48 << 20
KEY = 12


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(h: np.ndarray, k: int = WINDOW, m: int = GRAM, max_run: int = MAX_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes: first window, last-plus-one window and minimiser of each run of windows."""
    if len(h) < k:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    least = sliding_min(tk.window_hashes(h, m), k - m + 1)
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(at[1:], len(least))
    if (last - at).max() > max_run:
        at = np.concatenate([np.arange(a, b, max_run) for a, b in zip(at, last, strict=True)])
        last = np.append(at[1:], len(least))
    return at, last, least[at]


def text_key(text: bytes) -> bytes:
    return hashlib.md5(text).digest()[:KEY]


def pack(strings: dict[bytes, list]) -> bytes:
    """Distinct packed strings with, for each, whether its windows are known to repeat, and where it stands."""
    texts, many, counts, keys, starts = [], bytearray(), [], [], []
    for text, (repeated, places) in strings.items():
        texts.append(text)
        many.append(repeated)
        counts.append(len(places) // 2)
        keys += places[::2]
        starts += places[1::2]
    body = b"\n".join(texts)
    head = np.array([len(body), len(counts), len(keys)], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + body + bytes(many) + np.array(counts, np.uint32).tobytes() + np.array(starts, np.uint32).tobytes() + b"".join(keys))


def unpack(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size, n, places = np.frombuffer(data, np.uint32, 3).tolist()
    at = 12 + size
    body, many = data[12:at], np.frombuffer(data, np.uint8, n, at)
    counts = np.frombuffer(data[at + n : at + 5 * n], np.uint32)
    starts = np.frombuffer(data[at + 5 * n : at + 5 * n + 4 * places], np.uint32)
    return body, many, counts, starts, data[at + 5 * n + 4 * places :]


def packer(buckets: int, k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        seen: dict[bytes, bool] = {}
        size = 0

        def flush():
            ids = list(held)
            step = 256
            for i in range(0, len(ids), step):
                part = ids[i : i + step]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pack(held.pop(b)) for b in part], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            fresh = []
            for text in tk.as_bytes(batch.column(0)):
                key = text_key(text or b"")
                if key not in seen:
                    seen[key] = False
                    fresh.append((text or b"", key))
                elif not seen[key]:  # once more is enough: every window of it repeats
                    seen[key] = True
                    fresh.append((text or b"", key))
            for (text, start, end, h), (_, key) in zip(tk.hashed_docs(b" ".join(t.split()) for t, _ in fresh), fresh, strict=True):
                first, last, least = super_kmers(h, k, m)
                a, b = start[first].tolist(), end[last + (k - 2)].tolist() if len(first) else []
                for i, (x, y, at, bucket) in enumerate(zip(a, b, first.tolist(), (least % np.uint64(buckets)).tolist(), strict=True)):
                    strings = held.setdefault(bucket, {})
                    packed = text[x:y]
                    got = strings.get(packed)
                    if got is None:
                        strings[packed] = [False, [key, at]]
                        size += y - x + 60
                    else:
                        got[0] = True
                        got[1] += (key, at)
                        size += 60
            if size > BUFFER_BYTES or len(seen) > BUFFER_TEXTS:
                yield from flush()
                seen, size = {}, 0
        yield from flush()

    return run


def repeated_windows(body: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of newline-separated packed strings: string and word offset of every window whose words also start elsewhere."""
    hashes, string, offset, left, right = [], [], [], [], []
    base = line0 = 0
    while base < len(body):
        stop = len(body) if base + tk.SLICE_BYTES >= len(body) else body.find(b"\n", base + tk.SLICE_BYTES)
        stop = len(body) if stop < 0 else stop
        part = body[base:stop]
        start, end = tk.words(part)
        w = tk.window_hashes(tk.word_hashes(part, start, end), k)
        ends = np.flatnonzero(np.frombuffer(part, np.uint8) == 10)
        line = np.searchsorted(ends, start)
        ok = np.flatnonzero(line[: len(w)] == line[k - 1 : k - 1 + len(w)])
        first = np.searchsorted(line, np.arange(len(ends) + 1))
        hashes.append(w[ok])
        string.append((line[ok] + line0).astype(np.uint32))
        offset.append((ok - first[line[ok]]).astype(np.uint32))
        left.append((start[ok] + base).astype(np.int64))
        right.append((end[ok + k - 1] + base).astype(np.int64))
        line0 += len(ends) + 1
        base = stop + 1
    if not hashes:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    w, string, offset, left, right = map(np.concatenate, (hashes, string, offset, left, right))
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    twin = np.zeros(len(w), bool)
    i, j = order[same], order[same + 1]
    clash = []
    lj, rj = left[j].tolist(), right[j].tolist()
    for n, (a, b) in enumerate(zip(left[i].tolist(), right[i].tolist(), strict=True)):
        if body[a:b] != body[lj[n] : rj[n]]:
            clash.append(n)
    twin[i] = twin[j] = True
    for v in {int(s[same[n]]) for n in clash}:  # different words under one hash: sort them out by the words
        at = order[np.searchsorted(s, np.uint64(v)) : np.searchsorted(s, np.uint64(v), "right")].tolist()
        groups: dict[bytes, list[int]] = {}
        for x in at:
            groups.setdefault(body[left[x] : right[x]], []).append(x)
        for g in groups.values():
            twin[g] = len(g) > 1
    return string[twin], offset[twin]


def bucket_ranges(blobs: list[bytes], k: int) -> dict[bytes, list[int]]:
    """Word ranges to remove, flat (first, last plus one), by text key."""
    parts = [unpack(b) for b in blobs]
    body = b"\n".join(p[0] for p in parts)
    many, counts, starts = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    keys = b"".join(p[4] for p in parts)
    place = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    found: dict[int, list[tuple[int, int]]] = {}
    string, offset = repeated_windows(body, k)
    order = np.lexsort((offset, string))
    string, offset = string[order].astype(np.int64), offset[order].astype(np.int64)
    if len(string):
        turn = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        last = np.append(turn[1:], len(string)) - 1
        for s, a, b in zip(string[turn].tolist(), offset[turn].tolist(), (offset[last] + k).tolist(), strict=True):
            found.setdefault(s, []).append((a, b))
    whole = np.flatnonzero(many).tolist()
    if whole:
        spaces = np.cumsum(np.frombuffer(body, np.uint8) == 32)
        ends = np.append(np.flatnonzero(np.frombuffer(body, np.uint8) == 10), len(body))
        for s in whole:
            a, b = (int(ends[s - 1]) + 1 if s else 0), int(ends[s])
            found[s] = [(0, int(spaces[b - 1] - spaces[a]) + 1)]
    out: dict[bytes, list[int]] = {}
    for s, ranges in found.items():
        for p in range(int(place[s]), int(place[s + 1])):
            at = int(starts[p])
            row = out.setdefault(keys[KEY * p : KEY * p + KEY], [])
            for a, b in ranges:
                row += (at + a, at + b)
    return out


def bucket_windows(blob: bytes, k: int) -> Iterator[tuple[list[bytes], list[bytes], list[int]]]:
    """Window hashes (128 bits of the words), text keys and first words of every window at every place of a packed blob."""
    body, _, counts, starts, keys = unpack(blob)
    place = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tolist()
    for s, text in enumerate(body.split(b"\n")):
        words = text.split(b" ")
        hashes = [hashlib.blake2b(b" ".join(words[i : i + k]), digest_size=16).digest() for i in range(len(words) - k + 1)]
        for p in range(place[s], place[s + 1]):
            yield hashes, [keys[KEY * p : KEY * p + KEY]] * len(hashes), [int(starts[p]) + i for i in range(len(hashes))]


def finder(k: int, most: int):
    """Ranges by text key; for buckets of more than ``most`` bytes each window with its hash and its range instead."""
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.binary())

    def batch_of(keys, ranges, windows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((keys, ranges, windows), kinds, strict=True)], names=["key", "ranges", "window"])

    def apart(blob: bytes):
        for hashes, keys, at in bucket_windows(blob, k):
            yield batch_of(keys, [[a, a + k] for a in at], hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
                size[bucket] = size.get(bucket, 0) + len(blob)
                if size[bucket] > most:
                    while held[bucket]:
                        yield from apart(held[bucket].pop())
        for bucket in list(held):
            blobs = held.pop(bucket)
            ranges = bucket_ranges(blobs, k) if blobs else None
            if ranges:
                yield batch_of(list(ranges), list(ranges.values()), [None] * len(ranges))

    return run


def repeated_ranges(found: DataFrame) -> DataFrame:
    """``key, ranges`` of what :func:`finder` found; of single windows, those whose hash comes twice or more."""
    single = found.where("window is not null")
    if not single.take(1):
        return found.select("key", "ranges")
    twice = cut(single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "windows")
    total = twice.agg(F.sum("n")).first()[0] or 0
    return found.where("window is null").select("key", "ranges").unionByName(spread_join(single, twice, "window", "n", total).where("n is not null").select("key", "ranges"))


def kept_words(words: list[bytes], ranges: list[int] | None) -> list[bytes]:
    if not ranges:
        return words
    r = np.asarray(ranges).reshape(-1, 2)
    reach = np.zeros(len(words) + 1, np.int64)
    np.add.at(reach, r[:, 0], 1)
    np.add.at(reach, r[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(reach)[:-1] == 0).tolist()]


def _key(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in column.to_pylist()), ">u8").astype(np.uint64)


def chooser(bits, passing: bool):
    """Of (id, key, text) rows those whose key passes the filter, or those whose key does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_key(bits.value, _key(batch.column(1))) == passing))

    return run


def rest(bits):
    """The result of rows whose text loses nothing."""
    pick = chooser(bits, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pick(batches):
            yield from _removed([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.nulls(batch.num_rows, pa.list_(pa.int32()))], names=["id", "text", "ranges"])])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept_text = [], [], []
        for text, ranges in zip(tk.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            kept = kept_words(words, ranges)
            n.append(len(words))
            gone.append(len(words) - len(kept))
            kept_text.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_text, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) of every row: each word in
    a window of ``window`` words whose sequence also starts anywhere else, in any row, is removed.

    Windows are judged on the input.  Null texts have no words; texts shorter than a window lose nothing; repeated rows
    repeat each other's windows, so rows of a window or more lose everything; null ids are passed on; other columns are
    ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    blobs = text.mapInArrow(packer(4 * parts, window, gram), "bucket int, blob binary")
    with scope():
        found = cut(blobs.repartition(parts, "bucket").mapInArrow(finder(window, BUCKET_BYTES), "key binary, ranges array<int>, window binary"), "found")
        del blobs
        release(spark)
        ranges = cut(repeated_ranges(found).groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges", keep=True)  # a row is at most a text's own windows
    bits = spark.sparkContext.broadcast(key_bits(ranges.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long"))))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select("id", F.unhex(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 2 * KEY)).alias("key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_text string"
    # only rows whose text may lose something are shuffled
    joined = rows.mapInArrow(chooser(bits, True), f"id {kind}, key binary, text string").join(ranges, "key", "left").select("id", "text", "ranges")
    return joined.mapInArrow(_removed, schema).unionByName(rows.mapInArrow(rest(bits), schema)).withColumnRenamed("id", id_col)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


_W = f"""
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}) x)"""
SQL = f"""
WITH {_W},
twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(g.i, g.i + {WINDOW})) AS p FROM g JOIN twice USING (g)) x),
each AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) x),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(w.w), 0)::BIGINT AS n_words, (coalesce(len(w.w), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
