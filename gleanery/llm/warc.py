"""WARC archives with a two-level capture index.

Pages are written as WARC records, each a gzip member of its own, into the shared folder.  The capture index holds a line
for every record, sorted by reversed-host URL key and packed into compressed blocks; a sparse directory names each block's
first key.  A lookup picks the index shard, binary-searches the shard's directory by range reads, opens one block, and
range-reads the record.  No table of all keys is ever held: a task keeps one block and one directory handle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.tables import BROADCAST_ROWS, cut, fresh_path, scope, spread_join

#: Payloads of at least this many bytes are stored once.
MIN_REVISIT = 1000
#: Lines of an index block.
BLOCK_LINES = 300
#: A task begins another archive file beyond this size.
FILE_BYTES = 1 << 30
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: str | None) -> str:
    """``http://b.example.com:80/p?q#f`` becomes ``com,example,b)/p?q``; a key never holds a space or a control."""
    rest = (url or "").split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cutat = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cutat].lower(), rest[cutat:]
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    path = path if path.startswith("/") else "/" + path
    return quote(",".join(reversed(host.split("."))) + ")" + path, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id:020d}'}"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def record(url: str | None, page_id, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member.  ``refers_to`` is the page whose response has this payload, or None for a response."""
    head = HTTP % len(payload)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Target-URI": quote(url or "", safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
        "WARC-Date": date,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": json.dumps(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    block = head + (payload if refers_to is None else b"")
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member; a response's payload must have the digest its header states."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest_of(fields):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return fields, payload


def digest_of(fields: dict[str, str]) -> str:
    return base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def archiver(folder: str, date: str):
    """Writes (url, page_id, html, digest, refers_to) rows; a retried task writes files of its own, and only those that its
    rows name count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for url, page, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = record(url, page, (html or "").encode(), digest, refers, date)
                out.write(member)
                rows.append((capture_key(url, page), name, at, len(member)))
                at += len(member)
            out.flush()
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def index_writer(folder: str):
    """Writes sorted (key, file, offset, length) rows as one shard: blocks, and a directory of first keys behind them with
    a table of fixed-width entries, so that a reader can binary-search it by range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, at, lines, n = f"index-{uuid.uuid4().hex}", 0, [], 0
        out = directory = None
        entries: list[int] = []
        dir_at = 0
        first = last = None

        def block():
            nonlocal at, dir_at
            data = gzip.compress("\n".join(lines).encode(), mtime=0)
            out.write(data)
            entry = f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(data)}\n".encode()
            directory.write(entry)
            entries.append(dir_at)
            dir_at += len(entry)
            at += len(data)
            lines.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
                directory = fs.open_output_stream(f"{root}/{name}.dir", compression=None)
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = key if first is None else first
                if len(lines) >= BLOCK_LINES and key != last:  # a key's lines stay in one block
                    block()
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                last = key
                n += 1
        if out is None:
            return
        block()
        directory.write(struct.pack(f"<{len(entries)}QQQ", *entries, dir_at, len(entries)))
        out.close()
        directory.close()
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name]), pa.array([n])], names=["first_key", "shard", "n"])

    return run


class Directory:
    """A shard's directory, read where it is needed."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        self.table_end = self.file.size() - 16
        self.text_end, self.n = struct.unpack("<QQ", self.file.read_at(16, self.table_end))

    def entry(self, i: int) -> tuple[bytes, int, int]:
        at = self.table_end - 8 * (self.n - i)
        (a,) = struct.unpack("<Q", self.file.read_at(8, at))
        b = struct.unpack("<Q", self.file.read_at(8, at + 8))[0] if i + 1 < self.n else self.text_end
        key, offset, length = self.file.read_at(b - a, a).split(b"\t")
        return key, int(offset), int(length)

    def find(self, key: bytes) -> int:
        """The last block whose first key is not above ``key``, or -1."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.entry(mid)[0] <= key:
                low = mid + 1
            else:
                high = mid
        return low - 1


class CaptureIndex:
    """Lookups in an index; ``shards`` has a first key and a name for each shard, in order."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.fs, self.root = file_system(folder)
        self.firsts = [k.encode() for k, _ in shards]
        self.names = [s for _, s in shards]
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.shard = self.block = None

    def opened(self, name: str) -> pa.NativeFile:
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
        self.files.move_to_end(name)
        return self.files[name]

    def captures(self, key: str) -> list[tuple[str, int, int]]:
        """File, offset and length of every record with this key."""
        k = key.encode()
        i = bisect_right(self.firsts, k) - 1
        if i < 0:
            return []
        if self.shard != i:
            self.shard, self.block = i, None
            self.directory = Directory(self.fs, f"{self.root}/{self.names[i]}.dir")
        if self.block is None or not (self.keys[0] <= k and (self.next is None or k < self.next)):
            self.block = self.directory.find(k)
            _, offset, length = self.directory.entry(self.block)
            self.next = self.directory.entry(self.block + 1)[0] if self.block + 1 < self.directory.n else None
            self.lines = gzip.decompress(self.opened(f"{self.names[i]}.cdx.gz").read_at(length, offset)).split(b"\n")
            self.keys = [line.split(b"\t", 1)[0] for line in self.lines]
        found = []
        for line in self.lines[bisect_left(self.keys, k) : bisect_right(self.keys, k)]:
            _, file, offset, length = line.decode().split("\t")
            found.append((file, int(offset), int(length)))
        return found

    def records(self, key: str) -> Iterator[tuple[dict[str, str], bytes]]:
        for file, offset, length in self.captures(key):
            yield parse_record(self.opened(file).read_at(length, offset))


def reader(folder: str, shards: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, shards)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for key in batch.column(0).to_pylist():
                for fields, payload in index.records(key):
                    response = fields["WARC-Type"] == "response"
                    row = (
                        json.loads(fields["X-Page-Id"]),
                        fields["WARC-Target-URI"],
                        len(payload) if response else int(fields["X-Payload-Length"]),
                        hashlib.sha1(payload).hexdigest() if response else digest_of(fields),
                        fields["WARC-Type"],
                        None if response else int(fields["X-Refers-To-Page-Id"]),
                        payload if response else None,
                    )
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])

    return run


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())], names=["key"])


class Archive:
    """Archives of a table of pages, and the index over them.

    Every row becomes a record.  Of rows with equal payloads of ``MIN_REVISIT`` bytes or more, those with the largest page
    id are responses (one, unless that id repeats with the same payload) and the others revisit it.  A null html is an
    empty payload; a null url is indexed under the empty host; a null page id counts as least, and where a payload has no
    other its records are responses.  Other columns are ignored; an empty table makes an archive without shards.
    """

    def __init__(self, pages: DataFrame, *, folder: str | None = None, date: str = "2024-01-01T00:00:00Z"):
        """In ``folder``, which all executors share; else in the work folder, for as long as the application runs."""
        self.spark = pages.sparkSession
        self.folder = folder or fresh_path(self.spark, "warc")
        p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
        p = p.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
        with scope():
            self._written(p, date)

    def _written(self, p: DataFrame, date: str) -> None:
        size = F.octet_length(F.coalesce("html", F.lit("")))
        again = cut(p.where(size >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
        if again.count() <= BROADCAST_ROWS:
            rows = p.join(F.broadcast(again), "digest", "left")
        else:  # short payloads, of which many are alike, are no keys of the join
            rows = spread_join(p.where(size >= MIN_REVISIT), again, "digest", "n", again.agg(F.sum("n")).first()[0]).unionByName(p.where(size < MIN_REVISIT), allowMissingColumns=True)
        refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
        rows = rows.select("url", "page_id", "html", "digest", refers.alias("refers_to"))
        entries = cut(rows.mapInArrow(archiver(self.folder, date), "key string, file string, offset long, length long"), "captures")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lines = entries.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")
        shards = cut(lines.mapInArrow(index_writer(self.folder), "first_key string, shard string, n long"), "shards")
        #: one row a shard, of which there are as many as shuffle partitions
        self.shards = [(r["first_key"], r["shard"]) for r in sorted(shards.collect(), key=lambda r: r["first_key"].encode())]

    def lookup(self, captures: DataFrame) -> DataFrame:
        """The records of (url, page_id) rows, each once, as ``READ``; what has no record is left out.  Requests are
        sorted by key first, so that neighbours share a block."""
        keys = captures.select(captures["url"].cast("string"), captures["page_id"].cast("long")).mapInArrow(_keys, "key string").distinct()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(reader(self.folder, self.shards), READ)


def op7_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return Archive(pages).lookup(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to
FROM m
"""
