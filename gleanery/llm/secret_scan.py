"""Secret scanning: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

A candidate is a maximal run of one character class.  A window slides over it; its entropy is kept from counts that
change by one character in and one out, so a run costs time in proportion to its length.  Windows at or above the class's
threshold are merged into spans, and spans that an allow-list pattern explains (UUIDs, alphabets, example keys, ...) are
suppressed.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import spans as sp
from gleanery.llm import textkit as tk

BASE_KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``alphabet`` of at least ``window`` characters are candidates; a window counts when its entropy reaches
    ``bits`` and it holds a character of each set in ``needs``."""

    kind: str
    alphabet: str
    bits: float
    needs: tuple[str, ...]
    window: int = 20
    run: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "run", re.compile(f"[{self.alphabet}]+"))


_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", "0-9a-fA-F", 3.0, (_DIGIT, "abcdefABCDEF")),
    CharClass("entropy_alnum", "0-9A-Za-z", 3.6, (_DIGIT, _LOWER + _UPPER)),
    CharClass("entropy_base64", "0-9A-Za-z+/_=-", 3.8, (_DIGIT, _LOWER, _UPPER)),
)
KINDS = (*BASE_KINDS, *(c.kind for c in CLASSES))

#: A flagged span is dropped when one of these matches its own word: up to 200 characters before it and 12 after it.
ALLOW = (
    r".*[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}.*",
    r".*EXAMPLE.*",
    r".*(?:0123456789|abcdefghij|ABCDEFGHIJ).*",
)
#: Or one of these what stands before its end: its own word, as above, and 12 characters before that word.
ALLOW_BEFORE = (
    r".*(?:sha(?:1|256|384|512)[-:=]|commit |integrity=)\S*",
    r".*(?:https?|ftp)://\S*",
)


def hot_windows(run: str, cls: CharClass) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` that reach the class's entropy."""
    w = cls.window
    if len(run) < w:
        return []
    xlogx = [0.0] + [n * math.log2(n) for n in range(1, w + 2)]  # a character goes in before one goes out
    need_of = {c: i for i, s in enumerate(cls.needs) for c in s}
    counts: dict[str, int] = {}
    has = [0] * len(cls.needs)
    total = 0.0  # sum of n * log2(n): entropy = log2(w) - total / w
    out: list[tuple[int, int]] = []
    most = (math.log2(w) - cls.bits) * w + 1e-9
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlogx[n + 1] - xlogx[n]
        if c in need_of:
            has[need_of[c]] += 1
        if i >= w:
            old = run[i - w]
            n = counts[old]
            counts[old] = n - 1
            total += xlogx[n - 1] - xlogx[n]
            if old in need_of:
                has[need_of[old]] -= 1
        if i >= w - 1 and total <= most and all(has):
            a = i - w + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def _long_words(text: str, least: int) -> Iterator[tuple[int, str]]:
    """Every word of at least ``least`` bytes with its code point offset; shorter ones hold no candidate."""
    data = text.encode()
    start, end = tk.words(data)
    big = np.flatnonzero(end - start >= least)
    if not len(big):
        return
    if len(data) == len(text):
        points = None
    else:
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    for i in big.tolist():
        a, b = int(start[i]), int(end[i])
        yield (a if points is None else int(points[a]) - 1), data[a:b].decode()


def find_secrets(text: str, classes: Sequence[CharClass] = CLASSES, allow: Sequence[re.Pattern] = tuple(map(re.compile, ALLOW)), before: Sequence[re.Pattern] = tuple(map(re.compile, ALLOW_BEFORE))) -> list[tuple[str, int, int]]:
    """Spans of ``text``.  All base spans stay; entropy spans are added where neither a base span nor an earlier class's
    span holds them, and no allow-list pattern does."""
    base: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    more: dict[str, list[tuple[int, int, int, int]]] = {cls.kind: [] for cls in classes}
    for at, word in _long_words(text, 20):
        if "AKIA" in word:
            base += [("access", at + m.start(), at + m.end()) for m in _ACCESS.finditer(word) if m.end() - m.start() >= 20]
        base += [("hex", at + m.start(), at + m.end()) for m in _HEX.finditer(word) if m.end() - m.start() >= 24]
        for cls in classes:
            for m in cls.run.finditer(word):
                if m.end() - m.start() >= cls.window:
                    more[cls.kind] += [(at + m.start() + a, at + m.start() + b, at, at + len(word)) for a, b in hot_windows(m[0], cls)]
    for kind, found in more.items():
        if found:
            held = within([(a, b) for _, a, b in base])
            base += [(kind, a, b) for a, b, word_at, word_end in found if not held(a, b) and not allowed(text, a, b, word_at, word_end, allow, before)]
    return base


def allowed(text: str, a: int, b: int, word_at: int, word_end: int, allow: Sequence[re.Pattern], before: Sequence[re.Pattern]) -> bool:
    own = text[max(word_at, a - 200) : min(word_end, b + 12)]
    ahead = text[max(0, word_at - 12, a - 200) : b].replace("\n", " ")
    return any(p.fullmatch(own) for p in allow) or any(p.fullmatch(ahead) for p in before)


def within(spans: list[tuple[int, int]]):
    """Whether one of ``spans`` holds a range: of those that begin no later, the one that ends last does, or none."""
    spans = sorted(spans)
    starts, reach = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))
    return lambda a, b: (i := bisect.bisect_right(starts, a)) > 0 and reach[i - 1] >= b


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1).to_pylist()
        found = [sp.arranged(find_secrets(t), KINDS) if t else [] for t in text]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, sp.SPANS_ARROW)], names=["id", "spans"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` of every row, by :func:`find_secrets` on the whole text.

    Null and empty texts have no spans; repeated rows come back as often as they came in; ids, null ones too, are passed
    on; other columns are ignored.  No shuffle: each row stands alone.
    """
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_scan, f"id {kind}, spans {sp.SPANS}").withColumnRenamed("id", id_col)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, s = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), F.col("spans")
    return found.select("doc_id", *(sp.count_of(s, k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(sp.written(sp.of_kinds(s, BASE_KINDS)), 256).alias("base_sha256"), sp.written(s).alias("spans"))
