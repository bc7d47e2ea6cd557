"""Personal data: fixed patterns, and a character tagger for what they miss.

The tagger (a bidirectional LSTM with CRF transitions, trained here on labelled spans in generated text, once) reads overlapping
windows of the whole text.  Each of its kinds holds a digit or an ``@``, and a span without one is never accepted, so
windows without such a character cannot add anything and are not decoded: the result is the same as with them.  Where a
window's edge cuts a span, or a span is not accepted, and no neighbour's accepted span holds it, a wider window around it is
decoded, until it is whole.  Spans of
all windows of a text are reconciled together: of overlapping ones the set of greatest total confidence stays.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import pickle
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import spans as sp
from gleanery.llm import tagger as tg
from gleanery.llm.tables import column_at, schema_of
from gleanery.storage import exists, work_dir

BASE_KINDS = tg.KINDS
STRIDE = tg.WIDTH // 2
#: Kinds the tagger adds, by the tagger's kind.
ADDED = {k: f"tagged_{k}" for k in tg.KINDS}
KINDS = (*BASE_KINDS, *ADDED.values())
#: Mean marginal probability of a span's tags from which it is accepted.
CONFIDENCE = 0.8
BATCH = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./])[01]?[0-9]\1[0-3]?[0-9](?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, in time that grows with the text: an address is sought from its ``@``."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def acceptable(kind: str, text: str) -> bool:
    """What a tagged span must be whatever the tagger says: none is without a digit but an address with ``@``, and none begins
    with a date."""
    digits = "".join(c for c in text if c in "0123456789")
    if not digits and kind != "email" or _DATE.match(text):
        return False
    if kind == "email":
        return re.fullmatch(r"[\w.%+-]+\s?@\s?[\w-]+(?:\s?\.\s?[\w-]+)+", text) is not None
    if kind == "ip":
        return re.fullmatch(r"(?=(?:[^:]*:){3})[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}", text) is not None or (bool(re.fullmatch(r"\d+(?:\s?\.\s?\d+){3}", text)) and octets(re.sub(r"\s", "", text)))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"\d{4}(?:\s{0,2}[-. ]?\s{0,2}\d{2,7}){2,4}", text) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"(?:00\s?\d{1,3}[-. ])?\(?\d{1,5}\)?(?:[-. /]{1,2}\d{2,4}){2,5}", text) is not None


# --- labelled spans in generated text ------------------------------------------------------------------------------


class _Maker:
    """Text with personal data at known places, in more forms than the fixed patterns know: groups, parts and what stands
    between them are drawn, not listed."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n).tolist()))

    def word(self) -> str:
        w = "".join(self.pick(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ei", "sch", "ung", "lich", "ció", "ado", "é", "eau", "ment", "ñ", "ß", "ü", "la", "de", "x", "qu")) for _ in range(int(self.r.integers(1, 4))))
        case = self.r.random()
        return w.capitalize() if case < 0.12 else w.upper() if case < 0.2 else w

    def harmless(self) -> str:
        n = self.digits
        return self.pick(
            (
                lambda: n(4),
                lambda: n(int(self.r.integers(1, 12))),
                lambda: f"{n(4)}-0{n(1)}-1{n(1)}",
                lambda: f"1{n(1)}:{n(2)}:{n(2)}",
                lambda: f"{n(1)}.{n(1)}.{n(1)}",
                lambda: f"${n(1)},{n(3)}.{n(2)}",
                lambda: f'token = "{self.r.bytes(20).hex()}"',
                lambda: f"#{n(6)}",
                lambda: f"{n(2)}%",
                lambda: f"{n(2)}/{n(2)}/20{n(2)}",
                lambda: "@" + self.word(),
                lambda: f"{n(3)}-{n(2)}",
                lambda: f"1{n(3)}-1{n(3)}",
                lambda: f"{n(2)}.{n(2)}.20{n(2)}",
                lambda: f"{n(1)}.{n(3)}.{n(3)}",
                lambda: f"{n(1)} {n(3)} {n(3)}",
                lambda: f"{n(2)}, {n(2)}, {n(2)}",
                lambda: f"{n(2)}:{n(2)}",
            )
        )()

    def card(self) -> str:
        body = self.pick(("4", "5", "3", "6")) + self.digits(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def private(self) -> tuple[int, str]:
        kind = int(self.r.choice(4, p=(0.22, 0.2, 0.2, 0.38)))
        return kind, (self.address, self.host_number, self.card_number, self.phone)[kind]()

    def address(self) -> str:
        n, word = self.digits, lambda: self.word().lower()
        labels = ["-".join(word() for _ in range(int(self.r.integers(1, 3)))) for _ in range(int(self.r.integers(1, 4)))]
        name = word() + self.pick(("", "", "." + word(), n(2), "_" + word(), "+" + word()))
        return name + self.pick(("@", " @ ")) + ".".join([*labels, self.pick(("com", "org", "net", "de", "fr", "es", "io", "eu"))])

    def host_number(self) -> str:
        four = [str(x) for x in self.r.integers(0, 256, 4).tolist()]
        six = [f"{x:x}" for x in self.r.integers(0, 65536, 8).tolist()]
        keep = int(self.r.integers(2, 6))
        short = ":".join(six[:keep]) + "::" + ":".join(six[keep : keep + int(self.r.integers(1, 3))])
        return self.pick((".".join(four), " . ".join(four), ":".join(six), ":".join(x.zfill(4) for x in six), short))

    def card_number(self) -> str:
        c = self.card()
        return self.pick(("", " ", "-", ".", "  ")).join(c[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        n, sep = self.digits, self.pick(" -./")
        first = self.pick((lambda: "0" + n(int(self.r.integers(1, 4))), lambda: f"({n(int(self.r.integers(2, 5)))})", lambda: n(3), lambda: n(3), lambda: f"00{n(2)}{sep if sep != '/' else ' '}{n(int(self.r.integers(1, 4)))}", lambda: f"+{n(int(self.r.integers(1, 3)))} {n(3)}"))()
        rest = [n(3), n(4)] if self.r.random() < 0.3 else [n(int(self.r.integers(2, 5))) for _ in range(int(self.r.integers(2, 5)))]
        while sum(map(len, rest)) + sum(c.isdigit() for c in first) > 15:
            rest.pop()
        while sum(map(len, rest)) + sum(c.isdigit() for c in first) < 9:
            rest.append(n(2))
        return (first + " " if first[0] == "(" else first + sep) + sep.join(rest)

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        text, tags = "", []
        while len(text) < 2 * tg.WIDTH:
            roll = self.r.random()
            if roll < 0.13:
                kind, piece = self.private()
                tags += [2 * kind + 1] + [2 * kind + 2] * (len(piece) - 1)
            else:
                piece = self.harmless() if roll < 0.28 else self.word()
                tags += [0] * len(piece)
            gap = self.pick((" ", " ", " ", " ", ", ", ". ", "\n", " | "))
            text += piece + gap
            tags += [0] * len(gap)
        at = int(self.r.integers(len(text) - tg.WIDTH))
        cut_tags = np.array(tags[at : at + tg.WIDTH])
        if cut_tags[0] and cut_tags[0] % 2 == 0:  # a span that began before the window
            cut_tags[0] -= 1
        return tg.codes(np.frombuffer(text[at : at + tg.WIDTH].encode("utf-32-le"), np.uint32).astype(np.int64)), cut_tags


@functools.cache
def trained(windows: int = 12_000, steps: int = 1000, seed: int = 11) -> tg.Model:
    """The tagger, trained once a process; equal parameters give an equal model."""
    maker = _Maker(seed)
    x, y = zip(*(maker.window() for _ in range(windows)), strict=True)
    return tg.train(np.array(x), np.array(y), steps=steps)


def shared_model(spark: SparkSession):
    """The tagger as a broadcast.  It is trained once for the cluster: a file in the work folder, named by what it follows
    from, holds it for later applications."""
    made = hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in (tg, sys.modules[__name__]))).hexdigest()[:16]
    path = f"{work_dir(spark)}/models/tagger-{made}"
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.sparkContext.broadcast(pickle.loads(spark.read.parquet(path).first()["model"]))
    model = trained()
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.sparkContext.broadcast(model)


# --- decoding ------------------------------------------------------------------------------------------------------


def text_windows(points: np.ndarray) -> list[int]:
    """Starts of the windows that hold a digit or ``@``."""
    at = np.flatnonzero(((points >= 48) & (points < 58)) | (points == 64))
    if not len(at):
        return []
    last = max(0, -(-(len(points) - tg.WIDTH) // STRIDE))
    near = at // STRIDE
    return [int(i) * STRIDE for i in np.unique(np.concatenate([near, near - 1])) if 0 <= i <= last]


def decoded(model: tg.Model, windows: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, str, int, int, float, bool, bool]]:
    """(text, kind, start, end, confidence, cut at the window's start, cut at its end) for (text, start, points) windows."""
    trans = model.transitions()
    for b in range(0, len(windows), BATCH):
        part = windows[b : b + BATCH]
        x = np.zeros((max(len(points) for *_, points in part), len(part)), np.int64)
        for j, (_, _, points) in enumerate(part):
            x[: len(points), j] = tg.codes(points)
        e = tg.emissions(model, x)
        tags = tg.viterbi(e, trans)
        hit = np.flatnonzero(tags.any(axis=0))
        if not len(hit):
            continue
        p = tg.marginals(e[:, hit], trans)
        for n, j in enumerate(hit.tolist()):
            doc, start, points = part[j]
            t = tags[: len(points), j]
            i = 0
            while i < len(t):
                if not t[i]:
                    i += 1
                    continue
                k = (int(t[i]) - 1) // 2
                stop = i + 1
                while stop < len(t) and t[stop] == 2 * k + 2:
                    stop += 1
                yield doc, tg.KINDS[k], start + i, start + stop, float(np.mean([p[q, n, t[q]] for q in range(i, stop)])), i == 0 and start > 0, stop == len(t)
                i = stop


def reconciled(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of a text's spans, those without overlap whose confidence times length is greatest in all; ties to the earlier."""
    best: dict[tuple[str, int, int], float] = {}
    for kind, a, b, p in found:
        best[kind, a, b] = max(p, best.get((kind, a, b), 0.0))
    order = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    total, back = [0.0], []
    for i, s in enumerate(order):
        j = int(np.searchsorted(ends[:i], s[1], "right"))
        with_it = total[j] + best[s] * (s[2] - s[1])
        take = with_it > total[i]
        total.append(with_it if take else total[i])
        back.append(j if take else -1)
    out, i = [], len(order)
    while i:
        if back[i - 1] >= 0:
            out.append(order[i - 1])
            i = back[i - 1]
        else:
            i -= 1
    return out[::-1]


def hopeless(kind: str, piece: str) -> bool:
    """No span that holds this piece is acceptable as this kind."""
    return kind in ("card", "phone") and sum(c in "0123456789" for c in piece) > 19 or kind == "ip" and ":" in piece and len(piece) > 39


def widened(model: tg.Model, texts: list[str], cuts: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, str, int, int, float]]:
    """Whole spans (text, kind, start, end, confidence) that overlap pieces cut by windows: pieces that touch are one, and
    the window around them doubles its margin while its own edges cut what lies there."""
    todo = [(doc, a, b, tg.WIDTH) for doc, pieces in cuts.items() for a, b in merged(pieces)]
    while todo:
        todo.sort(key=lambda t: t[2] - t[1] + 2 * t[3])
        again: dict[int, list[tuple[int, int]]] = {}
        margins: dict[int, int] = {}
        while todo:
            n = max(1, BATCH * tg.WIDTH // (todo[0][2] - todo[0][1] + 2 * todo[0][3]))
            part, todo = todo[:n], todo[n:]
            windows = []
            for i, (doc, a, b, margin) in enumerate(part):
                low = max(0, a - margin)
                points = np.frombuffer(texts[doc][low : b + margin].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                windows.append((i, low, points))
            for i, kind, x, y, p, left, right in decoded(model, windows):
                doc, a, b, margin = part[i]
                if x >= b or a >= y:
                    continue
                if not (left or (right and y < len(texts[doc]))):
                    yield doc, kind, x, y, p
                elif not hopeless(kind, texts[doc][x:y]):
                    again.setdefault(doc, []).append((min(a, x), max(b, y)))
                    margins[doc] = max(2 * margin, margins.get(doc, 0))
        todo = [(doc, a, b, margins[doc]) for doc, pieces in again.items() for a, b in merged(pieces)]


def merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_private(texts: list[str], model: tg.Model) -> list[list[tuple[str, int, int]]]:
    """Base spans of every text, and tagged ones that overlap none of them."""
    out = [base_spans(t) if t else [] for t in texts]
    windows, found, cuts = [], {}, {}

    def keep(doc, kind, a, b, p):
        if p >= CONFIDENCE and acceptable(kind, texts[doc][a:b]):
            found.setdefault(doc, []).append((kind, a, b, p))
            return True
        return False

    def drain():
        for doc, kind, a, b, p, cut_left, cut_right in decoded(model, windows):
            inside = not (cut_left or (cut_right and b < len(texts[doc])))
            if not (inside and keep(doc, kind, a, b, p)):  # what looks like a whole one may be a piece, too
                cuts.setdefault(doc, []).append((a, b))
        windows.clear()

    for d, text in enumerate(texts):
        if text and ("@" in text or _DIGIT.search(text)):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            for s in text_windows(points):
                windows.append((d, s, points[s : s + tg.WIDTH]))
                if len(windows) >= 8 * BATCH:
                    drain()
    drain()
    open_ = {}
    for d, pieces in cuts.items():
        whole = merged([(a, b) for _, a, b, _ in found.get(d, ())] + [(a, b) for _, a, b in out[d]])
        starts = [a for a, _ in whole]
        open_[d] = [(a, b) for a, b in pieces if not (i := bisect.bisect_right(starts, a)) or whole[i - 1][1] < b]
    for span in widened(model, texts, open_):
        keep(*span)
    for d, spans in found.items():
        taken = merged([(a, b) for _, a, b in out[d]])
        ends = [y for _, y in taken]
        free = lambda a, b: (i := bisect.bisect_right(ends, a)) == len(taken) or taken[i][0] >= b  # noqa: B023, E731
        out[d] += [(ADDED[k], a, b) for k, a, b in reconciled(spans) if free(a, b)]
    return out


def scanner(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = find_private(texts, model.value)
            clean = [None if t is None else sp.replaced(t, s, lambda k: f"[{k.removeprefix('tagged_').upper()}]") if s else t for t, s in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.arranged(s, KINDS) for s in found], sp.SPANS_ARROW), pa.array(clean, pa.string())], names=["row", "spans", "redacted"])

    return run


def scan_private(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``carry``, ``spans`` and ``redacted`` (the text with every span replaced by its kind in
    brackets) of every row.

    A null text has no spans and stays null; an empty one stays empty; repeated rows come back as often as they came in;
    ids, null ones too, are passed on; other columns are ignored.  No shuffle: each row stands alone.
    """
    model = shared_model(docs.sparkSession)
    row = F.struct(docs[id_col].alias(id_col), *(docs[c].alias(c) for c in carry))
    narrow = docs.select(row.alias("row"), docs[text_col].cast("string").alias("text"))
    found = narrow.mapInArrow(scanner(model), f"row {narrow.schema['row'].dataType.simpleString()}, spans {sp.SPANS}, redacted string")
    return found.select("row.*", "spans", "redacted")


def redactor(model, text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            clean = [sp.replaced(t, s, lambda k: f"[{k.removeprefix('tagged_').upper()}]") if s else t for t, s in zip(texts, find_private(texts, model.value), strict=True)]
            cols = list(batch.columns)
            cols[text_at] = pa.array(clean, pa.string()).cast(cols[text_at].type)
            if chars_at is not None:
                cols[chars_at] = pa.array([None if t is None else len(t) for t in clean], pa.int64()).cast(cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def redacted(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; ``chars_col``, if there, is counted
    anew.  Other columns of whatever name, nulls, empty texts, repeated rows and the number of rows stay as they are; an
    empty table stays empty."""
    model = shared_model(docs.sparkSession)
    at = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return docs.mapInArrow(redactor(model, column_at(docs, text_col), at), schema_of(docs))


def op4_private_data(spark, sf_dir: str) -> DataFrame:
    found, s = scan_private(spark.read.parquet(f"{sf_dir}/documents.parquet")), F.col("spans")
    return found.select("doc_id", *(sp.count_of(s, k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(sp.written(sp.of_kinds(s, BASE_KINDS)), 256).alias("base_sha256"), sp.written(s).alias("spans"))
