"""Byte-level text primitives shared by the corpus operators.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  ``bytes.split()`` and ``bytes.lower()``
follow exactly this ASCII notion, whatever the text holds; no Unicode table is involved.  Hashes are the same in every
process, so that tasks on different executors agree on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Texts are hashed together up to this many bytes, so that a task's memory does not depend on the size of its batches.
SLICE_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


class _Powers:
    """Powers of the hash base and of its inverse, made once a process and made longer on demand."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE_BYTES + 1)
            cls.up, cls.down = _powers(_P, n), _powers(_P_INV, n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(data, np.uint8)]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over the bytes: no Python object for a word is made."""
    up, down = _Powers.of(len(data) + 1)
    terms = np.zeros(len(data) + 1, np.uint64)
    np.multiply(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), up[: len(data)], out=terms[1:])
    sums = np.cumsum(terms, out=terms)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += h[i : i + n]
    return mix(out + np.uint64(k))


def doc_slices(texts: Iterable[bytes | None]) -> Iterator[tuple[list[bytes], bytes, np.ndarray]]:
    """Texts in groups of about ``SLICE_BYTES``: the texts, the same joined by newlines, and where each begins.

    A single longer text makes a slice of its own, whole.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if held and size + len(text) > SLICE_BYTES:
            yield held, *_joined(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held, *_joined(held)


def _joined(held: list[bytes]) -> tuple[bytes, np.ndarray]:
    at = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in held], out=at[1:])
    return b"\n".join(held), at


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hashed_docs(texts: Iterable[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text in order: the text, its words' first bytes, last-plus-one bytes and hashes."""
    for held, data, at in doc_slices(texts):
        start, end = words(data)
        h = word_hashes(data, start, end)
        cut = np.searchsorted(start, at)
        for i, text in enumerate(held):
            a, b = cut[i], cut[i + 1]
            yield text, start[a:b] - at[i], end[a:b] - at[i], h[a:b]


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word shingles; with fewer words the whole sequence is one."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(h, min(k, len(h))))
