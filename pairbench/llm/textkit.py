"""Vectorised word and shingle arrays over Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch at once: no Python object is made per word.
Words are runs of bytes outside space and 0x09-0x0D, with A-Z lower-cased. A null text is an empty
text, and an empty text has no words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWER_CACHE: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    t = _POWER_CACHE.get(name)
    if t is None or len(t) < n:
        t = _powers(base, max(n, CHUNK_BYTES + 1))
        if n <= CHUNK_BYTES + 1:
            _POWER_CACHE[name] = t
    return t[:n]


def tidy(run):
    """run, an iterator function for mapInArrow, that gives freed memory back when a task ends:
    workers are reused, and what they hold adds up."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


@dataclass
class Words:
    """Words of a chunk of documents, in order. `offset` has n_docs + 1 positions into the words."""

    raw: np.ndarray  # bytes as given
    low: np.ndarray  # bytes with A-Z lower-cased
    doc_at: np.ndarray  # n_docs + 1 byte positions
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc_at) - 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.offset)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its n + 1 byte positions; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], (at - at[0]) if len(at) else np.zeros(1, np.int64)


def words(texts: pa.Array) -> Words:
    return words_of(*flat(texts))


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    """The words of documents whose bytes stand end to end in raw, from at[i] to at[i + 1]."""
    n = len(raw)
    low = _LOWER[raw]
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, low, at, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    gap = _SPACE[raw]
    fresh = np.zeros(n + 1, dtype=bool)  # a document begins here
    fresh[at] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | fresh[1:n]
    ends = ~gap
    ends[:-1] &= gap[1:] | fresh[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _table("p", _BASE, n), out=total[1:])
    h = mix((total[end] - total[start]) * _table("i", _INVERSE, n)[start])
    return Words(raw, low, at, start, end, h, np.searchsorted(start, at))


def chunks(batch: pa.RecordBatch | pa.Table, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows with about `most` bytes of text; a longer text stands alone."""
    _, at = flat(batch.column(text))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and n_docs + 1 positions into them. A document with
    fewer than k words has its whole sequence as one; without words, none."""
    n = w.count
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(w.n_docs + 1, np.int64)
    power = _powers(_SHINGLE, k)
    full = np.maximum(n - k + 1, 0)
    m = len(w.hash) - k + 1
    roll = np.zeros(max(m, 0), dtype=np.uint64)
    for j in range(k if m > 0 else 0):
        roll += w.hash[j : j + m] * power[j]
    short = (n > 0) & (n < k)
    size = full + short
    offset = np.zeros(w.n_docs + 1, np.int64)
    np.cumsum(size, out=offset[1:])
    out = np.empty(offset[-1], dtype=np.uint64)
    pos = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    out[np.repeat(offset[:-1], full) + pos] = roll[np.repeat(w.offset[:-1], full) + pos]
    for d in np.flatnonzero(short):
        own = w.hash[w.offset[d] : w.offset[d + 1]]
        parts = np.append(own * power[: len(own)], np.uint64(len(own) * 0xA24BAED4963EE407 & (1 << 64) - 1))
        out[offset[d]] = parts.sum(dtype=np.uint64)
    return mix(out), offset


def pick(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def select_rows(df, text: str, keep):
    """df's rows for which keep(Arrow string column) holds, with all its columns. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield part.filter(pa.array(keep(part.column(text)), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
