"""Vectorised byte-level text helpers for Arrow batches (numpy, inside tasks).

Texts of a batch are handled in chunks of bounded bytes, whole documents at a
time, so that memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, last_row, bytes, offsets)``; null texts are empty.

    A chunk holds whole documents and about ``limit`` bytes, or one longer document.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off_buf, data = column.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n + 1 of each."""
    if not _powers or len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("i", _INV)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["i"]


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """``s`` with which ``span_hash`` hashes any span of ``buf``."""
    p, _ = powers(len(buf))
    s = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[buf] * p[: len(buf)], out=s[1:], dtype=np.uint64)
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes give equal hashes."""
    _, inv = powers(len(s))
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words in a chunk; no word crosses documents."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~space[buf]
    first = np.ones(len(buf) + 1, dtype=bool)
    first[1:-1] = ~word[:-1]
    first[off[off < len(buf)]] = True
    start = np.flatnonzero(word & first[:-1])
    last = np.ones(len(buf), dtype=bool)
    last[:-1] = ~word[1:]
    inner = off[(off > 0) & (off <= len(buf))]
    last[inner - 1] = True
    end = np.flatnonzero(word & last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


_WEIGHTS = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every k-word shingle.

    A document with fewer than k words, but one at least, has its whole
    sequence as the one shingle.
    """
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = len(words)
    out_h, out_d = [], []
    if n >= k:
        ok = doc[: n - k + 1] == doc[k - 1 :]
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            h += words[i : n - k + 1 + i] * _WEIGHTS[i]
        out_h.append(mix(h[ok]))
        out_d.append(doc[: n - k + 1][ok])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = np.full(len(short), 1, dtype=np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            h[has] += words[firsts[short[has]] + i] * _WEIGHTS[i]
        out_h.append(mix(h + counts[short].astype(np.uint64)))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def distinct_shingles(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document, A-Z lower-cased: hashes and documents, sorted by (document, hash)."""
    low = LOWER[buf]
    start, end, doc = word_spans(low, off)
    words = span_hash(prefix_sums(low), start, end)
    h, d = shingle_hashes(words, doc, len(off) - 1, k)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
    return h, d


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of vertices 0 .. n - 1 with edges a - b, the least vertex that each can reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new
