"""Checksums in SQL expressions and hashed embeddings, computed inside each row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from .numeric import DIM


def row_hash(raw_json: Column) -> Column:
    return F.sha2(raw_json, 256)


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex, from SHA-256 over padded keys."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in raw).hex())) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


AUDIT_FIELDS = (("tenantId", "tenant_id"), ("actorId", "actor_id"), ("actorEmail", "actor_email"), ("actorRole", "actor_role"), ("action", "action"),
                ("resourceType", "resource_type"), ("resourceId", "resource_id"), ("details", "details"), ("status", "status"), ("timestamp", "timestamp"))


def audit_payload() -> Column:
    """The signed JSON text: ten fields in fixed order; ``details`` is JSON already and stands as it is."""
    parts = []
    for name, column in AUDIT_FIELDS:
        if column == "details":
            parts.append(F.concat(F.lit('"details":'), F.coalesce(F.col(column), F.lit("null"))))
        else:
            one = F.to_json(F.struct(F.coalesce(F.col(column), F.lit("")).alias(name)))
            parts.append(F.substr(one, F.lit(2), F.length(one) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def audit_checksum(key: str) -> Column:
    return hmac_sha256(audit_payload(), key)


def execution_checksum(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def bucket(term: Column, dim: int = DIM) -> Column:
    """The first two bytes of the term's MD5, modulo the dimension."""
    return (F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int") % dim).cast("int")


def word_terms(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t != "")


_TO_BLANKS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_DIGITS = np.array([_TO_BLANKS[c] - (97 if c > 57 else 22) if _TO_BLANKS[c] != 32 else 36 for c in range(256)], np.int32)  # a-z, 0-9, and 36 for blanks
_KNOWN_WORDS, _KNOWN_BYTES = 1 << 18, 32  # words whose buckets a task keeps, and their greatest length
_PIECE = 1 << 20


class _Places(dict):
    """The bucket of each word, hashed where it is met first."""

    def __init__(self, dim: int):
        self.dim = dim

    def place(self, term: bytes) -> int:
        a, b = hashlib.md5(term).digest()[:2]
        return (a << 8 | b) % self.dim

    def __missing__(self, word: bytes) -> int:
        at = self.place(word)
        if len(word) <= _KNOWN_BYTES and len(self) < _KNOWN_WORDS:
            self[word] = at
        return at


def _pieces(texts: Iterator[bytes], most: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts and their rows by about ``most`` bytes; a longer text is cut at blanks."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        first = 0
        while first < len(text):
            stop = text.find(b" ", first + most) if len(text) - first > most else -1
            stop = len(text) if stop < 0 else stop
            held.append(text[first:stop])
            rows.append(row)
            size += stop - first
            first = stop
            if size >= most:
                yield held, rows
                held, rows, size = [], [], 0
    if held:
        yield held, rows


def _embeddings(parts: Iterator[pa.Array], dim: int, piece: int = _PIECE) -> Iterator[pa.Array]:
    words = _Places(dim)
    grams = np.full(36**4, -1, np.int32)  # the bucket of each 4-gram of letters and digits, -1 where none was met

    def add(dense: np.ndarray, texts: list[bytes], rows: list[int]) -> None:
        joined = b" ".join(texts) + b" "
        c = _DIGITS[np.frombuffer(joined, np.uint8)]
        low = rows[0]
        row = np.repeat(np.array(rows) - low, [len(t) + 1 for t in texts])
        n = rows[-1] - low + 1
        blank = c == 36
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        at = np.fromiter(map(words.__getitem__, joined.split()), np.int64, len(starts))
        dense[low : low + n] += 4 * np.bincount(row[starts] * dim + at, minlength=n * dim).reshape(n, dim)
        if len(c) < 4:
            return
        whole = np.flatnonzero(~(blank[:-3] | blank[1:-2] | blank[2:-1] | blank[3:]))
        code = (((c[:-3] * 36 + c[1:-2]) * 36 + c[2:-1]) * 36 + c[3:])[whole]
        at = grams[code]
        if len(at) and at.min() < 0:
            new = np.flatnonzero(at < 0)
            for gram, k in zip(*np.unique(code[new], return_index=True)):
                i = whole[new[k]]
                grams[gram] = words.place(joined[i : i + 4])
            at = grams[code]
        dense[low : low + n] += np.bincount(row[whole] * dim + at, minlength=n * dim).reshape(n, dim)

    for part in parts:
        dense = np.zeros((len(part), dim))
        texts = ((t or b"").translate(_TO_BLANKS) for i in range(0, len(part), 512) for t in part[i : i + 512].to_pylist())
        for some, rows in _pieces(texts, piece):
            add(dense, some, rows)
        dense *= 0.5  # sums of halves are exact in any order
        norm = np.sqrt((dense * dense).sum(axis=1))
        dense /= np.where(norm > 0, norm, 1.0)[:, None]
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(dense.reshape(-1)))


def with_embedding(df: DataFrame, key: list[str], text: str = "text", name: str = "embedding", dim: int = DIM) -> DataFrame:
    """Add a unit vector per row: each word adds 2.0 to its bucket, each 4-gram of a word 0.5; no words, zeros.

    A row's vector depends on its text alone, so no row moves; ``key`` is not used.  A task
    keeps the buckets of the words that it met first, so these are hashed once.
    """
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _embeddings(parts, dim)

    return df.withColumn(name, F.arrow_udf(run, "array<double>", ArrowUDFType.SCALAR_ITER)(F.lower(F.col(text)).cast("binary")))
