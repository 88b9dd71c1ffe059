"""Exact removal of repeated 100-byte passages by a distributed suffix merge sort.

A byte is removed if a ``LENGTH``-byte string covers it that also starts earlier
(in a smaller doc_id, or earlier in the same document); strings never cross
documents and are judged on the input.  Every text is taken as UTF-8 bytes.

1. *Anchors.*  Each 100-byte window has as its anchor the position of the least
   hash among its 32-byte grams.  Equal windows have their anchors at the same
   place, and a run of windows shares one anchor, so about 3 in 100 positions
   are anchors.  An anchor's context is the text that its windows span.
2. *Thinning.*  Anchors are exchanged as packed arrays of gram and context hashes.
   A context whose gram occurs nowhere else holds no repeated window and goes; the
   others get their kind of suffix: contexts that seem to occur again are compared
   from their start (``WHOLE``), and of those that look alike the first is also
   compared with the other contexts of its gram: from the anchor on, with the text
   to the left as payload (``BORDER``), or, if the gram has more than ``HOT``
   contexts, window by window (``WINDOWS``).  Hashes decide nothing else.
3. *Runs.*  Each task sorts its suffixes, keeps one of equal ones (the later ones
   are repeats), front-codes them by the prefix common with the one before and cuts
   the run at splitters, a sorted sample of the suffixes, so that range after range
   holds ever greater suffixes.  Border suffixes are dealt by their gram, all
   others by all their bytes, so equal suffixes meet and no receiver gets a hot
   gram whole.
4. *Merge.*  A range's runs are merged by a loser tree that keeps the common prefix
   with the last winner and never compares known prefixes again.  Neighbours whose
   common prefix is their whole length are equal, and the first occurrence stays.
   For two border suffixes the common prefix R is the least of those of the
   neighbours between them; with L bytes common to the left, the windows from
   L to 100 - R bytes before the later anchor are repeats.

A task holds one range at a time, of about ``RANGE`` suffixes; the number of ranges
grows with the table (up to ``MAX_RANGES``, the bound of what is broadcast).

Defined cases: null and empty texts have no bytes and keep none; a row with a
null doc_id is returned unchanged and removes nothing; rows with equal doc_id and
text count as one document; rows with equal doc_id and other texts are documents of
their own, in the order of ``xxhash64(text)`` (from the 32,769th text of one doc_id
on they are returned unchanged); very long texts are processed whole; an empty
table gives no rows; other columns are ignored.  Text is removed only where bytes
were found equal; a collision of two 128-bit hashes could at most keep a repeat.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table
from .textops import chunks, mix, powers, prefix_sums, span_hash

LENGTH = 100
GRAM = 32
HOT = 64
FLUSH_ANCHORS = 400_000
FLUSH_SUFFIXES = 250_000
RANGE = 100_000
MAX_RANGES = 1 << 17
MAX_TASKS = 20_000
PIECE_BYTES = 8 << 20
MAX_TEXTS = 1 << 15
REPEAT, WHOLE, BORDER, WINDOWS = 0, 1, 2, 4
COPY, CROWDED, COPIED = 1, 2, 4


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``doc, lo, at, n, gram_hash, context_hash`` of the anchors in a chunk.

    Windows lo .. lo + n - 1 (offsets in the document) have the gram at lo + at
    as their anchor.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    starts = len(buf) - length + 1
    if starts <= 0:
        return empty
    s = prefix_sums(buf)
    _, inv = powers(len(buf) + 1)
    h = (s[gram:] - s[: len(s) - gram]) * inv[: len(s) - gram]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    bits = max(20, len(buf).bit_length())
    code = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    w, width = length - gram + 1, 1
    least = code
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)[:starts]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = doc[:starts] == doc[length - 1 :]
    place = np.flatnonzero(ok)
    if not len(place):
        return empty
    anchor, d = anchor[place], doc[place]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    lo, a = place[first], anchor[first]
    at = a - lo
    context = span_hash(s, lo, lo + n - 1 + length) ^ mix(at.astype(np.uint64) + np.uint64(77))
    return d[first], lo - off[d[first]], at, n, span_hash(s, a, a + gram), context


def _code(place, at, n, kind):
    """One number for windows place .. place + n - 1 of a document, whose anchor is at place + at."""
    return (place << 17) | (at << 10) | (n << 3) | kind


def _decode(code: np.ndarray):
    """``lo, at, n, kind``; ``lo`` without the number of the text."""
    return (code >> 17) & 0x7FFFFFFF, (code >> 10) & 127, (code >> 3) & 127, code & 7


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _packed(receiver: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(receiver, kind="stable")
    used, cut = np.unique(receiver[order], return_index=True)
    columns = [c[order] for c in columns]
    blobs = [pickle.dumps([c[a:b] for c in columns], 5) for a, b in zip(cut, [*cut[1:], len(receiver)])]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _send_anchors(parts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            doc, place, at, n, gram, context = (np.concatenate([h[i] for h in held]) for i in range(6))
            order = np.lexsort((place, doc, context, gram))
            doc, place, at, n, gram, context = (x[order] for x in (doc, place, at, n, gram, context))
            first = _runs(gram, context)
            starts = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            copy = ~first & _runs(doc, place, gram, context)
            keep = first | copy
            # contexts per gram, and each first context's number among them
            gram_new = _runs(gram[starts])
            group = np.cumsum(gram_new) - 1
            number = np.arange(len(starts)) - np.flatnonzero(gram_new)[group]
            is_hot = np.bincount(group)[group] > hot
            by_context = np.zeros(len(doc), bool)
            by_context[starts] = is_hot & (number >= 2)
            flag = np.zeros(len(doc), np.uint8)
            flag[starts] = CROWDED * is_hot + COPIED * (np.bincount(of, copy) > 0)
            flag[copy] = COPY
            key = np.where(copy, mix(doc.astype(np.uint64)), np.where(by_context, context, gram))
            receiver = (mix(key) % np.uint64(parts)).astype(np.int32)
            out = [gram, context, doc, place.astype(np.uint32 if place.max() < 1 << 32 else np.int64), at.astype(np.uint8), n.astype(np.uint8), flag]
            held.clear()
            return _packed(receiver[keep], [c[keep] for c in out])

        count = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            versions = batch.column(2).to_numpy(zero_copy_only=False)
            for i, _, buf, off in chunks(batch.column(1)):
                doc, lo, *rest = anchors(buf, off)
                if len(doc):
                    held.append((ids[i + doc], (versions[i + doc] << 31) | lo, *rest))
                    count += len(doc)
                if count >= FLUSH_ANCHORS:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


def _choose_kinds(hot: int):
    """``doc_id, code`` of each anchor whose gram occurs elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, b) for batch in batches for p, b in zip(batch.column(0).to_pylist(), batch.column(1)))
        for _, piece in groupby(rows, itemgetter(0)):  # one piece in memory at a time
            yield from choose([pickle.loads(b.as_py()) for _, b in piece])

    def choose(got: list) -> Iterator[pa.RecordBatch]:
        gram, context, doc, place, at, n, flag = (np.concatenate([g[i] for g in got]) for i in range(7))
        del got
        place, at, n = (x.astype(np.int64) for x in (place, at, n))
        old = flag == COPY
        out_doc, out_code = [doc[old]], [_code(place[old], at[old], n[old], WHOLE)]
        gram, context, doc, place, at, n, flag = (x[~old] for x in (gram, context, doc, place, at, n, flag))
        if len(doc):
            order = np.lexsort((place, doc, context, gram))
            gram, context, doc, place, at, n, flag = (x[order] for x in (gram, context, doc, place, at, n, flag))
            first = _runs(gram, context)
            starts = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            other = ~first & _runs(doc, place, gram, context)
            copied = (np.bincount(of, other) > 0) | (np.bincount(of, (flag & COPIED) > 0) > 0)
            group = np.cumsum(_runs(gram[starts])) - 1
            crowded = np.bincount(group, np.maximum.reduceat(flag & CROWDED, starts)) > 0
            contexts = np.bincount(group)
            many = crowded | (contexts > hot)
            kind = np.zeros(len(doc), np.int64)
            kind[other] = WHOLE
            kind[starts] = WHOLE * copied + np.where(many[group], WINDOWS, BORDER * (contexts > 1)[group])
            kept = kind > 0
            out_doc.append(doc[kept])
            out_code.append(_code(place[kept], at[kept], n[kept], kind[kept]))
        docs, codes = np.concatenate(out_doc), np.concatenate(out_code)
        for i in range(0, len(docs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 50_000]), pa.array(codes[i : i + 50_000])], names=["doc_id", "code"])

    return run


def common_prefixes(sorted_strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string has in common with the one before it."""
    n = len(sorted_strings)
    sizes = np.fromiter(map(len, sorted_strings), np.int64, n)
    width = int(sizes.max())
    grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sorted_strings), np.uint8).reshape(n, width)
    out = np.zeros(n, np.int64)
    differ = grid[1:] != grid[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def front_code(items: list[tuple]) -> bytes:
    """A sorted run of ``(suffix, doc, place, n, left)`` (a border suffix has n = 0), suffixes without the prefix common with the one before."""
    lcp = common_prefixes([x[0] for x in items])
    return pickle.dumps((
        lcp.astype(np.uint8), [x[0][k:] for x, k in zip(items, lcp.tolist())],
        np.array([x[1] for x in items]), np.array([x[2] for x in items]), np.array([x[3] for x in items], np.uint8), [x[4] for x in items]), 5)


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """``(suffix, lcp with the one before, (doc, place, n, left))`` of a front-coded run."""
    lcp, tails, doc, place, n, left = pickle.loads(blob)
    last = b""
    for k, tail, *rest in zip(lcp.tolist(), tails, doc.tolist(), place.tolist(), n.tolist(), left):
        last = last[:k] + tail
        yield last, k, rest


def _extend(a: bytes, b: bytes, known: int) -> int:
    """The common prefix of a and b, of which ``known`` bytes are known to be equal."""
    most = min(len(a), len(b))
    step = known
    while step < most and a[step : step + 16] == b[step : step + 16]:
        step += 16
    if step >= most:
        return most
    while step < most and a[step] == b[step]:
        step += 1
    return step


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[bytes, int, tuple]]:
    """Merge sorted runs with a loser tree over common prefixes.

    Each waiting suffix carries its common prefix with the last winner.  Of two,
    the one with more in common is smaller; only if both have the same are bytes
    compared, from there on, and the loser keeps the result.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    tails = list(runs) + [iter(())] * (k - len(runs))
    shared = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of the suffixes at i and j; the loser's common prefix is set."""
        a, b = heads[i], heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        x, y = shared[i], shared[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        p, q = a[0], b[0]
        z = _extend(p, q, x)
        if z == len(p) or (z < len(q) and p[z] < q[z]):
            shared[j] = z
            return i, j
        shared[i] = z
        return j, i

    losers = [0] * k
    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        suffix, _, rest = heads[top]
        yield suffix, shared[top], rest
        head = heads[top] = next(tails[top], None)
        shared[top] = head[1] if head else 0
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _suffix_runs(splitters):
    """``range, blob, flags``: front-coded runs cut at the splitters, and repeats seen inside a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value
        codec = pa.Codec("zstd", compression_level=3)
        items: list[tuple] = []

        def flush():
            items.sort()
            blobs: dict[int, list] = {}
            flags: dict[int, list] = {}
            last = (None, 0, 0)
            for x in items:
                if x[3]:
                    if x[0] == last[0]:
                        if x[1:3] != last[1:3]:
                            flags.setdefault(x[1] % (len(cuts) + 1), []).append(x[1:4])
                        continue
                    last = x
                    where = bisect_right(cuts, x[0])
                else:
                    where = bisect_right(cuts, x[0][:GRAM])
                blobs.setdefault(where, []).append(x)
            items.clear()
            coded = ((p, front_code(b)) for p, b in blobs.items())
            rows = [(p, len(b).to_bytes(4, "little") + codec.compress(b, asbytes=True), None) for p, b in coded]
            rows += [(p, None, pickle.dumps(np.array(f, np.int64), 5)) for p, f in flags.items()]
            part, blob, flag = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary()), pa.array(flag, pa.binary())], names=["range", "blob", "flags"])

        before = None
        for batch in batches:
            for doc, text, version, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column("__codes")):
                if not codes.is_valid or (doc, version) == before:
                    continue
                before = doc, version
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for lo, at, n, kind in zip(*(x.tolist() for x in _decode(codes.values.to_numpy()))):
                    place, end = (version << 31) | lo, lo + n - 1 + LENGTH
                    if kind & WHOLE:
                        items.append((raw[lo:end], doc, place, n, b""))
                    if kind & BORDER:
                        items.append((raw[lo + at : end], doc, place, 0, raw[lo : lo + at]))
                    elif kind & WINDOWS:
                        items += [(raw[lo + i : lo + i + LENGTH], doc, place + i, 1, b"") for i in range(n)]
                    if len(items) >= FLUSH_SUFFIXES:
                        yield flush()
        if items:
            yield flush()

    return run


def _judge_borders(group: list[tuple], out: list[tuple]) -> None:
    """Add the repeated windows among suffixes ``(lcp with the one before, doc, place, left)`` that share a gram."""
    lefts = [int.from_bytes(x[3], "little") for x in group]
    for j in range(1, len(group)):
        right = LENGTH
        _, doc, place, left = group[j]
        anchor = (doc, place + len(left))
        for i in range(j - 1, -1, -1):
            right = min(right, group[i + 1][0])
            most = min(len(left), len(group[i][3]))
            if most < LENGTH - right:
                if len(left) < LENGTH - right:
                    break
                continue
            a, b = lefts[i] >> 8 * (len(group[i][3]) - most), lefts[j] >> 8 * (len(left) - most)
            common = (8 * most - (a ^ b).bit_length()) // 8
            there = (group[i][1], group[i][2] + len(group[i][3]))
            if common >= LENGTH - right and there != anchor:
                later = max(anchor, there)
                out.append((later[0], later[1] - common, common - (LENGTH - right) + 1))


def merge_range(blobs: list[bytes]) -> list[tuple]:
    """Repeats ``(doc, place, n)`` of windows among the suffixes of one range."""
    out: list[tuple] = []
    first: tuple = (0, 0, 0)
    length = plain = border = 0  # of the last plain suffix; least common prefixes since it and since the last border suffix
    group: list[tuple] = []
    for suffix, lcp, (doc, place, n, left) in merge_runs([read_run(b) for b in blobs]):
        plain, border = min(plain, lcp), min(border, lcp)
        if n:
            here = (doc, place, n)
            if plain == length == len(suffix):
                if here > first:
                    out.append(here)
                elif here < first:
                    out.append(first)
                    first = here
            else:
                first, length = here, len(suffix)
            plain = 255
        else:
            if border < GRAM:
                if len(group) > 1:
                    _judge_borders(group, out)
                group = []
            group.append((border, doc, place, left))
            border = 255
    if len(group) > 1:
        _judge_borders(group, out)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge one range after the other; the rows of a partition come sorted by range."""

    def codes(rows):
        doc, place, n = np.array(rows, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(_code(place, 0, n, REPEAT))], names=["doc_id", "code"])

    at, blobs = None, []
    for batch in batches:
        for r, blob, flag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if r != at and blobs:
                if found := merge_range(blobs):
                    yield codes(found)
                blobs = []
            at = r
            if blob.is_valid:
                raw = blob.as_py()
                blobs.append(pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True))
            if flag.is_valid:
                yield codes(pickle.loads(flag.as_py()))
    if blobs and (found := merge_range(blobs)):
        yield codes(found)


def _splitters(docs: DataFrame, contexts: DataFrame, ranges: int) -> list[bytes]:
    """A sorted sample of suffixes that cuts them into about ``ranges`` ranges of equal size."""
    total, wanted = contexts.count(), 8 * ranges
    if ranges < 2 or not total:
        return []
    share = F.pmod(F.xxhash64("doc_id", "code", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, wanted / total) * (1 << 30))
    # at most a few rows a range: small enough to broadcast
    picked = contexts.filter(share).select("doc_id", F.shiftright("code", 48).alias("__version"), (F.shiftright("code", 17).bitwiseAND(F.lit(0x7FFFFFFF))).alias("lo"), (F.shiftright("code", 10).bitwiseAND(F.lit(127)) * (F.col("code").bitwiseAND(F.lit(7)) == BORDER).cast("long")).alias("at"))
    start = (F.col("lo") + F.col("at") + 1).cast("int")
    found = docs.join(F.broadcast(picked), ["doc_id", "__version"]).select(F.substring(F.col("text").cast("binary"), start, F.lit(LENGTH)).alias("s")).distinct()
    sample = sorted(bytes(r["s"]) for r in found.collect())
    return sample[len(sample) // ranges :: max(1, len(sample) // ranges)]


def _with_version(docs: DataFrame) -> tuple[DataFrame, int]:
    """Add ``version``, the number of the text among the texts of its doc_id (0 but for clashing ids), and return all bytes."""
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size"))
    per_id = known.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("size"))
    size, clashes = per_id.agg(F.sum("size"), F.sum((F.col("a") != F.col("b")).cast("long"))).first()
    if not clashes:
        return docs.withColumn("__version", F.lit(0).cast("long")), size or 0
    order = W.partitionBy("doc_id").orderBy("h")
    clashing = known.join(per_id.filter("a <> b").select("doc_id"), "doc_id").select("doc_id", "h").distinct()
    numbered = clashing.withColumn("__version", F.row_number().over(order).cast("long") - 1)
    numbered = numbered.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.when(F.col("__version") < MAX_TEXTS, F.col("__version")).otherwise(-1).alias("__version"))
    found = docs.join(numbered, (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return found.select("doc_id", "text", F.coalesce("__version", F.lit(0).cast("long")).alias("__version"), *rest), size or 0


def shared_contexts(docs: DataFrame, size: int, hot: int = HOT) -> DataFrame:
    """``doc_id, code`` of the contexts that go through the suffix sort."""
    parts = int(max(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"), -(-size // PIECE_BYTES), key=int))
    tasks = min(parts, MAX_TASKS)
    sent = docs.filter("doc_id IS NOT NULL AND __version >= 0").select("doc_id", "text", "__version").mapInArrow(_send_anchors(parts, hot), "part int, blob binary")
    dealt = sent.repartitionById(tasks, F.col("part") % tasks)
    dealt = dealt.sortWithinPartitions("part") if parts > tasks else dealt
    return materialize(dealt.mapInArrow(_choose_kinds(hot), "doc_id long, code long"), "contexts")


def remove_repeats(documents: DataFrame, hot: int = HOT, carry: tuple[str, ...] = (), per_range: int = RANGE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` and the columns ``carry``, for every row.

    ``kept_text`` is what remains; bytes of a character that a removed span cuts are dropped from it.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    docs, size = _with_version(docs)
    docs = docs.select("doc_id", "text", "__version", *carry)
    contexts = shared_contexts(docs, size, hot)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MAX_RANGES, max(parts, -(-contexts.count() // per_range)))
    splitters = _splitters(docs, contexts, ranges)
    ranges, parts = len(splitters) + 1, max(parts, min(len(splitters) + 1, MAX_TASKS))
    key = ["doc_id", "__version"]
    version = F.shiftright("code", 48).alias("__version")
    # both joins take all columns of docs, so that its one exchange serves both
    runs = docs.join(contexts.groupBy("doc_id", version).agg(F.collect_list("code").alias("__codes")), key, "left").select("doc_id", "text", "__version", *carry, "__codes")
    runs = runs.mapInArrow(_suffix_runs(spark.sparkContext.broadcast(splitters)), "range int, blob binary, flags binary")
    dealt = runs.repartitionById(parts, (F.col("range") * F.lit(parts) / F.lit(ranges)).cast("int")).sortWithinPartitions("range")
    found = dealt.mapInArrow(_merge, "doc_id long, code long")
    marks = found.groupBy("doc_id", version).agg(F.collect_list("code").alias("__codes"))
    types = dict(documents.dtypes)
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", *(f"`{c}` {types[c]}" for c in carry)])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *carry]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, codes in zip(batch.column(1), batch.column("__codes")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, removed, spans = raw, 0, 0
                if codes.is_valid:
                    lo, _, n, _ = _decode(codes.values.to_numpy())
                    delta = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(delta, np.minimum(lo, len(raw)), 1)
                    np.add.at(delta, np.minimum(lo + n - 1 + LENGTH, len(raw)), -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if text.is_valid else None))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *(batch.column(3 + i) for i in range(len(carry)))], names=names)

    return docs.join(marks, key, "left").select("doc_id", "text", "__version", *carry, "__codes").mapInArrow(cut, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
