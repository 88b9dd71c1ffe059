"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union.

Words are runs without ASCII white space, A-Z lower-cased; a document's set is
its distinct 5-word shingles (its whole word sequence if it has fewer words).

Every shingle visits the slots in its own pseudo-random order; at step j it
offers slot p(j) the rank j plus a fraction, and each slot keeps the least.  As a
shingle's ranks are spread over all slots, estimates vary less than with
independent hashes; a document stops after the step by which every slot holds a
smaller rank, which is after one or two steps for usual lengths.

Equal sets are collapsed first.  Bands of the signatures give buckets, pairs of
a bucket are confirmed on full shingle sets, and groups are connected components
(``linking.link_buckets``: of a large bucket no pair becomes a row).  With 32 bands of 4
a pair at similarity 0.75 shares no bucket with probability 5e-6, at 0.8 with 5e-8.

Defined cases: documents without words (null, empty, blank) have an empty set
and link with nothing; so does a row with a null doc_id, whose component is null and
which is kept; repeated rows and equal texts group under the smallest id; rows of one doc_id with
other texts are documents of their own, each linked by its own text (``stays`` tells which row represents a group);
very long texts are processed whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, table
from .linking import link_buckets, with_component
from .textops import chunks, distinct_shingles, mix, smallest_labels

SLOTS = 128
BANDS, ROWS = 32, 4
PERCENT = 75
SHINGLE = 5


def _visit(h: np.ndarray, j: int, bits: int = 7) -> np.ndarray:
    """The slot that each element visits at step j: a bijection of j keyed by the element."""
    m, t = np.uint64((1 << bits) - 1), np.uint64
    k = mix(h ^ t(0x5851F42D4C957F2D))
    x = (t(j) + k) & m
    for s in (7, 21, 35):
        x = (x * ((k >> t(s)) & m | t(1)) + (k >> t(s + 7))) & m
        x ^= x >> t(3)
    return x


def signatures(hashes: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (n_docs x slots) of the documents' distinct element hashes.

    The rank's integer part stands in the upper 8 bits, its fraction below.
    """
    bits = slots.bit_length() - 1
    sig = np.full(n_docs * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    h, d = hashes, doc
    for j in range(slots):
        if not len(h):
            break
        value = (mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(8)) | np.uint64(j << 56)
        np.minimum.at(sig, d * slots + _visit(h, j, bits).astype(np.int64), value)
        worst = sig.reshape(n_docs, slots).max(axis=1)
        alive = (worst >= np.uint64((j + 1) << 56)) if j + 1 < slots else np.zeros(n_docs, bool)
        keep = alive[d]
        h, d = h[keep], d[keep]
    return sig.reshape(n_docs, slots)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = mix(np.arange(7, 7 + rows, dtype=np.uint64)) | np.uint64(1)
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        return mix((parts * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, row_key, n_shingles, set_a, set_b`` (a 128-bit hash of the set) and ``bands`` (empty for empty sets)."""
    schema = "doc_id long, row_key long, n_shingles long, set_a long, set_b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(2)):
                h, d = distinct_shingles(buf, off, SHINGLE)
                n = j - i
                count = np.bincount(d, minlength=n)
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                has = np.flatnonzero(count)
                if len(has):
                    firsts = np.concatenate([[0], np.cumsum(count[has])[:-1]])
                    a[has] = np.add.reduceat(mix(h), firsts)
                    b[has] = np.add.reduceat(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), firsts)
                keys = _band_keys(signatures(h, d, n), bands, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]), type=pa.int32()),
                    pa.array(keys[count > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(count.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists],
                    names=["doc_id", "row_key", "n_shingles", "set_a", "set_b", "bands"])

    return documents.select(F.col("doc_id").cast("long"), row_key(), "text").mapInArrow(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets have 100 * intersection >= percent * union."""
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 256):
                ta, tb = batch.column(2).slice(lo, 256), batch.column(3).slice(lo, 256)
                n = len(ta)
                sizes, parts = [], []
                for side in (ta, tb):
                    hs, ds = [], []
                    for i, _, buf, off in chunks(side):
                        h, d = distinct_shingles(buf, off, SHINGLE)
                        hs.append(h)
                        ds.append(d + i)
                    h, d = np.concatenate(hs), np.concatenate(ds)
                    sizes.append(np.bincount(d, minlength=n))
                    parts.append((h, d))
                h, d = (np.concatenate([parts[0][k], parts[1][k]]) for k in (0, 1))
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
                inter = np.bincount(d[1:][same], minlength=n)
                keep[lo : lo + n] = 100 * inter >= percent * (sizes[0] + sizes[1] - inter)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _incidence(h: np.ndarray, d: np.ndarray, n: int, vocabulary: np.ndarray) -> np.ndarray:
    place = np.searchsorted(vocabulary, h)
    place[place == len(vocabulary)] = 0
    ok = vocabulary[place] == h
    out = np.zeros((n, len(vocabulary)), np.float32)
    out[d[ok], place[ok]] = 1
    return out


def intersections(hq: np.ndarray, dq: np.ndarray, nq: int, hm: np.ndarray, dm: np.ndarray, nm: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of nq sets with nm sets, by products of incidence matrices of bounded width."""
    both = np.intersect1d(hq, hm)
    total = np.zeros((nq, nm), np.int64)
    for i in range(0, len(both), width):  # a product's sums are at most the width, so single floats hold them exactly
        part = both[i : i + width]
        total += (_incidence(hq, dq, nq, part) @ _incidence(hm, dm, nm, part).T).astype(np.int64)
    return total


def _sets(column) -> tuple[np.ndarray, np.ndarray]:
    parts = [(h, d + i) for i, _, buf, off in chunks(column) for h, d in [distinct_shingles(buf, off, SHINGLE)]]
    return np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])


def confirm_blocks(groups: DataFrame, texts: DataFrame, percent: int = PERCENT, block: int = 1000, block_bytes: int = 4 << 20) -> DataFrame:
    """Links ``(a, b)`` that join what is linked between each group's outsiders and its members.

    A group's outsiders and members are cut into pieces of at most ``block`` rows
    and about ``block_bytes``; each pair of pieces is one task's work on full sets.
    """
    rows = groups.join(texts, "id")
    size = F.octet_length("text")
    pieces = lambda when: F.greatest(F.ceil(F.sum(when.cast("int")) / block), F.ceil(F.sum(F.when(when, size).otherwise(0)) / block_bytes), F.lit(1)).cast("int")
    counts = materialize(rows.groupBy("hub").agg(pieces(F.col("outside") == 1).alias("pq"), pieces(F.lit(True)).alias("pm")), "pieces")
    rows = rows.join(counts, "hub").withColumn("x", F.xxhash64("id"))
    asked = rows.filter("outside = 1").select("hub", F.pmod("x", F.col("pq").cast("long")).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pm").cast("long") - 1)).alias("m"), F.lit(0).alias("role"), "id", "comp", "text")
    among = rows.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pq").cast("long") - 1)).alias("q"), F.pmod("x", F.col("pm").cast("long")).alias("m"), F.lit(1).alias("role"), "id", "comp", "text")

    def run(t: pa.Table) -> pa.Table:
        role, ids = t.column("role").to_numpy(), t.column("id").to_numpy()
        text = t.column("text").combine_chunks()
        q, m = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        (hq, dq), (hm, dm) = _sets(text.take(pa.array(q))), _sets(text.take(pa.array(m)))
        nq, nm = np.bincount(dq, minlength=len(q)), np.bincount(dm, minlength=len(m))
        inter = intersections(hq, dq, len(q), hm, dm, len(m))
        a, b = np.nonzero(100 * inter >= percent * (nq[:, None] + nm[None, :] - inter))
        names, at = np.unique(ids, return_inverse=True)
        low = names[smallest_labels(len(names), at[q[a]], at[m[b]])]
        linked = low != names
        return pa.table({"a": low[linked], "b": names[linked]})

    return asked.unionByName(among).groupBy("hub", "q", "m").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row_key, stays`` per row of ``documents``.

    ``stays`` marks the rows of one text in each component: of its smallest doc_id the one with the least key.
    """
    base = materialize(sketch(documents), "sketch")
    full = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = ["set_a", "set_b", "n_shingles"]
    # a class of equal sets is one vertex, numbered as it is written; one of its texts stands for it
    first = full.groupBy(*sets).agg(F.min(F.struct("doc_id", "row_key")).alias("rep"))
    classes = materialize(first.select(*sets, "rep", F.monotonically_increasing_id().alias("id")), "classes")
    reps = classes.select("id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.row_key").alias("row_key"))
    members = full.join(reps, ["doc_id", "row_key"]).select(F.explode(F.array_distinct("bands")).alias("key"), "id").distinct()
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = materialize(members.join(sizes, "key"), "buckets")
    needed = reps.join(members.select("id").distinct(), "id", "left_semi")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").join(needed, ["doc_id", "row_key"])
    texts = materialize(texts.select("id", "text").dropDuplicates(["id"]), "texts")
    _, found = link_buckets(members, lambda pairs: confirm(pairs, texts, percent), lambda groups: confirm_blocks(groups, texts, percent))
    heads = found.join(classes.select("id", "rep"), "id").groupBy("comp").agg(F.min("rep").alias("head"))
    found = found.join(heads, "comp").select("id", "head")
    placed = classes.join(found, "id", "left").select(*sets, F.coalesce("head", "rep").alias("head"))
    grouped = full.join(placed, sets).select("doc_id", "n_shingles", "row_key", F.col("head.doc_id").alias("component_id"), (F.col("head.doc_id") == F.col("doc_id")).alias("kept"), (F.col("head.row_key") == F.col("row_key")).alias("stays"))
    empty = base.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", "row_key", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    return grouped.unionByName(empty).select("doc_id", "n_shingles", "component_id", "kept", "row_key", "stays")


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, and all rows without words or id; columns as given."""
    judged = materialize(near_duplicates(documents, percent).select("row_key", "stays", (F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).alias("worded")), "judged")
    repeated = judged.filter("stays AND worded").groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias("__key"))
    settled = materialize(judged.filter("NOT stays").select(F.col("row_key").alias("__key")).distinct().withColumn("__again", F.lit(False)).unionByName(repeated.withColumn("__again", F.lit(True))), "settled")
    keyed = documents.withColumn("__row", row_key())
    alone = keyed.join(settled, F.col("__row") == F.col("__key"), "left_anti")
    once = keyed.join(settled.filter("__again"), F.col("__row") == F.col("__key"), "left_semi").dropDuplicates(["__row"])
    return alone.unionByName(once).drop("__row")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
