"""Vector codes by ball k-means: product quantisation with one codebook per part.

A vector's components become whole numbers, its parts are coded one by one.  A
codebook entry and the parts assigned to it form a ball.  When the entries move on,

* the ball's radius (the farthest part it had, plus the way its entry moved) tells which
  other entries are its neighbours: those nearer than twice the radius;
* a part nearer to its entry than half the way to the nearest neighbour lies in the stable
  core and stays without any further distance;
* any other part lies in one of the rings that the halved ways to the neighbours, in
  ascending order, cut out of the ball; only the neighbours up to its ring can be nearer
  or as near, and only those are compared.

All comparisons are of whole numbers (4 * squared distance to the own entry against the
squared distance of entries), so no rounding decides and ties go to the lower index.

Each round reads the vectors with their codes, writes them anew to the shared folder
and sums each entry's parts inside the tasks first; the driver sees the entries only
(``ENTRIES`` rows a part), however many vectors there are.  ``reconstruct`` gives the
vectors back from codes and codebooks.

Defined cases: vectors that are null, empty or hold null or non-finite components go, and
so do those of another length than most (see ``vectors.integer_vectors``); a length that
the number of parts does not divide is filled up with zeros; components beyond 131072 on
either side count as that.  A null vec_id comes last among the first entries and stays null in the result; of
rows with one vec_id the one with the least components gives the entry; repeated rows are
coded one by one.  With fewer than ``ENTRIES`` ids there are as many entries.  An empty
table gives no rows; other columns are ignored; a table without labels has one sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import blocks, integer_vectors, matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 27
RING = 32


def _product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T in whole numbers: through doubles where these are exact, else in 64 bits."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if most * most * x.shape[1] < 2.0**52:
        return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return x @ c.T


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * _product(x, c)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first round has no balls yet: the nearest of all entries, the lower index among equals."""
    return distances(x, c).argmin(axis=1)


class Balls:
    """One part's entries with each ball's neighbours in ascending distance."""

    def __init__(self, entries: np.ndarray, radius: list[int] | None):
        self.entries = entries
        if radius is None:
            self.order = None
            return
        apart = distances(entries, entries)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.ways = np.take_along_axis(apart, self.order, axis=1)
        self.counts = np.array([np.searchsorted(w, 4 * r * r, side="right") for w, r in zip(self.ways, radius)])

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New entry and squared distance of each part, from its entry so far."""
        c = self.entries
        if self.order is None:
            own = nearest(x, c)
            return own, ((x - c[own]) ** 2).sum(axis=1)
        own = own.copy()
        near = ((x - c[own]) ** 2).sum(axis=1)
        by = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[by], np.arange(len(c) + 1))
        for ball in np.flatnonzero(cuts[1:] > cuts[:-1]):
            rows = by[cuts[ball] : cuts[ball + 1]]
            ring = np.searchsorted(self.ways[ball, : self.counts[ball]], 4 * near[rows], side="right")
            for low in range(0, int(ring.max()), RING):  # rings of about one width are compared together
                at = rows[(ring > low) & (ring <= low + RING)]
                if not len(at):
                    continue
                others = np.append(self.order[ball, : min(low + RING, self.counts[ball])], ball)
                others.sort()
                found = distances(x[at], c[others])
                best = found.argmin(axis=1)
                own[at], near[at] = others[best], found[np.arange(len(at)), best]
        return own, near


def _assign(state: DataFrame, balls: list[Balls], length: int) -> DataFrame:
    """``state`` with new codes and distances."""
    width = length // len(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = matrix(batch.column(2), length)
            n = len(x)
            own = matrix(batch.column(3), len(balls)).astype(np.int64)
            code, far = np.empty((n, len(balls)), np.int32), np.empty((n, len(balls)), np.int64)
            for p, ball in enumerate(balls):
                code[:, p], far[:, p] = ball.assign(x[:, p * width : (p + 1) * width], own[:, p])
            ends = pa.array(np.arange(n + 1) * len(balls), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(code.reshape(-1))), pa.ListArray.from_arrays(ends, pa.array(far.reshape(-1)))], names=["vec_id", "label", "x", "codes", "far"])

    return state.mapInArrow(run, state.schema)


def _sums(state: DataFrame, parts: int, entries: int, length: int) -> list:
    """``part, entry, n, sums, far``: each entry's count, sums and farthest squared distance, added up in the tasks first."""
    width = length // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x, code, dist = matrix(batch.column(0), length), matrix(batch.column(1), parts), matrix(batch.column(2), parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p * width : (p + 1) * width])
                np.maximum.at(far[p], code[:, p], dist[:, p])
        part, entry = np.nonzero(n)
        ends = pa.array(np.arange(len(part) + 1) * width, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.ListArray.from_arrays(ends, pa.array(sums[part, entry].reshape(-1))), pa.array(far[part, entry])], names=["part", "entry", "n", "sums", "far"])

    partial = state.select("x", "codes", "far").mapInArrow(run, "part int, entry int, n long, sums array<long>, far long")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *exact).collect()


def first_entries(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids, ascending; one for each id."""
    firsts = rows.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    return [r["x"] for r in firsts.collect()]


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes array<int>, error`` and the codebooks, an array of parts x entries x width whole numbers."""
    rows, length = integer_vectors(embeddings, SCALE, 0, LIMIT, vector)
    full = -(-length // parts) * parts
    if full > length:
        rows, length = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), full - length))), full
    first = np.array(first_entries(rows, entries), dtype=np.int64).reshape(-1, length or parts)
    width = first.shape[1] // parts
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    state = rows.select("vec_id", "label", "x", F.array_repeat(F.lit(0), parts).alias("codes"), F.array_repeat(F.lit(0).cast("long"), parts).alias("far"))
    if not len(first):
        return state.select("vec_id", "label", "codes", F.lit(0).cast("long").alias("error")).limit(0), books
    radius: list[list[int]] | None = None
    for _ in range(rounds):
        state = materialize(_assign(state, [Balls(books[p], radius and radius[p]) for p in range(parts)], length), "codes")
        radius, before = [[0] * len(first) for _ in range(parts)], books.copy()
        for r in _sums(state, parts, len(first), length):
            p, k = r["part"], r["entry"]
            books[p, k] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
            radius[p][k] = isqrt(r["far"]) + 1 + isqrt(int(((books[p, k] - before[p, k]) ** 2).sum())) + 1
    coded = materialize(_assign(state, [Balls(books[p], radius and radius[p]) for p in range(parts)], length), "codes")
    return coded.select("vec_id", "label", "codes", F.aggregate("far", F.lit(0).cast("long"), lambda a, b: a + b).alias("error")), books


def reconstruct(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the middle of the cell of each component that the codes stand for."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = matrix(batch.column(1), parts)
            v = (np.concatenate([books[p][code[:, p]] for p in range(parts)], axis=1) + 0.5) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))], names=["vec_id", "vector"])

    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, vector array<double>")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    per_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "label-errors")
    code = F.concat(*[F.lower(F.lpad(F.hex(F.col("codes")[p].cast("long")), 2, "0")) for p in range(PARTS)])
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds with every part compared with every entry."""

    def nearest_of(book: str) -> str:
        return f"""SELECT vec_id, part, arg_min(entry, dist) AS entry, min(dist) AS dist FROM (
      SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) * 1000 + b.entry AS dist
      FROM v JOIN {book} b ON v.part = b.part AND v.pos = b.pos GROUP BY v.vec_id, v.part, b.entry) GROUP BY vec_id, part"""

    rounds = "".join(f""",
a{k} AS MATERIALIZED ({nearest_of(f"b{k}")}),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(s.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT v.part, a.entry, v.pos, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x
    FROM v JOIN a{k} a ON v.vec_id = a.vec_id AND v.part = a.part GROUP BY v.part, a.entry, v.pos) s
  ON b.part = s.part AND b.entry = s.entry AND b.pos = s.pos)""" for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
v AS MATERIALIZED (
  SELECT vec_id, CAST(i * {PARTS} // len(x) AS INT) AS part, CAST(i % (len(x) // {PARTS}) AS INT) AS pos, x[i + 1] AS x
  FROM (SELECT vec_id, x, unnest(range(len(x))) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, pos, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id)
  WHERE entry < {ENTRIES}){rounds},
last AS MATERIALIZED ({nearest_of(f"b{ROUNDS}")}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist // 1000) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN books
"""


SQL = _sql()
