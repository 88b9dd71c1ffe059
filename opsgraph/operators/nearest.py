"""Exact nearest vectors by blocked matrix products.

Each task multiplies blocks of vectors with the queries of their tenant and keeps a heap of the best
k per query; only these become rows, and the heaps of all tasks are merged by rank.  A block
is split into cells around some of its members.  By the triangle inequality no vector of a
cell is nearer to a query than the angle to the cell's centre less the cell's radius, so
cells that cannot reach a query's k-th hit are skipped for it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import materialize

BLOCK = 4096
CELL = 64
MAX_QUERY_BYTES = 32 << 20
_SLACK = 1e-9


def _rounded(s: np.ndarray, a: np.ndarray, b: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines held within -1 and 1 and rounded half up; whatever lies at the edge of a step, or at zero, is summed anew in order."""
    p = 10.0**digits
    t = s * p + 0.5
    edge = np.flatnonzero((np.abs(t - np.rint(t)) < 1e-6) | (np.abs(s) < _SLACK))
    if len(edge):
        total = np.zeros(len(edge))
        for i in range(a.shape[1]):
            total = total + a[edge, i] * b[edge, i]
        s = s.copy()
        s[edge] = total
    s = np.clip(s, -1.0, 1.0)
    return s, np.floor(s * p + 0.5) / p


class Heap:
    """The best k rows per query by falling similarity, then rising order."""

    def __init__(self, k: int, n: int):
        self.k, self.least = k, np.full(n, -2.0)
        self.rows: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, query: int, found: list[tuple]) -> None:
        best = sorted([*self.rows[query], *found], key=lambda r: (-r[0], r[1]))[: self.k]
        self.rows[query] = best
        if len(best) == self.k:
            self.least[query] = best[-1][0]


def search_block(heap: Heap, q: np.ndarray, v: np.ndarray, names: list, digits: int, cell: int = CELL) -> int:
    """Offer the vectors v, ``names`` being (order, id), to all queries q; returns the number of products left out."""
    half = 0.5 / 10**digits + _SLACK
    n = -(-len(v) // cell)
    centres = v[np.linspace(0, len(v) - 1, n).astype(int)]
    near = v @ centres.T
    of = near.argmax(axis=1)
    angle = np.arccos(np.clip(near[np.arange(len(v)), of], -1, 1))
    radius = np.zeros(n)
    np.maximum.at(radius, of, angle)
    unit = bool(np.all(np.abs((v * v).sum(axis=1) - 1) < 1e-6) and np.all(np.abs((q * q).sum(axis=1) - 1) < 1e-6))
    to_centre = np.arccos(np.clip(q @ centres.T, -1, 1))
    bound = np.where(to_centre > radius, np.cos(to_centre - radius - 1e-7), 1.0) if unit else np.full((len(q), n), 1.0)
    skipped = 0
    for c in np.argsort(-bound.max(axis=0), kind="stable"):
        rows = np.flatnonzero(of == c)
        ask = np.flatnonzero((bound[:, c] + half >= heap.least) & (bound[:, c] > -_SLACK))
        skipped += len(rows) * (len(q) - len(ask))
        if not len(rows) or not len(ask):
            continue
        s = q[ask] @ v[rows].T
        i, j = np.nonzero((s > -_SLACK) & (s + half >= heap.least[ask][:, None]))
        exact, value = _rounded(s[i, j], q[ask[i]], v[rows[j]], digits)
        good = exact > 0
        # the rows of one query stand together; of many only the best k and their ties go on
        for at in np.split(np.flatnonzero(good), np.flatnonzero(np.diff(i[good])) + 1):
            if not len(at):
                continue
            if len(at) > heap.k:
                at = at[value[at] >= np.partition(value[at], len(at) - heap.k)[len(at) - heap.k]]
            heap.add(int(ask[i[at[0]]]), [(float(value[x]), *names[rows[j[x]]]) for x in at])
    return skipped


_OUT = "tenant_id string, query_id string, chunk_id string, similarity double, place array<long>"


def _emit(heaps: dict, ids: dict) -> pa.RecordBatch:
    rows = [(t, ids[t, d][i], name, s, place) for (t, d), heap in heaps.items() for i, found in enumerate(heap.rows) for s, place, name in found]
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["tenant_id", "query_id", "chunk_id", "similarity", "place"])


def _queries(asked: list[tuple]) -> tuple[dict, dict]:
    """Queries ``(tenant, id, vector)`` as ids and as a matrix, by tenant and length."""
    ids, vectors = defaultdict(list), defaultdict(list)
    for tenant, name, v in asked:
        ids[tenant, len(v)].append(name)
        vectors[tenant, len(v)].append(v)
    return dict(ids), {key: np.array(m, dtype=np.float64) for key, m in vectors.items()}


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``(tenant, length), matrix, names`` of a batch ``tenant_id, chunk_id, place, embedding``."""
    column = batch.column(3)
    sizes = np.diff(column.offsets.to_numpy())
    by = defaultdict(list)
    for i, key in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist())):
        if key[1]:
            by[key].append(i)
    for (tenant, d), at in by.items():
        some = batch.take(pa.array(at))
        yield (tenant, d), some.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), list(zip(some.column(2).to_pylist(), some.column(1).to_pylist()))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 3, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """``tenant_id, query_id, chunk_id, similarity, place, rank``: the k of ``vectors(tenant_id, chunk_id, place, embedding)`` with the
    greatest positive cosine to each of ``queries(tenant_id, query_id, embedding)``, rounded to ``digits`` before ranking, ties by ``place``, a list of numbers.

    Vectors of other lengths than a query, and empty ones, aren't near to it.  The queries are broadcast up to ``max_query_bytes``; beyond that they are cut
    into pieces of that size, each of which the vectors are read for once more.
    """
    asked = materialize(queries.select("tenant_id", F.col("query_id").cast("string").alias("query_id"), "embedding").filter("size(embedding) > 0"))
    size = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    pieces = max(1, -(-size // max_query_bytes))
    # a filter on embeddings would compute them twice where they come from a function, so the tasks leave empty ones out
    rows = vectors.select("tenant_id", F.col("chunk_id").cast("string").alias("chunk_id"), "place", "embedding")

    def search(part: DataFrame) -> DataFrame:
        sent = asked.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = _queries(sent.value)
            heaps = {key: Heap(k, len(names)) for key, names in ids.items()}
            waiting = defaultdict(list)

            def offer(key: tuple) -> None:
                held = waiting.pop(key)
                search_block(heaps[key], q[key], np.concatenate([m for m, _ in held]), [x for _, names in held for x in names], digits)

            for batch in batches:
                for key, matrix, names in _pieces(batch):
                    if key in heaps:
                        waiting[key].append((matrix, names))
                        if sum(len(n) for _, n in waiting[key]) >= BLOCK:
                            offer(key)
            for key in list(waiting):
                offer(key)
            yield _emit(heaps, ids)

        return rows.mapInArrow(run, _OUT)

    if pieces == 1:
        found = search(asked)
    else:
        parts = [materialize(search(asked.filter(F.pmod(F.xxhash64("tenant_id", "query_id"), F.lit(pieces)) == i))) for i in range(pieces)]
        found = reduce(DataFrame.unionByName, parts)
    order = W.partitionBy("tenant_id", "query_id").orderBy(F.desc("similarity"), "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
