"""Near-duplicate vectors by search over robust-pruned flat graphs.

Only vectors with equal labels are compared, by cosine in double precision.

1. *Regions.*  Equal vectors of a label collapse to the one with the least id.  Each
   label's vectors are at home in the region of the nearest of the label's centres
   (random members, about one per ``PER_CENTRE``; at most ``MAX_CENTRES`` in all, so
   what is broadcast is bounded); a label below twice ``PER_CENTRE`` is one region.  A
   vector also visits, as a query, every region whose centre lies within the angle to
   its own centre plus the linking angle, unless the plane between the two centres is
   farther than the linking angle: of two linked vectors the one farther from its
   centre visits the other's home.  A task holds at most ``BLOCK`` members and
   ``BLOCK`` queries of a region.
2. *Overlapping shards.*  A region's members form cluster shards of about ``LEAF``
   vectors: each vector stands in those of its ``OVERLAP`` nearest shard centres.
   Each shard gives every vector a robust-pruned list of at most ``DEGREE``
   neighbours: one that is ``ALPHA`` times nearer to a listed neighbour than to the
   vector goes.
3. *Union.*  The lists of all shards are united by vector, with their reverse links
   (so that every vector is listed by another), into one flat graph of at most
   2 * ``OVERLAP`` * ``DEGREE`` links a vector on average.
4. *Search.*  A query starts at the medoids of its shards and its own list, walks
   greedily to ever nearer vectors, and takes in the lists of all it has met within
   twice the linking distance.  Only the cosines of the vectors met are computed.
5. *Verification.*  Pairs near the threshold or above are decided by their cosine in
   double precision.  A pair of different homes counts at the home of the vector nearer
   to its centre.  Each block reports one row per vector (its links counted, its
   component inside the block), never all pairs.

The search may miss links, it reports none below the threshold; ``audit`` measures
the share of found pairs against brute force for the vectors whose id is divisible
by ``every``.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or id, link with nothing and stand alone (a null
id is its own component null and is kept); vectors of different length never link;
repeated rows group under the least id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table
from .linking import components
from .textops import smallest_labels

THRESHOLD = 0.93
PER_CENTRE = 4000
MAX_CENTRES = 8192
BLOCK = 12_000
LEAF = 192
LARGEST_LEAF = 512
OVERLAP = 3
DEGREE = 16
ALPHA = 1.05
BATCH = 512


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def robust_prune(sims: np.ndarray, gram: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row of ``sims`` (queries x members) at most ``degree`` members, -1 where there are fewer.

    ``gram`` holds the members' cosines; a cosine of -2 or less in ``sims`` rules a member out.
    """
    left = 1.0 - sims
    far = np.where(sims <= -2, np.inf, left)
    gap = alpha * alpha * (1.0 - gram)
    rows = np.arange(len(sims))
    lists = np.full((len(sims), degree), -1)
    for k in range(min(degree, sims.shape[1])):
        z = np.argmin(far, axis=1)
        some = far[rows, z] < np.inf
        if not some.any():
            break
        lists[some, k] = z[some]
        far[rows, z] = np.inf
        far[gap[z] <= left] = np.inf
    return lists


def leaves(members: np.ndarray, queries: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Overlapping cluster shards as ``(members, queries)``; every vector stands in those of its nearest centres."""
    n = len(members)
    if n <= LEAF:
        yield np.arange(n), np.arange(len(queries))
        return
    centres = members[rng.choice(n, -(-n * OVERLAP // LEAF), replace=False)]
    overlap = min(OVERLAP, len(centres))

    def nearest(x: np.ndarray) -> np.ndarray:
        found = [np.argpartition(-(x[i : i + 4096] @ centres.T), overlap - 1, axis=1)[:, :overlap] for i in range(0, len(x), 4096)]
        return np.concatenate(found) if found else np.zeros((0, overlap), int)

    own, asked = nearest(members), nearest(queries)
    own_order, asked_order = np.argsort(own.ravel(), kind="stable"), np.argsort(asked.ravel(), kind="stable")
    own_cut = np.searchsorted(own.ravel()[own_order], np.arange(len(centres) + 1))
    asked_cut = np.searchsorted(asked.ravel()[asked_order], np.arange(len(centres) + 1))
    for c in range(len(centres)):
        m = own_order[own_cut[c] : own_cut[c + 1]] // overlap
        q = asked_order[asked_cut[c] : asked_cut[c + 1]] // overlap
        if len(m):
            for part in np.array_split(rng.permutation(m), -(-len(m) // LARGEST_LEAF)):
                for i in range(0, max(len(q), 1), LARGEST_LEAF):
                    yield part, q[i : i + LARGEST_LEAF]


class FlatGraph:
    """The united lists of all shards over ``members`` (unit vectors), and what ``queries`` start from."""

    def __init__(self, members: np.ndarray, queries: np.ndarray):
        rng = np.random.default_rng(len(members))
        self.members, self.queries = members, queries
        ends: list[tuple] = []
        starts: list[tuple] = []
        for m, q in leaves(members, queries, rng):
            gram = members[m] @ members[m].T
            inner = gram.copy()
            np.fill_diagonal(inner, -3.0)
            lists = robust_prune(inner, gram)
            at, k = np.nonzero(lists >= 0)
            to = lists[at, k]
            ends.append((m[at], m[to]))
            medoid = m[np.argmax(gram.sum(axis=0))]
            starts.append((np.arange(len(members))[m], np.full(len(m), medoid)))
            if len(q):
                lists = robust_prune(queries[q] @ members[m].T, gram)
                at, k = np.nonzero(lists >= 0)
                starts += [(len(members) + q[at], m[lists[at, k]]), (len(members) + q, np.full(len(q), medoid))]
        a, b = (np.concatenate(x) for x in zip(*ends))
        both = np.unique(np.concatenate([a * len(members) + b, b * len(members) + a]))
        a, b = both // len(members), both % len(members)
        self.cut, self.to = np.searchsorted(a, np.arange(len(members) + 1)), b
        who, where = (np.concatenate(x) for x in zip(*starts))
        order = np.argsort(who, kind="stable")
        self.start_cut = np.searchsorted(who[order], np.arange(len(members) + len(queries) + 1))
        self.start_at = where[order]

    @staticmethod
    def _take(cut: np.ndarray, values: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, value)`` of all values listed under each key."""
        size = cut[keys + 1] - cut[keys]
        at = np.repeat(cut[keys] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.repeat(rows, size), values[at]

    def search(self, who: np.ndarray, wide: float, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        """``(place in who, member)`` at a cosine of ``wanted`` or more for members and (after them) queries ``who``."""
        n = len(self.members)
        x = np.concatenate([self.members[who[who < n]], self.queries[who[who >= n] - n]]) if len(self.queries) else self.members[who]
        rows = np.arange(len(who))
        seen = np.zeros((len(who), n), bool)
        nearest = np.full(len(who), -2.0, x.dtype)
        found: list[tuple] = []
        r, c = self._take(self.start_cut, self.start_at, rows, who)
        mine = np.flatnonzero(who < n)
        more = self._take(self.cut, self.to, mine, who[mine])
        r, c = np.concatenate([r, more[0]]), np.concatenate([c, more[1]])
        seen[mine, who[mine]] = True
        while len(r):
            new = np.unique((r * n + c)[~seen[r, c]])
            r, c = new // n, new % n
            if not len(r):
                break
            seen[r, c] = True
            cos = np.einsum("ij,ij->i", x[r], self.members[c])
            hit = cos >= wanted
            found.append((r[hit], c[hit]))
            best = np.full(len(who), -2.0, x.dtype)
            np.maximum.at(best, r, cos)
            # the wide range is taken in; outside it only the walk to a nearer vector goes on
            go = (cos >= wide) | (cos == best[r]) & (cos > nearest[r])
            nearest = np.maximum(nearest, best)
            r, c = self._take(self.cut, self.to, r[go], c[go])
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        r, c = (np.concatenate(f) for f in zip(*found))
        return r, c


def range_search(members: np.ndarray, queries: np.ndarray, threshold: float, members_too: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield ``(asking, member)`` pairs at a cosine of ``threshold`` or more, in batches, for unit vectors.

    Asking are the members themselves (if ``members_too``) and the ``queries``, numbered after the members.
    """
    near, far = members.astype(np.float32), queries.astype(np.float32)
    graph = FlatGraph(near, far)
    wide = 1.0 - 4.0 * (1.0 - threshold)  # the cosine at twice the chord
    asking = np.arange(0 if members_too else len(members), len(members) + len(queries))
    # what a batch holds grows with its queries times the members
    step = max(16, min(BATCH, (64 << 20) // max(1, len(members))))
    for i in range(0, len(asking), step):
        who = asking[i : i + step]
        r, c = graph.search(who, wide, threshold - 1e-4)
        if len(r):
            w = who[r]
            ask = np.where((w < len(members))[:, None], members[np.minimum(w, len(members) - 1)], queries[np.maximum(w - len(members), 0)] if len(queries) else 0.0)
            sure = np.einsum("ij,ij->i", ask, members[c]) >= threshold
            yield w[sure], c[sure]


def _valid(vector: str):
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)


def _centres(points: DataFrame, per_centre: int, max_centres: int) -> dict:
    """``{(label, dim): unit centres}`` for labels that need more than one shard."""
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * per_centre)
    total = sizes.agg(F.sum(F.ceil(F.col("n") / per_centre))).first()[0] or 0
    if not total:
        return {}
    share = min(1.0, max_centres / total)
    wanted = sizes.withColumn("c", F.greatest(F.floor(F.ceil(F.col("n") / per_centre) * share), F.lit(1))).orderBy(F.desc("n")).limit(max_centres)
    # a thin sample by hash first, so that no task ranks a whole label
    thin = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.least(F.lit(1 << 30), F.col("c") * 8.0 / F.col("n") * (1 << 30) + 64.0 / F.col("n") * (1 << 30))
    order = W.partitionBy("label", "dim").orderBy(F.xxhash64("id"))
    chosen = points.join(F.broadcast(wanted), ["label", "dim"]).filter(thin).withColumn("r", F.row_number().over(order)).filter("r <= c")
    found: dict = {}
    for r in chosen.select("label", "dim", "vector").collect():
        found.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    return {k: _unit(v) for k, v in found.items()}


def _blocks(vectors: DataFrame, key: str, vector: str, label: str, threshold: float, per_centre: int, max_centres: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows, points`` (distinct valid vectors) and the members and queries of all blocks."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    good = _valid("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = materialize(rows.withColumn("vector", F.when(good, F.col("vector"))).withColumn("dim", F.size("vector")), "vectors")
    same = rows.filter("vector IS NOT NULL").groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    points = materialize(same, "points")
    centres = points.sparkSession.sparkContext.broadcast(_centres(points, per_centre, max_centres))
    angle = float(np.arccos(threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            homes, radii, visits = [0] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            groups: dict = {}
            for i, k in enumerate(zip(labels, dims)):
                if k in centres.value:
                    groups.setdefault(k, []).append(i)
            for k, index in groups.items():
                c = centres.value[k]
                x = np.array([batch.column(2)[i].values.to_numpy() for i in index])
                cos = np.clip(_unit(x) @ c.T, -1.0, 1.0)
                home = np.argmax(cos, axis=1)
                near = cos[np.arange(len(x)), home]
                radius = np.arccos(near)
                visit = np.arccos(cos) <= (radius + angle)[:, None] + 1e-6
                if threshold > 0:
                    apart = np.sqrt(np.maximum(2.0 - 2.0 * (c[home] @ c.T), 0.0))
                    visit &= near[:, None] - cos <= np.sin(angle) * apart + 1e-6
                visit[np.arange(len(x)), home] = False
                for i, h, r, v in zip(index, home.tolist(), radius.tolist(), visit):
                    homes[i], radii[i], visits[i] = h, r, np.flatnonzero(v).tolist()
            for name, column in (("home", pa.array(homes, pa.int32())), ("radius", pa.array(radii, pa.float64())), ("visits", pa.array(visits, pa.list_(pa.int32())))):
                batch = batch.append_column(name, column)
            yield batch

    schema = "label {0}, dim int, vector array<double>, id long, copies long, home int, radius double, visits array<int>".format(dict(points.dtypes)["label"])
    placed = materialize(points.select("label", "dim", "vector", "id", "copies").mapInArrow(assign, schema), "placed")
    region = ["label", "dim", "region"]
    at_home = placed.withColumn("region", F.col("home"))
    visitors = placed.withColumn("region", F.explode("visits"))
    in_pieces = lambda df, name: df.groupBy(*region).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    pieces = in_pieces(at_home, "pieces").join(in_pieces(placed.select("label", "dim", F.explode("visits").alias("region")), "more"), region, "left").fillna(0, ["more"])
    # query pieces up to ``pieces`` are those of the members, the visitors' come after
    at_home = at_home.join(pieces, region).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    visitors = visitors.join(pieces, region).withColumn("piece", F.col("pieces") + F.pmod(F.xxhash64("id"), F.col("more")).cast("int"))
    # each vector stands as a member in one row of blocks and as a query in one column
    inner = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    outer = F.explode(F.sequence(F.lit(0), F.col("pieces") + F.col("more") - 1))
    rest = ["id", "copies", "home", "radius", "vector"]
    both = at_home.select(*region, F.col("piece").alias("pm"), F.col("piece").alias("pq"), F.lit(0).alias("role"), *rest)
    as_member = at_home.withColumn("o", outer).filter("o <> piece").select(*region, F.col("piece").alias("pm"), F.col("o").alias("pq"), F.lit(1).alias("role"), *rest)
    as_query = at_home.withColumn("o", inner).filter("o <> piece").unionByName(visitors.withColumn("o", inner)).select(*region, F.col("o").alias("pm"), F.col("piece").alias("pq"), F.lit(2).alias("role"), *rest)
    return rows, points, both.unionByName(as_member).unionByName(as_query)


def _pairs(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked ``(asking, member)`` row numbers of a block, in batches."""
    role = t.column("role").to_numpy()
    x = _unit(t.column("vector").combine_chunks().values.to_numpy().reshape(len(role), -1))
    m, q = np.flatnonzero(role <= 1), np.flatnonzero(role == 2)
    if len(m):
        numbers = np.concatenate([m, q])
        for a, b in range_search(x[m], x[q], threshold, bool((role == 0).any())):
            a, b = numbers[a], m[b]
            yield a[a != b], b[a != b]


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                 per_centre: int = PER_CENTRE, max_centres: int = MAX_CENTRES, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    rows, points, blocks = _blocks(vectors, key, vector, label, threshold, per_centre, max_centres, block)

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        homes, radii = t.column("home").to_numpy(), t.column("radius").to_numpy()
        counts = np.zeros(len(ids), np.int64)
        low = np.arange(len(ids))
        for a, b in _pairs(t, threshold):
            here = homes[a] == homes[b]
            np.add.at(counts, a[here], copies[b[here]])
            # a visitor is met as a query only, so its links count for both ends
            away = ~here & ((radii[b] < radii[a]) | (radii[b] == radii[a]) & (homes[b] < homes[a]))
            np.add.at(counts, a[away], copies[b[away]])
            np.add.at(counts, b[away], copies[a[away]])
            low = low[smallest_labels(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, low]))]
        keep = (counts > 0) | (low != np.arange(len(ids)))
        return pa.table({"id": ids[keep], "n": counts[keep], "low": ids[low][keep]})

    found = materialize(blocks.groupBy("label", "dim", "region", "pm", "pq").applyInArrow(search, "id long, n long, low long"), "neighbours")
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).filter("a <> b"))
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    classes = points.join(linked, "id", "left").join(groups, "id", "left").select(
        "label", "dim", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    some = rows.filter("vector IS NOT NULL").join(classes, ["label", "dim", "vector"]).select("vec_id", "n_links", "component_id")
    none = rows.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, threshold: float = THRESHOLD, every: int = 100, **options) -> tuple[int, int]:
    """``(found, true)``: linked pairs of distinct vectors, for the vectors whose id is divisible by ``every``.

    The search is run again and its pairs are compared, pair by pair, with brute force in blocks.
    """
    settings = {"key": "vec_id", "vector": "embedding", "label": "label", "per_centre": PER_CENTRE, "max_centres": MAX_CENTRES, "block": BLOCK} | options
    _, points, blocks = _blocks(vectors, settings["key"], settings["vector"], settings["label"], threshold, settings["per_centre"], settings["max_centres"], settings["block"])

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("id").to_numpy()
        ends = [(ids[a], ids[b]) for a, b in _pairs(t, threshold)]
        a, b = (np.concatenate(e) for e in zip(*ends)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.table({"a": a[a % every == 0], "b": b[a % every == 0]})

    got = blocks.groupBy("label", "dim", "region", "pm", "pq").applyInArrow(search, "a long, b long").distinct()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = points.filter(F.col("id") % every == 0).select(F.col("id").alias("a"), F.col("vector").alias("x"), "label", "dim")
    cos = dot(F.col("x"), F.col("vector")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("vector"), F.col("vector")))
    true = points.select(F.col("id").alias("b"), "vector", "label", "dim").join(asked, ["label", "dim"]).filter("a <> b").filter(cos >= threshold).select("a", "b")
    r = true.join(got.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count(F.lit(1)), F.coalesce(F.sum("hit"), F.lit(0))).first()
    return int(r[1]), int(r[0])


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
