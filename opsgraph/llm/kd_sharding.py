"""K-d tree sharding: recursive splits at distributed weighted medians.

``kd_shards(documents, shards)`` splits the table's metadata space until each
leaf holds its share of the bytes (law ``bytes``).  A node that still has to
give m leaves is cut at the weight quantile floor(m/2)/m along its widest
dimension; a dimension whose cut would miss that weight by more than
``TOLERANCE`` of a leaf yields to the next widest.  Dimensions are the
logarithm of the size, language, source and id, each measured in a unit of its
own (``UNITS``), so that widths can be compared.  A 32-bit hash of the row and of
its place in the written table breaks ties, so a hot language, source, group of
copies or row that is repeated many times can be cut anywhere.

Only DataFrame operations run on the executors.  The cuts of a level are a small table
that the rows meet in a broadcast join, and the rows with their nodes are written once a level; the
driver sees at most ``MAX_SUMS`` sums a round, whatever the table's size and the number of shards.

Defined cases: a null text has size 8 and crc32 0; a null lang, source or doc_id takes
the lowest value of its dimension, and the row's doc_id stays null; repeated rows are placed one by one, each
with a tie of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, materialize, rank_in_group, table

BINS = 1024
MAX_SUMS = 1 << 20
TOLERANCE = 0.002
# One unit of width: a doubling of the size, an eighth of the languages or sources, a million ids.
UNITS = {"k_bytes": 1.0, "k_lang": float(1 << 17), "k_source": float(1 << 17), "k_id": float(1 << 20)}
_MOST, _STEPS = 64, 1 << 24  # a key holds 64 units (longer dimensions have longer units) of 2 ** 24 steps


def _scaled(value: Column, low, high, unit: float) -> Column:
    unit = max(unit, (float(high or 0) - float(low or 0)) / (_MOST - 1))
    return F.coalesce(F.floor((value.cast("double") - F.lit(float(low or 0))) / F.lit(unit) * F.lit(float(_STEPS))), F.lit(0))


def _keyed_rows(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """``doc_id, size, text_crc32``, the row's ``place`` and one 62-bit sort key per dimension."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 20)) + 1).cast("long").alias(c) for c in ("lang", "source")],
        F.monotonically_increasing_id().alias("place"),  # frozen, as the rows are written here
    ), "kd-rows")
    dims = {"k_bytes": F.log2("size"), "k_lang": F.col("lang"), "k_source": F.col("source"), "k_id": F.col("doc_id")}
    edges = rows.agg(*[f(c).alias(f"{f.__name__}_{n}") for n, c in dims.items() for f in (F.min, F.max)]).first()
    tie = F.pmod(F.xxhash64("text_crc32", "doc_id", "place"), F.lit(1 << 32))
    keys = [(_scaled(c, edges[f"min_{n}"], edges[f"max_{n}"], UNITS[n]).cast("long") * F.lit(1 << 32) + tie).alias(n) for n, c in dims.items()]
    return rows.select("doc_id", "size", "text_crc32", "place", *keys), list(dims)


def _inline(rows: DataFrame, names: str, values: list[tuple]) -> DataFrame:
    """A small table of whole numbers inside the plan."""
    text = ", ".join("(" + ", ".join(f"{v}L" for v in value) + ")" for value in values)
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def _descend(rows: DataFrame, nodes: list[dict], dims: list[str]) -> DataFrame:
    """Rows whose ``node`` was cut go on to its child; the cuts of one level are a small table."""
    cuts = _inline(rows, "node, __d, __c, __l, __r", [(n["id"], dims.index(n["dim"]), n["cut"], n["left"]["id"], n["right"]["id"]) for n in nodes])
    key = F.get(F.array(*[F.col(d) for d in dims]), F.col("__d").cast("int"))
    to = F.when(F.col("__d").isNull(), F.col("node")).when(key < F.col("__c"), F.col("__l")).otherwise(F.col("__r"))
    return rows.join(F.broadcast(cuts), "node", "left").withColumn("node", to).drop("__d", "__c", "__l", "__r")


def _open_leaves(tree: dict) -> list[dict]:
    if "cut" in tree:
        return _open_leaves(tree["left"]) + _open_leaves(tree["right"])
    return [tree] if tree["leaves"] > 1 else []


def _narrow(rows: DataFrame, work: list[tuple[int, str, dict]], dims: list[str], leaf_bytes: float) -> None:
    """Narrow each ``(node, dimension)``'s interval around its goal, a histogram of at most ``BINS`` sums each a round.

    The intervals are a small inline table, so the plan and its compiled code stay the same from round to round.
    With many intervals each gets fewer sums and more rounds, and beyond ``MAX_SUMS`` / 4 they take turns.
    """
    for i in range(MAX_SUMS // 4, len(work), MAX_SUMS // 4):
        _narrow(rows, work[i : i + MAX_SUMS // 4], dims, leaf_bytes)
    work = work[: MAX_SUMS // 4]
    keys = F.array(*[F.col(d) for d in dims])
    placed = rows.select("size", keys.alias("k"), "node")
    while work := [(n, d, s) for n, d, s in work if s["hi"] - s["lo"] > 1 and s["rows"] > 1 and s["miss"] > TOLERANCE * leaf_bytes]:
        bins = min(BINS, MAX_SUMS // len(work))
        for _, _, s in work:
            s["step"] = -(-(s["hi"] - s["lo"]) // bins)
        intervals = _inline(rows, "node, dim, lo, hi, step", [(n, dims.index(d), s["lo"], s["hi"], s["step"]) for n, d, s in work])
        key = F.get("k", F.col("dim").cast("int"))
        inside = placed.join(F.broadcast(intervals), "node").withColumn("key", key).filter("key >= lo AND key < hi")
        sums = inside.groupBy("node", "dim", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        found: dict = {}
        for r in sums:
            found.setdefault((r["node"], dims[r["dim"]]), {})[r["bin"]] = (r["w"], r["n"])
        for n, d, s in work:
            below = s["before"]
            for b, (w, count) in sorted(found.get((n, d), {}).items()):
                lo = s["lo"] + b * s["step"]
                hi = min(lo + s["step"], s["hi"])
                for cut, weight in ((lo, below), (hi, below + w)):
                    if abs(weight - s["goal"]) < s["miss"]:
                        s["miss"], s["cut"] = abs(weight - s["goal"]), cut
                if below + w >= s["goal"]:
                    s["lo"], s["hi"], s["before"], s["rows"] = lo, hi, below, count
                    break
                below += w
            else:
                s["rows"] = 0


def _find_cuts(rows: DataFrame, nodes: list[dict], dims: list[str], leaf_bytes: float) -> None:
    """Give each open node its dimension and cut: the widest dimension, unless only another can meet the weight."""
    aggs = [F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")] + [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    stats = {r["node"]: r for r in rows.groupBy("node").agg(*aggs).collect()}
    states: dict[int, dict[str, dict]] = {}
    for node in nodes:
        r = stats.get(node["id"])
        states[node["id"]] = {}
        for d in dims:
            lo, hi = (r[f"min_{d}"], r[f"max_{d}"] + 1) if r else (0, 1)
            goal = (r["w"] if r else 0) * (node["leaves"] // 2) / node["leaves"]
            states[node["id"]][d] = {"lo": lo, "hi": hi, "span": (hi - lo) >> 32, "before": 0, "goal": goal, "cut": lo, "miss": goal, "rows": r["n"] if r else 0}
    widest = {n: max(x, key=lambda d: x[d]["span"]) for n, x in states.items()}
    _narrow(rows, [(n, d, states[n][d]) for n, d in widest.items()], dims, leaf_bytes)
    poor = [n for n, d in widest.items() if states[n][d]["miss"] > TOLERANCE * leaf_bytes]
    if poor:
        _narrow(rows, [(n, d, states[n][d]) for n in poor for d in dims if d != widest[n]], dims, leaf_bytes)
    for node in nodes:
        by_width = sorted(states[node["id"]].items(), key=lambda x: -x[1]["span"])
        good = [x for x in by_width if x[1]["miss"] <= TOLERANCE * leaf_bytes]
        node["dim"], s = good[0] if good else min(by_width, key=lambda x: x[1]["miss"])
        node["cut"] = s["cut"]
        m = node["leaves"]
        node["left"] = {"id": 2 * node["id"] + 1, "leaves": m // 2}
        node["right"] = {"id": 2 * node["id"] + 2, "leaves": m - m // 2}


def _leaves(tree: dict) -> list[int]:
    """Node ids of the leaves from left to right: a leaf's place is its shard."""
    return _leaves(tree["left"]) + _leaves(tree["right"]) if "cut" in tree else [tree["id"]]


def kd_shards(documents: DataFrame, shards: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; shards near equal in bytes.

    Either the number of ``shards`` is given or ``target_bytes``, from which it
    follows.  ``slot`` is gapless from 0 inside each shard.
    """
    rows, dims = _keyed_rows(documents)
    total = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if target_bytes:
        shards = max(1, round((total["w"] or 0) / target_bytes))
    tree: dict = {"id": 0, "leaves": shards}
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    while total["n"] and (nodes := _open_leaves(tree)):
        _find_cuts(rows, nodes, dims, total["w"] / shards)
        rows = materialize(_descend(rows, nodes, dims), "kd-level")
    numbers = _inline(rows, "node, shard", [(node, k) for k, node in enumerate(_leaves(tree))])
    placed = rows.join(F.broadcast(numbers), "node").select("doc_id", "size", "text_crc32", "place", F.col("shard").cast("int").alias("shard"))
    buckets = bucket_count(total["n"] // shards)
    return rank_in_group(placed, ["shard"], ["doc_id", "text_crc32", "place"], F.xxhash64("doc_id", "text_crc32", "place"), buckets, "slot").drop("place")


def query(spark, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
