"""Packing by optimal length buckets.

``optimal_boundaries`` finds, by dynamic programming over the global length
histogram, the bucket boundaries with the least total padding.  ``pack`` pads
each sequence to its bucket's boundary and forms batches of at most
``token_budget`` padded tokens inside each bucket; ``lay_out`` also gives each
sequence's ids, padded to the boundary.

Lengths are numbers of words (runs without white space), or of byte-pair ids if
``ranks`` are given (see ``training_order.read_ranks``).  The histogram has one bin per
length that occurs, so the boundaries are optimal; the driver gets one row per
distinct length, at most as many as the longest sequence has tokens.

Defined cases: null and empty texts have length 0 and go to the first bucket; a
sequence longer than the budget makes a batch of its own, never cut; repeated
rows are packed one by one; a null doc_id stays null; very long texts are counted
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, materialize, rank_in_group, table
from .training_order import PATTERN, _encoder, id_width

BUCKETS = 16
TOKEN_BUDGET = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (some of the ascending ``lengths``) with the least padding in at most ``buckets`` buckets.

    Of the lengths before i covered at best cost, one more bucket up to length j costs
    best(i) + length(j) * (rows(j) - rows(i)) - (tokens(j) - tokens(i)): lines in length(j),
    of falling slope, so each bucket's pass is one walk over their lower hull.
    """
    n = len(lengths)
    if not n:
        return []
    rows, tokens = [0], [0]
    for length, count in zip(lengths, counts):
        rows.append(rows[-1] + count)
        tokens.append(tokens[-1] + length * count)
    best = [0] + [lengths[j] * rows[j + 1] - tokens[j + 1] for j in range(n)]
    back = [[0] * (n + 1)]
    for used in range(2, min(buckets, n) + 1):
        new, origin = [None] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(used, n + 1):
            i = j - 1  # the lines of fewer lengths are in the hull by now
            line = (-rows[i], best[i] + tokens[i], i)
            while len(hull) - at >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - tokens[j]
            origin[j] = hull[at][2]
        if new[n] >= best[n]:  # no more buckets are of use
            break
        best = [b if v is None else v for v, b in zip(new, best)]
        back.append(origin)
    out, j = [], n
    for origin in reversed(back):
        out.append(lengths[j - 1])
        j = origin[j]
    return sorted(out)


def _place(rows: DataFrame, buckets: int, token_budget: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Buckets, batches and positions of materialised rows ``doc_id, n_tokens, ...``."""
    bins = sorted((r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    edges = optimal_boundaries([x for x, _ in bins], [n for _, n in bins], buckets) or [0]
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    placed = rows.withColumn("bucket", F.size(F.filter(bounds, lambda e: e < F.col("n_tokens")))).withColumn("boundary", F.get(bounds, F.col("bucket")))
    ranked = rank_in_group(placed, ["bucket"], ["doc_id", "n_tokens"], F.xxhash64("doc_id", F.spark_partition_id()), bucket_count(sum(n for _, n in bins)), "rank")
    room = F.greatest(F.expr(f"{token_budget} div greatest(boundary, 1)"), F.lit(1))
    return ranked.withColumn("__room", room).select(
        "doc_id", "n_tokens", "bucket", "boundary",
        F.expr("rank div __room").alias("batch"), (F.col("rank") % F.col("__room")).cast("int").alias("position"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"), *carry)


def _encoded(documents: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool) -> DataFrame:
    vocabulary = documents.sparkSession.sparkContext.broadcast(ranks)
    width = id_width(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value, pattern)
        for batch in batches:
            ids = [encode(t.as_buffer().to_pybytes()) if t.is_valid else b"" for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(x) // width for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if keep_ids else columns, names=["doc_id", "n_tokens", "ids"][: 3 if keep_ids else 2])

    schema = "doc_id long, n_tokens long" + (", ids binary" if keep_ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(documents: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, ranks: dict[bytes, int] | None = None, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, bucket, boundary, batch, position, padding`` for every row."""
    counted = documents.select("doc_id", word_count(F.col("text")).alias("n_tokens")) if ranks is None else _encoded(documents, ranks, pattern, False)
    return _place(materialize(counted, "pack-lengths"), buckets, token_budget)


def lay_out(documents: DataFrame, ranks: dict[bytes, int], buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, pattern: str = PATTERN) -> DataFrame:
    """The rows of ``pack`` on token ids with ``ids``: the sequence's ids, zeros up to the boundary, little endian.

    A batch's rows, by position, are the lines of its matrix.
    """
    width = id_width(ranks)
    placed = _place(materialize(_encoded(documents, ranks, pattern, True), "pack-ids"), buckets, token_budget, ("ids",))
    return placed.withColumn("ids", F.concat("ids", F.unhex(F.repeat(F.lit("00" * width), F.col("padding").cast("int")))))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
