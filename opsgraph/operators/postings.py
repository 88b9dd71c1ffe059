"""A maintained BM25 index: posting blocks in term buckets, tombstones, additive statistics, top-k by bounds.

Below one folder stand

* ``blocks``: ``tenant_id, term, block, of, entries, most_tf, least_len`` in folders by ``bucket`` (a hash of the term): about
  ``BLOCK`` postings of a term a row, those whose chunk's hash leaves ``block`` modulo ``of``, with the largest frequency
  and the shortest length inside;
* ``lengths``: ``tenant_id, chunk_id, len, chunk_seq``, and ``gone``, the removed ``tenant_id, chunk_id``.

Adding chunks and removing them append rows and rewrite nothing; a chunk's id is used once.  ``compact`` writes a
new folder without what is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.text import bm25_tokens
from .graph import materialize
from .search import count_terms, postings_of, rank_hits

BLOCK = 128
BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


_SCHEMA = "tenant_id string, term string, of bigint, block bigint, bucket int, entries array<struct<chunk_id: string, tf: bigint, len: int>>, most_tf bigint, least_len int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows ``tenant_id, term, of, block, bucket, chunk_id, tf, len`` of one block as one row; the last block of a batch waits for the next."""
    rest = None
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks().to_batches() if batch is not None or rest is not None else []
        if not rows:
            continue
        rows, = rows
        new = np.zeros(len(rows), bool)
        new[0] = True
        for i in range(4):
            c = rows.column(i)
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        stop = len(rows) if batch is None else int(starts[-1])
        rest = None if batch is None else rows.slice(stop)
        if not stop:
            continue
        rows, starts = rows.slice(0, stop), starts[starts < stop]
        chunk, tf, length = (rows.column(i) for i in (5, 6, 7))
        entries = pa.StructArray.from_arrays([chunk, tf, length], names=["chunk_id", "tf", "len"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, stop), pa.int32()), entries)
        most, least = np.maximum.reduceat(tf.to_numpy(), starts), np.minimum.reduceat(length.to_numpy(), starts)
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([*(rows.column(i).take(at) for i in range(5)), lists, pa.array(most), pa.array(least)], names=["tenant_id", "term", "of", "block", "bucket", "entries", "most_tf", "least_len"])


def _write(postings: DataFrame, lengths: DataFrame, path: str, block: int, buckets: int) -> None:
    """Append ``postings(tenant_id, term, chunk_id, tf, len)``: they are shuffled once, to their blocks."""
    postings = postings.filter("term IS NOT NULL")
    # a term's postings are dealt to as many blocks as its number asks for, so a frequent term is many rows; only frequent terms are joined
    df = postings.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("df"))
    frequent = materialize(df.filter(F.col("df") > block).select("tenant_id", "term", F.ceil(F.col("df") / block).alias("of")))
    dealt = postings.join(frequent, ["tenant_id", "term"], "left").withColumn("of", F.coalesce("of", F.lit(1).cast("bigint"))).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("of")))
    dealt = dealt.withColumn("bucket", _bucket(buckets)).withColumn("h", F.xxhash64("tenant_id", "term", "of", "block"))
    # a task gets about eight parts of buckets and writes a file for each; the rows of a block are neighbours by one number
    parts = max(1, 8 * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    near = dealt.repartition("bucket", F.pmod("h", F.lit(parts))).sortWithinPartitions(F.shiftleft(F.col("bucket").cast("bigint"), 48).bitwiseOR(F.shiftrightunsigned("h", 16)))
    rows = near.select("tenant_id", "term", "of", "block", "bucket", "chunk_id", F.col("tf").cast("bigint").alias("tf"), F.col("len").cast("int").alias("len")).mapInArrow(_blocks, _SCHEMA)
    rows.write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")
    lengths.write.mode("append").parquet(f"{path}/lengths")


def add_chunks(chunks: DataFrame, path: str, block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Append new chunks to the index below ``path``."""
    counted = count_terms(chunks, keep=("chunk_seq",))
    _write(postings_of(counted, "len"), counted.select("tenant_id", "chunk_id", "len", "chunk_seq"), path, block, buckets)


def remove_chunks(gone: DataFrame, path: str) -> None:
    """Remove ``gone(tenant_id, chunk_id)``: tombstones only."""
    gone.select("tenant_id", "chunk_id").distinct().write.mode("append").parquet(f"{path}/gone")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, live lengths and tombstones; a folder without tombstones has none."""
    lengths = spark.read.parquet(f"{path}/lengths")
    none = lengths.select("tenant_id", "chunk_id").limit(0)
    try:
        gone = spark.read.schema(none.schema).parquet(f"{path}/gone").distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        gone = none
    return spark.read.parquet(f"{path}/blocks"), lengths.join(gone, ["tenant_id", "chunk_id"], "left_anti"), gone


def compact(spark: SparkSession, path: str, to: str, block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Write the live part of an index as a new one."""
    blocks, lengths, gone = _read(spark, path)
    postings = blocks.select("tenant_id", "term", F.explode("entries").alias("e")).select("tenant_id", "term", "e.*").join(gone, ["tenant_id", "chunk_id"], "left_anti")
    _write(materialize(postings), materialize(lengths), to, block, buckets)


def search_index(spark: SparkSession, queries: DataFrame, path: str, k: int = 10, buckets: int = BUCKETS, bounds: bool = True) -> tuple[DataFrame, DataFrame]:
    """``tenant_id, query_id, chunk_id, score, rank`` of the first k hits by words, and what was read: ``blocks`` and ``skipped`` a query.

    Each query first scores the chunks of its rarest term; the k-th of these scores is one that the k-th hit surely
    reaches.  A chunk without that term is at most worth its block's best posting and the best of the other terms: where
    that stays below, the block is opened only if a chunk of the rarest term that can still be a hit lies in it, which
    its hash tells.  The result equals that of full scoring.
    """
    blocks, lengths, gone = _read(spark, path)
    terms = queries.select("tenant_id", "query_id", F.posexplode(bm25_tokens(F.col("query"))).alias("p", "term")).groupBy("tenant_id", "query_id", "term").agg(F.count(F.lit(1)).alias("times"), F.min("p").alias("first"))
    terms = materialize(terms.withColumn("bucket", _bucket(buckets)))
    wanted = [r[0] for r in terms.select("bucket").distinct().collect()]  # at most as many as there are buckets
    own = materialize(blocks.filter(F.col("bucket").isin(wanted)).join(terms.select("tenant_id", "term").distinct(), ["tenant_id", "term"], "left_semi").withColumn("at", F.monotonically_increasing_id()))
    entry = own.select("at", "tenant_id", "term", F.explode("entries").alias("e")).select("at", "tenant_id", "term", "e.*").join(gone, ["tenant_id", "chunk_id"], "left_anti")
    df = materialize(entry.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("df")))
    stats = materialize(lengths.groupBy("tenant_id").agg(F.avg("len").alias("mean"), F.count(F.lit(1)).alias("n")))
    asked = materialize(terms.drop("bucket").join(df, ["tenant_id", "term"]).join(stats, "tenant_id"))
    part = lambda tf, length: N.bm25_term(tf, F.greatest(length, F.lit(1)), F.col("mean"), F.col("n"), F.col("df")) * F.col("times")
    query = ["tenant_id", "query_id"]
    bound = materialize(own.select("at", "tenant_id", "term", "of", "block", "most_tf", "least_len").join(asked, ["tenant_id", "term"]).select(*query, "term", "at", "of", "block", "df", part(F.col("most_tf"), F.col("least_len")).alias("most")))
    tops = bound.groupBy(*query, "term").agg(F.max("most").alias("top"), F.min("df").alias("df"))
    sums = tops.groupBy(*query).agg(F.sum("top").alias("all"), F.min_by("term", F.struct("df", "term")).alias("rarest"))

    def scored(some: DataFrame) -> DataFrame:
        """Sums over the postings of the blocks ``(tenant_id, query_id, term, at)``."""
        rows = some.join(entry, ["tenant_id", "term", "at"]).join(asked, [*query, "term"])
        return rows.groupBy(*query, "chunk_id").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("s"), F.min("first").alias("first"))

    chosen = bound.select(*query, "term", "at")
    if bounds:
        slack = 0.0101  # scores are rounded to two digits before ranking
        sums = materialize(sums.join(tops.select(*query, F.col("term").alias("rarest"), F.col("top").alias("top_rarest")), [*query, "rarest"]))
        own_blocks = bound.join(sums, query).filter("term = rarest").select(*query, "term", "at")
        first = materialize(scored(own_blocks))
        kth = rank_hits(first, {"s": -F.col("s"), "id": F.col("chunk_id")}, k).filter(F.col("rank") == k).select(*query, F.col("s").alias("sure"))
        sums = materialize(sums.join(kth, query, "left"))
        judged = bound.join(tops.select(*query, "term", "top"), [*query, "term"]).join(sums, query)
        reach = F.col("most") + F.col("all") - F.col("top") - F.col("top_rarest") + slack >= F.col("sure")
        opened = judged.filter((F.col("term") == F.col("rarest")) | F.coalesce(reach, F.lit(True))).select(*query, "term", "at")
        alive = first.join(sums, query).filter(F.coalesce(F.col("s") + F.col("all") - F.col("top_rarest") + slack >= F.col("sure"), F.lit(True))).select(*query, "rarest", F.xxhash64("chunk_id").alias("h"))
        cells = bound.select(*query, "term", "of").distinct()
        places = alive.join(cells, query).filter("term <> rarest").select(*query, "term", "of", F.expr("pmod(h, of)").alias("block")).distinct()
        probed = bound.join(places, [*query, "term", "of", "block"]).select(*query, "term", "at")
        chosen = materialize(opened.unionByName(probed).distinct())
    hits = scored(chosen).withColumn("score", N.js_round(F.col("s"), 2)).filter("score > 0").join(lengths.select("tenant_id", "chunk_id", "chunk_seq"), ["tenant_id", "chunk_id"])
    ranked = rank_hits(hits, {"score": -F.col("score"), "first": F.col("first"), "seq": F.col("chunk_seq")}, k).select(*query, "chunk_id", "score", "rank")
    opened = chosen.groupBy(*query).agg(F.count(F.lit(1)).alias("opened"))
    read = bound.groupBy(*query).agg(F.count(F.lit(1)).alias("blocks")).join(opened, query, "left").select(*query, "blocks", (F.col("blocks") - F.coalesce("opened", F.lit(0))).alias("skipped"))
    return ranked, read
