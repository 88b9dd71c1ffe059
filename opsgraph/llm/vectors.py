"""Integer forms of vectors, shared by the operators on ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BLOCK = 8192


def integer_vectors(embeddings: DataFrame, scale: int, offset: int, limit: int, vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, label, x array<long>`` with x = floor(scale * c) + offset, written once, and the vectors' length.

    Rows whose vector is null, empty or holds null or non-finite components go, and so do vectors
    whose length is not the most common one (of equally common ones the shortest).  scale * c
    is held within ``limit`` on either side, so that later sums stay whole numbers.
    """
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(vector).cast("array<double>").alias("c")).filter("size(c) > 0")
    schema = rows.select("vec_id", "label").schema.add("x", T.ArrayType(T.LongType())).add("d", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = np.diff(column.offsets.to_numpy())
            if not len(size):
                continue
            values = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(size)])
            keep = np.logical_and.reduceat(np.isfinite(values), starts[:-1])
            flat = values[np.repeat(keep, size)]
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(scale * flat, -limit, limit)).astype(np.int64) + offset
            size = size[keep].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(x))
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), lists, pa.array(size)], names=["vec_id", "label", "x", "d"])

    found = materialize(rows.mapInArrow(run, schema), "vectors")
    common = found.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    length = common["d"] if common else 0
    return found.filter(F.col("d") == length).drop("d"), length


def matrix(column, length: int) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, so that matrix products are worth their calls."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
