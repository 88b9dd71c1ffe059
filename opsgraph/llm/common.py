"""Helpers shared by the corpus operators: tables, materialisation, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``; Arrow batches are kept small for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and its master is local (tests on one machine) is a
    local temporary folder taken and set; on a cluster that is an error.  What is written
    there belongs to the session: readers of lazy results need it, so nothing is deleted here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opsgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """A hash of a document's id and text: rows of one id with other texts have other keys."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    """Buckets so that each holds about ``per_bucket`` rows."""
    return max(1, -(-rows // per_bucket))


def rank_in_group(df: DataFrame, group: list[str], order: list, salt, buckets: int, name: str) -> DataFrame:
    """Gapless rank from 0 of each row inside its group, in two levels.

    ``salt`` is a non-negative number that is monotone in nothing in
    particular: rows are ranked inside ``(group, salt % buckets)`` and the
    buckets' sizes, summed up per group, give each bucket's offset.  No task
    holds a whole group, however hot.
    """
    df = df.withColumn("__b", F.pmod(salt, F.lit(buckets)).cast("int"))
    keys = [*group, "__b"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(inner) - 1)
    return ranked.join(offsets, keys).withColumn(name, (F.col("__o") + F.col("__r")).cast("long")).drop("__b", "__o", "__r")
