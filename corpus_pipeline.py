"""The corpus pipeline: documents in, packed training batches out.

Each stage takes what its predecessor kept, as Parquet, and returns the columns
of ``documents`` (the last one the packing).  A stage's other columns are ignored
and nulls, empty texts, repeated rows and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

import uuid

from opsgraph.llm import common, decontaminate, packing, quality, suffix_dedup, superminhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # trained models, groups and byte spans have no SQL form


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fifth."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the least id, once."""
    return superminhash.keep_one(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; one of which nothing is left goes."""
    cut = suffix_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"))
    cut = cut.filter("n_removed = 0 OR kept_text <> ''").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long"))
    return cut.withColumnRenamed("kept_text", "text").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other values."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a padded batch."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("minhash", keep_one_of_each),
    ("suffix", cut_repeats),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
