"""Writers and table maintenance; each write is one Spark job of append or overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import audit_checksum


def append_partitioned(df: DataFrame, path: str) -> None:
    """Append rows below one folder per tenant."""
    df.write.mode("append").partitionBy("tenant_id").parquet(path)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace by key, the later by ``order``; a change wins over a stored row of the same order."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest_by_key(both, keys, [*order, "__new"]).drop("__new")


def delete_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """All rows but those of a tenant; rows without tenant stay."""
    return df.filter(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def stamp_audit(entries: DataFrame, key: str, now: str | None = None) -> DataFrame:
    """Audit rows with their checksum, ready to append; ``now`` is the time of rows that have none."""
    if now is not None:
        have = F.col("timestamp") if "timestamp" in entries.columns else F.lit(None).cast("string")
        entries = entries.withColumn("timestamp", F.coalesce(have, F.lit(now)))
    return entries.withColumn("checksum", audit_checksum(key))


def export_audit(logs: DataFrame, limit: int = 5000) -> DataFrame:
    """The newest rows, each with the total count and the algorithm's name."""
    total = logs.agg(F.count(F.lit(1)).alias("total"))
    newest = logs.orderBy(F.desc("timestamp"), "id").limit(limit)
    return newest.crossJoin(F.broadcast(total)).withColumn("algorithm", F.lit("HMAC-SHA256"))


def register_sources(current: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The source table with new rows (``tenant_id, name, kind``), their ids derived from tenant and name."""
    rows = new.withColumn("id", F.sha2(F.concat_ws("|", "tenant_id", "name"), 256)).withColumn("created_at", F.lit(now))
    return current.unionByName(rows.join(current.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti"), allowMissingColumns=True)


JOB_COUNTS = ("total_records", "valid_records", "error_records", "duplicate_records", "duration_ms")


def open_jobs(requests: DataFrame, now: str) -> DataFrame:
    """Job rows of ``requests(tenant_id, data_source_id, source_type, initiated_by)``: PROCESSING, with zero counts and derived ids."""
    rows = requests.withColumn("id", F.concat(F.lit("job_"), F.substring(F.sha2(F.concat_ws("|", "tenant_id", "data_source_id", "source_type", "initiated_by", F.lit(now)), 256), 1, 16)))
    return rows.withColumns({"status": F.lit("PROCESSING"), **{c: F.lit(0).cast("long") for c in JOB_COUNTS}, "started_at": F.lit(now), "completed_at": F.lit(None).cast("string")})


def update_jobs(jobs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after ``updates(tenant_id, id, seq, ...)``, the last by ``seq`` winning column by column, and the updates of unknown jobs.

    A column that an update leaves null keeps its value.  Updates without a tenant column go by the id alone.
    """
    key = [c for c in ("tenant_id", "id") if c in updates.columns]
    given = [c for c in updates.columns if c in jobs.columns and c not in key]
    last = updates.groupBy(*key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in given])
    after = jobs.join(last, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in given else F.col(c) for c in jobs.columns])
    return after, updates.join(jobs.select(*key), key, "left_anti")


def ingest_documents(documents: DataFrame, path: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Chunk documents, embed and index the chunks, append all below one folder, and give the chunks written.

    Chunks are written once and read back, so that text is cut and hashed once.
    """
    from ..operators import search

    spark = documents.sparkSession
    chunks = search.embed_chunks(search.chunk_documents(documents, dictionary=dictionary))
    folder = f"{path}/staged-{uuid.uuid4().hex}"
    chunks.write.parquet(folder)
    chunks = spark.read.schema(chunks.schema).parquet(folder)
    postings, lengths = search.bm25_index(chunks)
    for name, df in (("chunks", chunks), ("postings", postings), ("lengths", lengths)):
        append_partitioned(df, f"{path}/{name}")
    return chunks
