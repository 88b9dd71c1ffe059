"""Tenant filters, pages, latest rows, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant)


def page(df: DataFrame, time: str, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Newest first; no limit, or 0, means 50.  ``total`` carries the count before paging."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(F.desc(time), key).offset(offset).limit(limit or 50).crossJoin(F.broadcast(total))


def latest_n(df: DataFrame, time: str, n: int = 50, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), key).limit(n)


def filter_audit(logs: DataFrame, actor: str | None = None, action: str | None = None, status: str | None = None) -> DataFrame:
    if actor:
        logs = logs.filter(F.col("actor_id") == actor)
    if action:
        logs = logs.filter(F.lower("action").contains(action.lower()))
    return logs.filter(F.col("status") == status) if status else logs


def filter_records(records: DataFrame, entity_type: str | None = None, source: str | None = None) -> DataFrame:
    if entity_type:
        records = records.filter(F.lower("entity_type") == entity_type.lower())
    return records.filter(F.col("data_source_id") == source) if source else records


def list_nodes(nodes: DataFrame, tenant: str, entity_type: str | None = None) -> DataFrame:
    nodes = for_tenant(nodes, tenant)
    return nodes.filter(F.col("entity_type") == entity_type) if entity_type else nodes


def find_by_canonical(nodes: DataFrame, tenant: str, canonical: str, order: str = "seq") -> DataFrame:
    """The first node by insertion whose canonical id matches, ignoring case."""
    return for_tenant(nodes, tenant).filter(F.lower("canonical_id") == canonical.lower()).orderBy(order).limit(1)


def duplicate_keys(df: DataFrame, column: str, trim: bool = True) -> DataFrame:
    """Keys, lower-cased (and trimmed), that more than one row holds."""
    key = F.lower(F.trim(column) if trim else F.col(column))
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def drop_secrets(users: DataFrame) -> DataFrame:
    return users.drop("password_hash", "salt")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts_by_tenant(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def recent_actions(logs: DataFrame, n: int = 5) -> DataFrame:
    """The newest audit actions of each tenant."""
    return top_per_group(logs, ["tenant_id"], [F.desc("timestamp"), F.asc("id")], n)


def chunks_of_document(chunks: DataFrame, document: str) -> DataFrame:
    return chunks.filter(F.col("document_id") == document).orderBy("chunk_index")


def documents_of_tenant(documents: DataFrame, chunks: DataFrame, tenant: str) -> DataFrame:
    """A tenant's documents with their number of chunks."""
    n = chunks.groupBy("tenant_id", F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return for_tenant(documents, tenant).join(n, ["tenant_id", "id"], "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def get_by_id(df: DataFrame, tenant: str, item: str, key: str = "id") -> DataFrame:
    """One source, proposal or other row of a tenant."""
    return for_tenant(df, tenant).filter(F.col(key) == item)
