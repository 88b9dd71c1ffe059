"""Normalising ingestion: validity, duplicates, forbidden keys, profiles, job summaries.

Input rows: ``tenant_id, data_source_id, job_id, row_index, raw_json``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import row_hash
from ..functions.numeric import js_round
from ..functions.text import external_id, infer_type
from ..sources.landed import scan_delimited
from .graph import materialize

JOB = ["tenant_id", "job_id"]


def tag_outcomes(rows: DataFrame, deduplicate: bool = True, id_column: str | None = None) -> DataFrame:
    """Add ``outcome`` (VALID, DUPLICATE, EMPTY_OR_INVALID_ROW, PROTOTYPE_POLLUTION_DETECTED), ``row_hash``, ``bad_key`` and ``external_id``.

    The first of equal rows of a job wins; duplicates are found before forbidden
    keys.  A non-empty array is a valid row.
    """
    keys = F.json_object_keys("raw_json")
    filled = (F.size(keys) > 0) | (F.coalesce(F.json_array_length("raw_json"), F.lit(0)) > 0)
    rows = rows.withColumn("__ok", F.coalesce(filled, F.lit(False))).withColumn("row_hash", row_hash(F.col("raw_json")))
    rows = rows.withColumn("bad_key", F.get(F.filter(keys, lambda k: k.startswith("__proto__") | (k == "constructor")), 0))
    if deduplicate:
        # only the first place of each hash is shuffled back, not a window over all rows of a hot hash
        first = rows.filter("__ok").groupBy(*JOB, "row_hash").agg(F.min("row_index").alias("__first"))
        rows = rows.join(first, [*JOB, "row_hash"], "left")
    else:
        rows = rows.withColumn("__first", F.col("row_index"))
    payload = F.from_json("raw_json", "map<string,string>")
    outcome = (F.when(~F.col("__ok"), "EMPTY_OR_INVALID_ROW").when(F.col("row_index") > F.col("__first"), "DUPLICATE")
               .when(F.col("bad_key").isNotNull(), "PROTOTYPE_POLLUTION_DETECTED").otherwise("VALID"))
    return rows.withColumn("outcome", outcome).withColumn("external_id", external_id(payload, F.col("row_index"), id_column)).drop("__ok", "__first")


def normalized(tagged: DataFrame, entity_type: str = "INDUSTRIAL_RECORD", version: str = "1.0.0") -> DataFrame:
    return tagged.filter("outcome = 'VALID'").select(*JOB, "data_source_id", "row_index", "external_id", F.lit(entity_type).alias("entity_type"), F.lit(version).alias("schema_version"),
                                                    F.from_json("raw_json", "map<string,string>").alias("payload"), F.col("row_hash").alias("row_checksum"))


def dead_letters(tagged: DataFrame) -> DataFrame:
    message = F.when(F.col("outcome") == "EMPTY_OR_INVALID_ROW", "Row is empty, null or not an object").otherwise(F.concat(F.lit("Forbidden key: "), F.col("bad_key")))
    return tagged.filter("outcome NOT IN ('VALID', 'DUPLICATE')").select(
        F.sha2(F.concat_ws("|", "tenant_id", "job_id", F.col("row_index").cast("string")), 256).alias("id"), *JOB, "data_source_id", "row_index", F.col("raw_json").alias("raw_row"),
        F.col("outcome").alias("error_code"), message.alias("error_message"), F.lit(False).alias("resolved"))


def job_summary(tagged: DataFrame) -> DataFrame:
    """One row per job: counts and COMPLETED (nothing in the dead-letter queue), FAILED (nothing else) or PARTIAL."""
    n = lambda *o: F.sum(F.col("outcome").isin(*o).cast("long"))
    out = tagged.groupBy(*JOB).agg(F.count(F.lit(1)).alias("total_rows"), n("VALID").alias("valid_rows"), n("DUPLICATE").alias("duplicate_rows"),
                                   n("EMPTY_OR_INVALID_ROW", "PROTOTYPE_POLLUTION_DETECTED").alias("error_rows"))
    return out.withColumn("status", job_status())


def job_status() -> Column:
    return F.when(F.col("error_rows") == 0, "COMPLETED").when(F.col("valid_rows") > 0, "PARTIAL").otherwise("FAILED")


def finish_jobs(jobs: DataFrame, tagged: DataFrame, finished: str) -> DataFrame:
    """Job rows (``tenant_id, id, started_at, ...``) with their counts, status, ``duration_ms`` (1 at least) and ``records_per_second``."""
    n = job_summary(tagged).select("tenant_id", F.col("job_id").alias("id"), "total_rows", "valid_rows", "error_rows", "duplicate_rows", F.col("status").alias("__s"))
    both = jobs.join(n, ["tenant_id", "id"], "left")
    micros = F.unix_micros(F.lit(finished).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = both.withColumns({"total_records": zero("total_rows"), "valid_records": zero("valid_rows"), "error_records": zero("error_rows"), "duplicate_records": zero("duplicate_rows"),
                            "duration_ms": F.greatest(F.floor(micros / 1000), F.lit(1)).cast("long"), "status": F.coalesce("__s", F.lit("COMPLETED")), "completed_at": F.lit(finished)})
    return out.withColumn("records_per_second", js_round(F.col("valid_records") / (F.col("duration_ms") / 1000), 2)).drop("total_rows", "valid_rows", "error_rows", "duplicate_rows", "__s")


def number_rows(rows: DataFrame, group: list[str], order: list[str], name: str = "row_index") -> DataFrame:
    """Number rows that come without an index from 1 inside each group, by ``order``.

    Rows are sorted by ranges, so a large group spreads over many tasks; each range's
    rows are numbered apart and the sizes of the ranges before are added.
    """
    ranged = materialize(rows.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    numbered = ranged.withColumn(name, F.row_number().over(W.partitionBy(*group, "__p").orderBy(*order)))
    same = F.col("__p") == F.col("__q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return numbered.join(offsets, same).withColumn(name, (F.col(name) + F.col("__o")).cast("long")).drop("__p", "__q", "__o", *[f"__g{i}" for i in range(len(group))])


def resolve_dead_letter(letters: DataFrame, tenant: str, item: str) -> tuple[DataFrame, DataFrame]:
    """The letters with that one resolved, and one row ``found``."""
    this = (F.col("tenant_id") == tenant) & (F.col("id") == item)
    return letters.withColumn("resolved", F.when(this, True).otherwise(F.col("resolved"))), letters.agg(F.coalesce(F.bool_or(this), F.lit(False)).alias("found"))


def scan_profile(spark, path: str, delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a delimited file, with their place ``row_no`` in the file, and the profile of its columns."""
    rows = scan_delimited(spark, path, delimiter).withColumn("row_no", F.monotonically_increasing_id())
    return rows, profile_columns(rows, "row_no")


def profile_columns(rows: DataFrame, order: str, samples: int = 5, approximate: bool = False) -> DataFrame:
    """Per column: resolved type, nullable, distinct values, the first samples, and whether it is constant over more than 5 rows.

    ``order`` (a row number) is not profiled.  Equal cells of a column are counted inside the tasks first, so a
    value is typed once and not once a row; ``approximate`` counts distinct values by a sketch, then no value leaves its task.
    """
    names = [c for c in rows.columns if c != order]
    cell = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), cell(c).alias("value")) for c in names])).alias("x")).select("x.*")
    long = long.withColumn("n", F.lit(1).cast("long")) if approximate else long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    has = F.col("value").isNotNull()
    typed = long.withColumn("kind", F.when(has, infer_type(F.col("value"))))
    kinds = ("INTEGER", "FLOAT", "BOOLEAN", "TIMESTAMP", "STRING", "JSON")
    distinct = F.approx_count_distinct("value") if approximate else F.count("value")
    out = typed.groupBy("column_name").agg(*[F.bool_or(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in kinds], F.bool_or(~has).alias("nullable"), distinct.alias("unique_count"), F.sum("n").alias("n_rows"))
    none = ~F.col("STRING")
    resolved = (F.when(F.col("INTEGER") & ~F.col("FLOAT") & none, "INTEGER").when(F.col("FLOAT") & none, "FLOAT").when(F.col("TIMESTAMP") & none, "TIMESTAMP")
                .when(F.col("BOOLEAN") & none, "BOOLEAN").when(F.col("JSON"), "JSON").otherwise("STRING"))
    found = _first_samples(rows, names, order, samples)
    chosen = reduce(lambda e, c: e.when(F.col("column_name") == c, F.array(*[F.lit(v) for v in found[c]]).cast("array<string>")), names, F.when(F.lit(False), F.array().cast("array<string>")))
    return out.select("column_name", resolved.alias("inferred_type"), "nullable", "unique_count", chosen.alias("sample_values"), ((F.col("unique_count") == 1) & (F.col("n_rows") > 5)).alias("is_constant"))


def _first_samples(rows: DataFrame, names: list[str], order: str, samples: int) -> dict[str, list[str]]:
    """The first ``samples`` values of each column, from the first rows by ``order``, or where these lack values from the first rows that have one."""
    text = rows.select(F.col(order).alias("__i"), *[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias(c) for c in names])
    head = text.orderBy("__i").limit(16 * samples).collect()
    out = {c: [r[c] for r in head if r[c] is not None][:samples] for c in names}
    if len(head) == 16 * samples:
        for c in names:
            if len(out[c]) < samples:
                out[c] = [r[0] for r in text.filter(F.col(c).isNotNull()).orderBy("__i").select(c).limit(samples).collect()]
    return out


def preview(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    return rows.orderBy(order).limit(n)
