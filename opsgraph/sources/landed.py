"""Readers over landed text, sheets, pages and tables."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import clean_cell, trimmed

DELIMITERS = (",", ";", "\t", "|")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of text files: trimmed, blank lines dropped, numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), trimmed), lambda x: x != "")
    return whole.select("file", F.posexplode(lines).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def detect_delimiter(lines: DataFrame, first: int = 10) -> DataFrame:
    """``file, delimiter``: that which splits the first lines of a file into equally many fields, and the most; else a comma.

    Separators inside double quotes do not count.
    """
    bare = F.regexp_replace("line", '"[^"]*"?', "")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d).alias("sep"), F.size(F.split(bare, "\\|" if d == "|" else d)).alias("n")) for i, d in enumerate(DELIMITERS)]))
    counts = lines.filter(F.col("line_no") <= first).select("file", each.alias("c")).groupBy("file", "c.ord", "c.sep").agg(F.min("c.n").alias("lo"), F.max("c.n").alias("hi"))
    fits = (F.col("lo") == F.col("hi")) & (F.col("lo") > 1)
    best = F.max_by(F.when(fits, F.col("sep")), F.when(fits, F.struct("lo", -F.col("ord"))))
    return counts.groupBy("file").agg(F.coalesce(best, F.lit(",")).alias("delimiter"))


def scan_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Rows of one delimited file, all columns text, under the cleaned header names; an empty file or blank name is an error."""
    if delimiter is None:
        found = detect_delimiter(read_lines(spark, path)).first()
        if found is None:
            raise ValueError("the file is empty")
        delimiter = found["delimiter"]
    raw = spark.read.csv(path, sep=delimiter, header=False, inferSchema=False, mode="PERMISSIVE", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    head = raw.limit(1).select(*[clean_cell(F.col(c)).alias(c) for c in raw.columns]).first()
    if head is None:
        raise ValueError("the file is empty")
    if any(not v for v in head):
        raise ValueError("a header name is blank")
    names = list(head)
    data = spark.read.csv(path, sep=delimiter, header=True, schema=T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))]), enforceSchema=True,
                          mode="PERMISSIVE", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    last = {n: i for i, n in enumerate(names)}
    return data.select(*[clean_cell(F.col(f"_c{last[n]}")).alias(n) for n in dict.fromkeys(names)])


def file_heads(spark: SparkSession, path: str, first: int = 10) -> DataFrame:
    """``file, line_no, line``: the first lines of each file that are not blank, trimmed; only first splits are looked at."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), trimmed(F.col("value")).alias("line"))
    order = W.partitionBy("file").orderBy("at")
    return lines.filter("start = 0 AND line <> ''").withColumn("line_no", F.row_number().over(order)).filter(F.col("line_no") <= first).select("file", "line_no", "line")


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, payload``: the rows of all delimited files of a folder, each file by its own delimiter and header.

    ``row_no`` counts the data rows of a file from 1 in their order, ``payload`` maps cleaned header names to
    cleaned cells (of equal names the last counts).  Files of one delimiter and header are one splittable scan.
    A file with a blank header name is an error; empty files have no rows.
    """
    from ..operators.graph import materialize
    from ..operators.ingest import number_rows

    heads = materialize(file_heads(spark, path))
    found = detect_delimiter(heads).join(heads.filter("line_no = 1"), "file")
    groups: dict[tuple, list[str]] = {}
    for r in found.collect():  # a row a file, as many as the listing of the folder holds
        groups.setdefault((r["delimiter"], r["line"]), []).append(r["file"])
    parts = []
    for (delimiter, line), files in groups.items():
        names = [re.sub(r"^[\"']|[\"']$", "", x.strip()).strip() for x in next(csv.reader([line], delimiter=delimiter))]
        if any(not n for n in names):
            raise ValueError(f"a header name is blank in {files[0]}")
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.csv(files, sep=delimiter, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        last = {n: i for i, n in enumerate(names)}
        cells = [x for n, i in last.items() for x in (F.lit(n), clean_cell(F.col(f"_c{i}")))]
        parts.append(rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.create_map(*cells).alias("payload")).withColumn("__at", F.monotonically_increasing_id()))
    if not parts:
        return spark.createDataFrame([], "file string, row_no long, payload map<string,string>")
    return number_rows(reduce(DataFrame.unionByName, parts), ["file"], ["__start", "__at"], "row_no").select("file", "row_no", "payload")


def sheet_inventory(rows: DataFrame) -> DataFrame:
    """Row and column counts per ``file, sheet`` of landed sheet rows with a ``payload`` map."""
    return rows.groupBy("file", "sheet").agg(F.min("sheet_pos").alias("sheet_pos"), F.count(F.lit(1)).alias("row_count"), F.max(F.size(F.map_keys("payload"))).alias("column_count"))


def select_sheet(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """The rows of the named sheet, or of the first; an unknown one is an error that lists the first names, so is an empty one.

    A sheet without rows stands as one row whose ``payload`` is null.
    """
    found = sheet_inventory(rows).groupBy("sheet").agg(F.min("sheet_pos").alias("p"), F.max("column_count").alias("n"))
    chosen = found.orderBy("p").limit(1) if sheet is None else found.filter(F.col("sheet") == sheet)
    row = chosen.first()
    if row is None:
        raise ValueError(f"no sheet {sheet!r}; there are {[r[0] for r in found.orderBy('p').limit(20).collect()]}")
    if not row["n"] or row["n"] < 1:
        raise ValueError(f"sheet {row['sheet']!r} is empty")
    return rows.filter((F.col("sheet") == row["sheet"]) & F.col("payload").isNotNull())


def incremental_read(table: DataFrame, column: str, cursor=None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows after the cursor in order, at most 1000 (100 by default), and the next cursor as a one-row table."""
    rows = table if cursor is None else table.filter(F.col(column) > F.lit(cursor))
    rows = rows.orderBy(column).limit(min(limit or 100, 1000))
    return rows, rows.agg(F.max(column).alias("next_cursor"))


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, data_type, nullable, column_count, row_count`` of named tables."""
    parts = []
    for name, df in tables.items():
        fields = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable")) for f in df.schema])
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), F.explode(fields).alias("c"), F.lit(len(df.columns)).alias("column_count"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "c.column_name", "c.data_type", "c.nullable", "column_count", "row_count")


def extract_records(pages: DataFrame, path: str | None = None, body: str = "body") -> DataFrame:
    """Add ``records`` (JSON texts of the objects under a dot path) and ``failed`` to landed JSON bodies.

    An array gives its objects, an object itself, a null body nothing; a missing
    segment or a scalar fails.
    """
    parsed = F.try_parse_json(F.col(body))
    at = F.to_json(F.try_variant_get(parsed, "$" + "".join(f".{p}" for p in path.split(".")) if path else "$", "variant"))
    kind = F.substring(at, 1, 1)
    items = F.filter(F.from_json(at, "array<string>"), lambda x: x.startswith("{"))
    records = F.when(F.col(body).isNull() | (trimmed(F.col(body)) == "null"), F.array().cast("array<string>")).when(kind == "[", items).when(kind == "{", F.array(at))
    return pages.withColumn("records", F.coalesce(records, F.array().cast("array<string>"))).withColumn("failed", records.isNull())


def accept_pages(pages: DataFrame, page_size: int = 50, max_pages: int = 1, count: str = "n") -> DataFrame:
    """Of each source, pages 1 .. max_pages up to and including the first short or empty one."""
    short = (F.coalesce(F.col(count), F.lit(0)) < page_size).cast("int")
    before = W.partitionBy("source").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    return pages.filter(F.col("page").between(1, max_pages)).withColumn("__s", F.max(short).over(before)).filter(F.coalesce("__s", F.lit(0)) == 0).drop("__s")


def page_checksum(rows: DataFrame, order: list[str], limit: int = 1000) -> DataFrame:
    """``n, checksum``: SHA-256 over the JSON array of a page of rows, at most ``limit``, in their order."""
    page = rows.orderBy(*order).limit(limit)
    line = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*rows.columns)).alias("json"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["json"])
    return page.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), 256).alias("checksum"))


def content_checksum(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
