import pytest
from opsgraph.functions import text as X
from opsgraph.sources import landed, sinks
from pyspark.sql import functions as F


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_files(spark, tmp_path, sep):
    path = write(tmp_path, "a.csv", sep.join(["id", '"note"', "qty"]) + "\n" + sep.join(["1", f'"x{sep} y"', "3"]) + "\n\n" + sep.join(["2", "'z'"]) + "\n" + sep.join(["3", "w", "5", "extra"]) + "\n")
    assert landed.detect_delimiter(landed.read_lines(spark, path)).first()["delimiter"] in (sep, ",")
    got = landed.scan_delimited(spark, path, sep).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", f"x{sep} y", "3"), ("2", "z", None), ("3", "w", "5")]


def test_detect_delimiter_on_even_rows(spark, tmp_path):
    path = write(tmp_path, "b.txt", 'a;b;"c;d"\n1;2;3\n')
    assert landed.detect_delimiter(landed.read_lines(spark, path)).first()["delimiter"] == ";"


def test_empty_file_and_blank_header_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        landed.scan_delimited(spark, write(tmp_path, "e.csv", ""))
    with pytest.raises(ValueError):
        landed.scan_delimited(spark, write(tmp_path, "h.csv", "a,,c\n1,2,3\n"), ",")


def test_sheets(spark):
    rows = spark.createDataFrame([("f", "S1", 0, 1, {"a": "1", "b": "2"}), ("f", "S1", 0, 2, {"a": "1"}), ("f", "S2", 1, 1, {"x": "1"})], "file string, sheet string, sheet_pos int, row_index long, payload map<string,string>")
    got = {r["sheet"]: (r["row_count"], r["column_count"]) for r in landed.sheet_inventory(rows).collect()}
    assert got == {"S1": (2, 2), "S2": (1, 1)}
    assert landed.select_sheet(rows).count() == 2 and landed.select_sheet(rows, "S2").count() == 1
    with pytest.raises(ValueError, match="S1"):
        landed.select_sheet(rows, "nope")
    empty = spark.createDataFrame([("f", "S0", 0, 1, None)], rows.schema)
    with pytest.raises(ValueError, match="S0.*empty"):
        landed.select_sheet(empty.unionByName(rows), "S0")


def test_page_checksum(spark):
    import hashlib

    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id int, v string")
    got = landed.page_checksum(df, ["id"], 2).first()
    assert (got["n"], got["checksum"]) == (2, hashlib.sha256(b'[{"id":1,"v":"a"},{"id":2,"v":"b"}]').hexdigest())
    assert landed.page_checksum(df.limit(0), ["id"]).first()["checksum"] == hashlib.sha256(b"[]").hexdigest()


def test_jobs(spark):
    asked = spark.createDataFrame([("t", "s", "CSV", "me")], "tenant_id string, data_source_id string, source_type string, initiated_by string")
    jobs = sinks.open_jobs(asked, "2024-01-01 00:00:00")
    job = jobs.first()
    assert (job["status"], job["total_records"]) == ("PROCESSING", 0)
    updates = spark.createDataFrame([(job["id"], 1, "PARTIAL", 5), (job["id"], 2, None, 7), ("none", 3, "FAILED", 1)], "id string, seq int, status string, total_records long")
    after, unknown = sinks.update_jobs(jobs, updates)
    assert (after.first()["status"], after.first()["total_records"], after.first()["started_at"]) == ("PARTIAL", 7, "2024-01-01 00:00:00") and [r["id"] for r in unknown.collect()] == ["none"]


def test_scan_with_profile_and_dead_letters(spark, tmp_path):
    from opsgraph.operators import ingest

    rows, profile = ingest.scan_profile(spark, write(tmp_path, "p.csv", "id,when\n1,2024-01-01 10:00\n2,2024-01-02 11:00:30\n"), ",")
    assert rows.count() == 2 and {r["column_name"]: r["inferred_type"] for r in profile.collect()} == {"id": "INTEGER", "when": "TIMESTAMP"}
    letters = spark.createDataFrame([("t", "a", False)], "tenant_id string, id string, resolved boolean")
    after, found = ingest.resolve_dead_letter(letters, "t", "a")
    assert after.first()["resolved"] and found.first()["found"]
    assert not ingest.resolve_dead_letter(letters, "u", "a")[1].first()["found"]


def test_number_rows_spreads_a_hot_group(spark):
    from opsgraph.operators import ingest

    df = spark.range(500).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.when(F.col("id") % 2 > 0, "cold")).alias("g"), (F.lit(1000) - F.col("id")).alias("o"))
    got = ingest.number_rows(df, ["g"], ["o"]).collect()
    for g in ("hot", "cold", None):
        mine = sorted((r["o"], r["row_index"]) for r in got if r["g"] == g)
        assert len(mine) and [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_extract_records(spark):
    rows = spark.createDataFrame([(1, '{"data":{"items":[{"id":1},{"id":2},3]}}'), (2, None), (3, '{"data":{}}'), (4, '{"data":{"items":{"a":1}}}'), (5, "nonsense")], "n int, body string")
    got = {r["n"]: (len(r["records"]), r["failed"]) for r in landed.extract_records(rows, "data.items").collect()}
    assert got == {1: (2, False), 2: (0, False), 3: (0, True), 4: (1, False), 5: (0, True)}
    assert len(landed.extract_records(spark.createDataFrame([('[{"code":1},{"code":2}]',)], "body string")).first()["records"]) == 2


def test_checksum_and_describe(spark, tmp_path):
    import hashlib

    path = write(tmp_path, "c.bin", "hello")
    assert landed.content_checksum(spark, path).first()["sha256"] == hashlib.sha256(b"hello").hexdigest()
    got = landed.describe_tables({"t": spark.range(3).withColumn("x", F.lit("a"))}).collect()
    assert [(r["column_name"], r["data_type"], r["column_count"], r["row_count"]) for r in got] == [("id", "bigint", 2, 3), ("x", "string", 2, 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", "a", 1, 1), ("t2", "b", 1, 1)], "tenant_id string, id string, version int, v int")
    sinks.append_partitioned(df, str(tmp_path / "o"))
    sinks.append_partitioned(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).filter("tenant_id = 't1'").count() == 2
    new = spark.createDataFrame([("t1", "a", 1, 9), ("t3", "c", 1, 5)], df.schema)
    assert {(r["id"], r["v"]) for r in sinks.upsert(df, new, ["tenant_id", "id"], ["version"]).collect()} == {("a", 9), ("b", 1), ("c", 5)}
    assert sinks.delete_tenant(df, "t1").count() == 1
    nameless = spark.createDataFrame([(None, "c", 1, 1)], df.schema)
    assert sinks.delete_tenant(df.unionByName(nameless), "t1").count() == 2


def test_scalars(spark):
    kinds = spark.createDataFrame([(v,) for v in ("12", "-1.5", "YES", "2024-01-01T10:00:00Z", "2024-01-01 10:00", "2024-13-45 99:99", "2024-01-01", '{"a":1}', "{bad", "x", "", None)], "v string").select(X.infer_type(F.col("v"))).collect()
    assert [r[0] for r in kinds] == ["INTEGER", "FLOAT", "BOOLEAN", "TIMESTAMP", "TIMESTAMP", "STRING", "STRING", "JSON", "STRING", "STRING", "STRING", "STRING"]
    row = spark.createDataFrame([("Max Pressure: 250 bar\nE-4012 e-4012 ALM-101", " Spindle A ", "spindle b", "a-b - c/d")], "t string, x string, y string, q string").select(
        X.error_codes(F.col("t")).alias("codes"), X.tech_specs(F.col("t")).alias("specs"), X.name_similarity(F.col("x"), F.col("y")).alias("sim"), X.bm25_tokens(F.col("q")).alias("tokens"),
        X.table_cells(F.array(F.lit("| a | b |"), F.lit("|---|:-:|"), F.lit("no"))).alias("cells"), X.external_id(F.create_map(F.lit("id"), F.lit("0"), F.lit("sku"), F.lit("S")), F.lit(4)).alias("ext")).first()
    assert row["codes"] == ["E-4012", "ALM-101"] and row["specs"] == {"Max Pressure": "250 bar"}
    assert abs(row["sim"] - (1 - 1 / 9)) < 1e-9 and row["tokens"] == ["a-b", "ab", "-", "", "c/d"]
    assert row["cells"] == [["a", "b"]] and row["ext"] == "S"
