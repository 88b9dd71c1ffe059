"""What holds only where tables are large: no cut lists, no repeated work, no pairs that counts can replace."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
from conftest import DATA
from opsgraph.functions import hashing
from opsgraph.functions import text as X
from opsgraph.operators import audit, graph, nearest, postings, reason, search
from opsgraph.plans import queries
from opsgraph.plans.adapters import load
from opsgraph.sources import sinks
from opsgraph.streaming import streams
from pyspark.sql import functions as F


def test_all_corrupted_ids_are_listed(spark):
    fields = ("tenant_id", "actor_id", "actor_email", "actor_role", "action", "resource_type", "resource_id", "details", "status", "timestamp")
    logs = spark.range(1200).select(F.format_string("a%04d", "id").alias("id"), *[F.lit("x").alias(c) for c in fields])
    signed = sinks.stamp_audit(logs, "key").withColumn("action", F.lit("changed"))
    row = audit.verify_summary(signed, "key").first()
    assert row["tampered"] == 1200 and row["corrupted_ids"] == [f"a{i:04d}" for i in range(1200)]
    assert audit.verify_summary(signed, "key", listed=7).first()["corrupted_ids"] == [f"a{i:04d}" for i in range(7)]


def test_specs_are_matched_once(spark):
    rows = [("Max Pressure: 5 bar Speed= 700 rpm, x 3:4 bar a: b: 2 V",), ("Max Pressure: 5 bar\nMax Pressure: 7 bar",), ("no spec",), (None,), ("word " * 60_000,), ("Temp: 5 cX = 9 kW Y:3 mm",)]
    df = spark.createDataFrame(rows, "t string")
    specs = X.tech_specs(F.col("t"))
    assert df.select(specs.alias("s"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    plain = r"(?i)([A-Za-z\s]+)[:=]\s*([0-9.]+\s*(?:bar|psi|rpm|mm|m/s|kw|v|vac|vdc|hz|khz|c|°c|celsius|kg|kn))\b"
    want = df.filter("t IS NULL OR length(t) < 1000").select("t", *[F.regexp_extract_all("t", F.lit(plain), F.lit(i)).alias(f"g{i}") for i in (1, 2)]).collect()
    want = {r["t"]: {k.strip(): v.strip() for k, v in zip(r["g1"] or [], r["g2"] or [])} for r in want}
    got = {r["t"]: r["s"] for r in df.select("t", specs.alias("s")).collect()}
    assert got.pop("word " * 60_000) == {} and got == want and got[rows[1][0]] == {"Max Pressure": "7 bar"}


def test_manuals_are_many_tasks_and_bounded_slices(spark):
    assert load(spark, DATA, "manuals").rdd.getNumPartitions() >= 4
    assert list(search._slices([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)] and not list(search._slices([], 10))
    docs = load(spark, DATA, "manuals").limit(40).withColumn("linked_entity_ids", F.array().cast("array<string>"))
    docs = docs.unionByName(docs.limit(1).withColumns({"id": F.lit("none"), "content": F.lit(None).cast("string")})).cache()
    small, large = (sorted(map(str, search.chunk_documents(docs, slice_bytes=n).collect())) for n in (1, 1 << 30))
    assert small == large and len(small) > 40


def test_counts_of_the_connected_equal_their_lists(spark):
    """A graph with cycles, several hubs a root, roots alone, missing ends and other times."""
    rng = random.Random(5)
    kinds = ["WorkOrder", "Sensor", "Line", "Batch", "MaintenanceOrder", "Plant"]
    nodes = [(f"t{i % 2}", f"n{i}", rng.choice(kinds), "C", f"name {i}", f"c{i}", i) for i in range(160)]
    ends = [(t, f"n{rng.choice([t, t + 2, rng.randrange(176)])}", f"n{rng.randrange(176)}") for t in [0, 1] for _ in range(110)]
    edges = [(f"t{t}", f"e{k}", a, b, "X", datetime(1990 + k % 12, 1, 1), None if k % 3 else datetime(1999, 1, 1), k) for k, (t, a, b) in enumerate(ends)]
    n = spark.createDataFrame(nodes, "tenant_id string, id string, entity_type string, category string, name string, canonical_id string, seq long").cache()
    e = spark.createDataFrame(edges, "tenant_id string, id string, source_id string, target_id string, relation_type string, valid_from timestamp, valid_to timestamp, seq long").cache()
    roots = n.filter("entity_type IN ('WorkOrder', 'Line')").select("tenant_id", F.col("id").alias("root_id")).unionByName(spark.createDataFrame([("t0", "none")], "tenant_id string, root_id string"))
    for as_of in ("1998-01-01 00:00:00", None):
        lists = graph.dossier(roots, n, e, as_of).cache()
        want = {(r["tenant_id"], r["root_id"], r["connected"][0], len(r["connected"])) for r in graph.connected_names(lists).collect()}
        got = [(r["tenant_id"], r["root_id"], r["name"], r["n"]) for r in graph.connected_counts(roots, n, e, as_of).collect()]
        assert len(got) == len(want) and set(got) == want and len({x[3] for x in got}) > 4
        sums = {(r["tenant_id"], r["root_id"], r["plant"], r["n_sensors"], r["n_products"], r["n_maintenance_orders"]) for r in graph.dossier_counts(roots, n, e, as_of).collect()}
        assert sums == {(r["tenant_id"], r["root_id"], r["plant"], len(r["sensors"]), len(r["products"]), len(r["maintenance_orders"])) for r in lists.collect()}


def test_evidence_is_counted_without_pairs(spark):
    """Counts equal those of the evidence rows, and a busy code or asset does not multiply rows."""
    i = spark.createDataFrame([("t", "a", "A1", "E-4012"), ("t", "b", "A1", "E-4012"), ("t", "c", "A2", "E-77"), ("t", "d", "A3", None), ("u", "a", "A1", "E-4012")], "tenant_id string, id string, target_entity_id string, error_code string")
    r = [("t", "a", "A1", "temp", 80.0, 40.0, 1), ("t", "a", "A1", "rpm", 80.0, 40.0, 2), ("t", "c", "A2", "rpm", 1.0, 40.0, 3), ("t", "z", "A2", "rpm", 1.0, 40.0, 4)]
    t = spark.createDataFrame(r, "tenant_id string, incident_id string, entity_id string, metric string, value double, threshold double, seq long")
    c = [("t", f"k{k}", f"m{k}", "see e-4012 and E-4012 now" if k % 2 else "nothing", ["E-4012"] if k % 3 == 0 else []) for k in range(30)]
    chunks = spark.createDataFrame(c, "tenant_id string, id string, document_id string, content string, error_codes array<string>").withColumns({"section_header": F.lit("s")})
    orders = spark.createDataFrame([("t", "A1", f"o{k}") for k in range(40)] + [("t", "A3", "x")], "tenant_id string, target_entity_id string, id string")
    of_asset = orders.select("tenant_id", "target_entity_id", F.col("id").alias("node_id"), F.col("id").alias("name")).join(i.select("tenant_id", "target_entity_id", F.col("id").alias("incident_id")), ["tenant_id", "target_entity_id"])
    hits = reason.doc_hits(i, chunks)
    counts = reason.evidence_counts(i, t, chunks, orders)
    assert sorted(map(str, counts.collect())) == sorted(map(str, reason.count_evidence(reason.build_evidence(i, t, hits, of_asset)).collect())) and counts.count() == 4
    assert sorted(map(str, reason.analyze_incidents(i, t, counts=counts).collect())) == sorted(map(str, reason.analyze_incidents(i, t, hits, of_asset).collect()))


def test_patterns_need_no_python_per_incident(spark, tmp_path):
    schema = "tenant_id string, incident_id string, entity_id string, metric string, value double, threshold double, ts timestamp, seq long"
    found = streams.stream_patterns(streams.file_stream(spark, schema, str(tmp_path)))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert found.isStreaming and "session_window" in plan and "InPandas" not in plan


def test_feedback_calls_do_not_grow_with_executions(spark, tmp_path):
    """Executions share keys of the state, so one call into Python serves many; each is settled once."""
    n = 3 * streams.FEEDBACK_PARTS
    rows = spark.range(2 * n).select(F.format_string("x%d", F.col("id") % n).alias("execution_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("started_at"),
                                     F.when(F.col("id") % 2 == 0, 29.0).otherwise(40.0).alias("value"), F.lit(45.0).alias("baseline"), F.lit(30.0).alias("target"), F.lit("<=").alias("op"), F.lit(60.0).alias("max_minutes"))
    rows.write.parquet(f"{tmp_path}/in")
    streams.end_marker(spark.read.parquet(f"{tmp_path}/in"), "ts", "40 HOURS").write.mode("append").parquet(f"{tmp_path}/in")
    found = streams.stream_feedback(streams.file_stream(spark, rows.schema, f"{tmp_path}/in"))
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(keys) <= streams.FEEDBACK_PARTS < n
    got = {r["execution_id"]: (r["status"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == n and got == {f"x{k}": ("TIMEOUT_FAILED", 40.0) if k % 2 else ("RESOLVED_HEALTHY", 29.0) for k in range(n)}


def test_tables_landed_as_many_files_lose_no_rows(spark):
    """More files than two batches of a live stream take, the latest first."""
    day = F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 86_400)
    rows = spark.range(0, 240, 1, 240).select(F.format_string("x%d", "id").alias("execution_id"), day.alias("ts"), day.alias("started_at"), F.lit(29.0).alias("value"), F.lit(45.0).alias("baseline"), F.lit(30.0).alias("target"), F.lit("<=").alias("op"), F.lit(60.0).alias("max_minutes"))
    told = queries._streamed(spark, "many", rows, lambda s, root: queries._to_parquet(streams.stream_feedback(s, "1 hour"), root), "40 HOURS")
    assert sorted(r[0] for r in told.collect()) == sorted(f"x{k}" for k in range(240))


def _chunks(spark, texts, codes=None):
    rows = [("t", f"c{i}", i, x, (codes or {}).get(i, [])) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "tenant_id string, id string, n long, content string, error_codes array<string>").select("*", F.struct(F.col("n").alias("seq")).alias("chunk_seq"))


def test_terms_are_counted_where_the_chunk_stands(spark):
    """No token or term is shuffled; hyphens, codes, nulls, other letters and terms beyond the broadcast."""
    chunks = _chunks(spark, ["A-1 a1 - x", None, "", "\u0130x \u212a e-4012", "x " * 500], {0: ["E-7", None], 1: ["E-7"]})
    terms, lengths = search.bm25_index(chunks)
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString() + lengths._jdf.queryExecution().executedPlan().toString()
    got = {(r["chunk_id"], r["term"]): r["tf"] for r in terms.collect()}
    assert got == {("c0", "a-1"): 1, ("c0", "a1"): 2, ("c0", "-"): 1, ("c0", ""): 1, ("c0", "x"): 1, ("c0", "e-7"): 5, ("c0", None): 5, ("c1", "e-7"): 5,
                   ("c3", "i"): 1, ("c3", "x"): 1, ("c3", "k"): 1, ("c3", "e-4012"): 1, ("c3", "e4012"): 1, ("c4", "x"): 500}
    assert {r["chunk_id"]: r["len"] for r in lengths.collect()} == {"c0": 6, "c1": 0, "c2": 0, "c3": 5, "c4": 500}
    asked = spark.createDataFrame([("t", "x"), ("t", "e-7"), ("u", "k")], "tenant_id string, term string")
    for most in (0, 1 << 20):
        some = search.count_terms(chunks, asked, most=most)
        assert {(r["chunk_id"], r["term"]): r["tf"] for r in search.postings_of(some).collect()} == {k: n for k, n in got.items() if k[1] in ("x", "e-7")}
        assert {r["chunk_id"]: r["len"] for r in some.collect()} == {"c0": 6, "c1": 0, "c2": 0, "c3": 5, "c4": 500}


def test_blocks_come_from_sorted_rows(spark, tmp_path):
    """Every posting stands in one block, blocks go over the edges of batches, and a term has no more rows than blocks."""
    rows = [("t", f"w{w}", 3, b, w % 4, f"c{w}.{b}.{i}", i + 1, 9 - i % 5) for w in range(7) for b in range(3) for i in range(11 * (w % 3) + 1)]
    names = ["tenant_id", "term", "of", "block", "bucket", "chunk_id", "tf", "len"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for size in (1, 5, 1000):
        found = [r for b in postings._blocks(whole.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert len(found) == 21 and [(r["term"], r["block"], e["chunk_id"], e["tf"], e["len"]) for r in found for e in r["entries"]] == [(x[1], x[3], *x[5:]) for x in rows]
        assert all(r["most_tf"] == max(e["tf"] for e in r["entries"]) and r["least_len"] == min(e["len"] for e in r["entries"]) for r in found)
    assert not list(postings._blocks(iter([])))
    postings.add_chunks(_chunks(spark, ["x y"] * 300 + ["z"]), f"{tmp_path}/i", 100)
    found = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/i/blocks").select("term", "of", F.size("entries")).collect()]
    assert sum(n for *_, n in found) == 601 and sorted((t, of) for t, of, _ in found) == [("x", 3)] * 3 + [("y", 3)] * 3 + [("z", 1)]


def test_embeddings_are_computed_once(spark):
    chunks = search.embed_chunks(_chunks(spark, ["thermal heat", None]))
    asked = chunks.filter("id = 'c0'").select("tenant_id", F.col("id").alias("query_id"), "embedding")
    plan = search.vector_search(asked, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r["chunk_id"] for r in nearest.nearest(asked, chunks.select("tenant_id", F.col("id").alias("chunk_id"), F.array("n").alias("place"), F.when(F.col("id") == "c0", F.col("embedding")).alias("embedding")), 3).collect()] == ["c0"]


def test_embeddings_of_pieces_equal_those_of_texts():
    texts = [b"abcd abcde x", None, b"", b"-- --", b"q" * 90 + b" ab", b"z9z9 " * 400, "\u00e9a abcd".encode()]
    whole, cut = (list(hashing._embeddings(iter([pa.array(texts, pa.binary())] * 2), 64, n)) for n in (1 << 20, 3))
    assert [x.to_pylist() for x in whole] == [x.to_pylist() for x in cut]
    v = np.zeros(64)
    for term, w in [("abcd", 2.5), ("abcde", 2.0), ("abcd", 0.5), ("bcde", 0.5), ("x", 2.0)]:
        a, b = __import__("hashlib").md5(term.encode()).digest()[:2]
        v[(a << 8 | b) % 64] += w
    assert np.allclose(whole[0].to_pylist()[0], v / np.sqrt(v @ v), atol=1e-15) and whole[0].to_pylist()[1] == [0.0] * 64


def test_a_small_frontier_does_not_shuffle_the_graph(spark):
    nodes = spark.range(50).select(F.lit("t").alias("tenant_id"), F.format_string("n%d", "id").alias("id"))
    asked = spark.createDataFrame([("t", "n1"), ("t", "n1"), ("t", "none")], "tenant_id string, id string")
    some = graph._exist(asked, nodes)
    assert [r["id"] for r in some.collect()] == ["n1"] and graph._exist(asked, nodes, 2) is nodes
    assert "Exchange hashpartitioning(tenant_id" not in some.select("id")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
