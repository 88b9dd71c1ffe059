import hashlib
import hmac
from datetime import datetime

from opsgraph.functions import hashing
from opsgraph.operators import access, action, audit, graph, ingest, listing, reason, resolve, search
from pyspark.sql import functions as F

T = datetime


def nodes(spark, rows):
    return spark.createDataFrame([(t, i, k, "PHYSICAL", n, i, q) for q, (t, i, k, n) in enumerate(rows)], "tenant_id string, id string, entity_type string, category string, name string, canonical_id string, seq long")


def edges(spark, rows):
    return spark.createDataFrame([(t, f"e{q}", a, b, r, f, u, q) for q, (t, a, b, r, f, u) in enumerate(rows)], "tenant_id string, id string, source_id string, target_id string, relation_type string, valid_from timestamp, valid_to timestamp, seq long")


def test_pipeline_counts(spark):
    rows = spark.createDataFrame([("t", "s", "j", 1, '{"order_id":"1","qty":1}'), ("t", "s", "j", 2, '{"order_id":"2","qty":1}'), ("t", "s", "j", 3, '{"order_id":"1","qty":1}'), ("t", "s", "j", 4, None), ("t", "s", "j", 5, '{"order_id":"3"}')],
                                 "tenant_id string, data_source_id string, job_id string, row_index long, raw_json string")
    tagged = ingest.tag_outcomes(rows)
    s = ingest.job_summary(tagged).first()
    assert (s["valid_rows"], s["duplicate_rows"], s["error_rows"], s["status"]) == (3, 1, 1, "PARTIAL")
    assert [r["row_index"] for r in ingest.dead_letters(tagged).collect()] == [4]
    assert {r["external_id"] for r in ingest.normalized(tagged).collect()} == {"1", "2", "3"}
    assert ingest.job_summary(ingest.tag_outcomes(rows, deduplicate=False)).first()["valid_rows"] == 4


def test_graph_walk_cycle_time_and_tenant(spark):
    n = nodes(spark, [("a", "P", "Plant", "Plant"), ("a", "L", "Line", "Line"), ("a", "M", "Machine", "M"), ("a", "S", "Sensor", "S"), ("b", "S", "Sensor", "other")])
    e = edges(spark, [("a", "P", "L", "CONTAINS", T(2020, 1, 1), None), ("a", "L", "M", "CONTAINS", T(2020, 1, 1), None), ("a", "M", "S", "HAS", T(2024, 1, 1), T(2024, 12, 31)), ("a", "M", "L", "BACK", T(2020, 1, 1), None)])
    roots = spark.createDataFrame([("a", "P"), ("b", "P")], "tenant_id string, root_id string")
    reached, walked = graph.traverse(roots, n, e, "DOWNSTREAM", 3, "2024-06-01 00:00:00")
    assert {(r["node_id"], r["depth"]) for r in reached.collect()} == {("P", 0), ("L", 1), ("M", 2), ("S", 3)}
    assert walked.count() == 4
    assert graph.traverse(roots, n, e, "DOWNSTREAM", 3, "2026-09-01 00:00:00")[0].count() == 3
    assert graph.traverse(roots, n, e, "DOWNSTREAM", 0)[0].count() == 1
    up = spark.createDataFrame([("a", "S")], "tenant_id string, root_id string")
    assert graph.traverse(up, n, e, "UPSTREAM", 3, "2024-06-01 00:00:00")[0].count() == 4
    d = graph.dossier(spark.createDataFrame([("a", "M")], "tenant_id string, root_id string"), n, e, "2024-06-01 00:00:00").first()
    assert (d["plant"], d["line"], d["sensors"]) == ("Plant", "Line", ["S"])
    assert d["summary"].startswith("M (Machine) located at Plant // Line. Configured with 1 active sensors")
    good, bad = graph.check_endpoints(edges(spark, [("a", "P", "L", "X", T(2020, 1, 1), None), ("b", "P", "S", "X", T(2020, 1, 1), None)]), n)
    assert good.count() == 1 and bad.count() == 1


def test_resolution_routes(spark):
    kind = "tenant_id string, {}canonical_id string, entity_type string, name string, description string, attributes map<string,string>, source_refs array<struct<source_id:string,external_id:string,confidence:double>>"
    old = spark.createDataFrame([("t", "n1", "M-1", "Machine", "CNC Mill Alpha", None, {"asset_tag": "AT-1"}, [("a", "1", 1.0)], 1, 0)], kind.format("id string, ") + ", version int, seq long")
    new = spark.createDataFrame([("t", 1, "X-1", "Machine", "Another name altogether", "text", {"asset_tag": "at-1", "k": "v"}, [("b", "2", 1.0)]), ("t", 2, "X-2", "Machine", "CNC Mall", None, {}, []), ("t", 3, "X-3", "Tool", "Zzz", None, {}, []),
                                 ("t", 4, "m-1", "Tool", "q", None, {}, [])], kind.format("in_id long, "))
    r = {x["in_id"]: (x["action"], x["matched_id"], x["confidence"]) for x in resolve.resolve_entities(old, new).collect()}
    assert r[1] == ("MERGED_AUTOMATIC", "n1", 0.98) and r[3] == ("CREATED_NEW", None, 1.0) and r[4] == ("MERGED_AUTOMATIC", "n1", 1.0)
    assert r[2][0] == "QUEUED_FOR_REVIEW" and 0.5 <= r[2][2] < 0.8
    resolved = resolve.resolve_entities(old, new)
    m = resolve.merge_nodes(old, resolved.filter("in_id = 1")).first()
    assert m["name"] == "Another name altogether" and m["version"] == 2 and m["attributes"] == {"asset_tag": "at-1", "k": "v"} and len(m["source_refs"]) == 2
    queue = resolve.review_items(resolved, old).withColumn("created_at", F.lit("2024"))
    item = resolve.pending_reviews(queue, "t").first()["id"]
    asked = spark.createDataFrame([("t", item, "APPROVED", "a@b", "same mill"), ("t", "none", "APPROVED", "a@b", None), ("u", item, "REJECTED", "x@y", None)], "tenant_id string, id string, decision string, reviewer_email string, notes string")
    after, merged, audited, refused = resolve.decide_reviews(queue, asked, old, "2025")
    r = after.first()
    assert (r["status"], r["reviewed_by"], r["reviewed_at"], r["decision_notes"]) == ("APPROVED", "a@b", "2025", "same mill") and merged.first()["version"] == 2
    assert [(x["action"], x["resource_id"], x["actor_role"]) for x in audited.collect()] == [("ENTITY_MERGE_APPROVED", "n1", "PROCESS_ENGINEER")]
    assert {(x["tenant_id"], x["reason"]) for x in refused.collect()} == {("t", "NOT_FOUND"), ("u", "NOT_FOUND")}
    again = resolve.decide_reviews(after, asked, old, "2026")
    assert again[0].first()["reviewed_at"] == "2025" and again[1].count() == 0 and "ALREADY_DECIDED" in {x["reason"] for x in again[3].collect()}
    reasons = {x["in_id"]: x["match_reasons"] for x in resolved.collect()}
    assert reasons[1] == ['Exact asset tag/serial match: "AT-1"'] and reasons[4] == ['Exact canonical ID match: "M-1"'] and reasons[3] == []
    assert reasons[2] == ["Same entity type: Machine"] or reasons[2][1].startswith("Name similarity: ")
    everything, items, outcome = resolve.apply_resolution(old, new, spark.createDataFrame([], "id string, tenant_id string, created_at string"), "2025")
    got = {x["canonical_id"]: (x["version"], x["seq"]) for x in everything.collect()}
    assert got == {"M-1": (2, 0), "X-2": (1, 1), "X-3": (1, 2)} and items.count() == 1 and outcome.count() == 4


def test_chunker_keeps_tables_whole_and_overlaps():
    text = ["# Title", "intro", "## Alarms", "| Code | Text |", "|---|---|", "| E-4012 | hot |", "after " + "x" * 790, "tail"]
    chunks = search.chunk_ranges(text)
    assert [c[2] for c in chunks] == [False, False, True, False, False]
    assert chunks[2][0].count("\n") == 2 and chunks[2][1] == "Alarms"
    assert chunks[3][0].startswith("after") and chunks[4][0].endswith("tail") and chunks[4][0].startswith("after")
    assert search.chunk_ranges([""]) == [] and search.chunk_ranges(["  ", ""]) == []


def test_chunks_and_search(spark):
    text = "# Chiller manual\nMax Pressure: 250 bar\n## Alarms\n| Code | Text |\n|---|---|\n| E-4012 | over temperature |\n| ALM-101 | flow |\nCheck MACH-1 coolant flow."
    docs = spark.createDataFrame([("t", "d1", 1, text, "Chiller", "MANUAL", ["n1"]), ("u", "d2", 2, text, "Other", "SOP", [])], "tenant_id string, id string, seq long, content string, title string, doc_type string, linked_entity_ids array<string>")
    names = spark.createDataFrame([("t", "MACH-1")], "tenant_id string, canonical_id string")
    chunks = search.chunk_documents(docs, dictionary=names).cache()
    table = chunks.filter("is_table AND tenant_id = 't'").first()
    assert table["table_data"][1] == ["E-4012", "over temperature"] and table["error_codes"] == ["E-4012", "ALM-101"]
    assert any("MACH-1" in r["linked_entity_ids"] for r in chunks.filter("tenant_id = 't'").collect())
    asked = spark.createDataFrame([("t", "q", "E-4012", "n1")], "tenant_id string, query_id string, query string, target_entity_id string")
    hits = search.bm25_search(asked, chunks).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == table["id"] and hits[0]["score"] > 40 and {h["tenant_id"] for h in hits} == {"t"}
    n, e = nodes(spark, [("t", "n1", "Machine", "Mill")]), edges(spark, [])
    fused = search.hybrid_search(asked, chunks, n, e)
    assert fused.orderBy("rank").first()["rrf_score"] > 0 and fused.filter("rank = 1").first()["bm25_score"] > 40
    context = search.assemble_context(asked, fused, chunks, docs, graph.dossier(asked.select("tenant_id", F.col("target_entity_id").alias("root_id")), n, e), "now").first()["context"]
    assert "E-4012" in context and "Asset: Mill" in context
    assert search.ingest_rollup(chunks).filter("tenant_id = 't'").first()["table_count"] == 1
    left, _ = search.bm25_remove(*search.bm25_index(chunks), chunks.select("tenant_id", F.col("id").alias("chunk_id")))
    assert left.count() == 0


def test_tenant_join_beyond_the_broadcast(spark):
    big = spark.range(60).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("tenant_id"), "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "tenant_id string, k int")
    want = sorted(tuple(r) for r in graph.join_tenant(big, small, "id").collect())
    assert want == sorted(tuple(r) for r in graph.join_tenant(big, small, "id", most=0).collect()) and len(want) == 100


def test_embedding_against_md5(spark):
    import math

    text = "thermal heat heat"
    want = [0.0] * 64
    for w in text.split():
        for g, x in [(w, 2.0), *((w[i : i + 4], 0.5) for i in range(len(w) - 3))]:
            want[int.from_bytes(hashlib.md5(g.encode()).digest()[:2], "big") % 64] += x
    norm = math.sqrt(sum(x * x for x in want))
    got = hashing.with_embedding(spark.createDataFrame([(1, text), (2, "!!")], "id int, text string"), ["id"]).orderBy("id").collect()
    assert max(abs(a - b / norm) for a, b in zip(got[0]["embedding"], want)) < 1e-12 and set(got[1]["embedding"]) == {0.0}


def test_correlation_patterns(spark):
    rows = [("t", "i", "L1", "coolant_pressure", 2.0, 4.0, 0, 0), ("t", "i", "S1", "spindle_temp", 70.0, 65.0, 60, 1), ("t", "i", "S1", "vibration", 5.0, 3.0, 65, 2), ("t", "i", "S1", "spindle_temp", 75.0, 65.0, 110, 3)]
    df = spark.createDataFrame(rows, "tenant_id string, incident_id string, entity_id string, metric string, value double, threshold double, s int, seq long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["pattern_type"]: (r["seconds"], r["causal"]) for r in reason.correlate(df).collect()}
    assert got == {"CROSS_SYSTEM_CASCADE": (60, True), "MULTI_ENTITY_SPIKE": (5, False), "PROGRESSIVE_DRIFT": (300, True)}
    inc = spark.createDataFrame([("t", "i", "n1", "E-4012", 0)], "tenant_id string, id string, target_entity_id string, error_code string, seq long")
    r = reason.analyze_incidents(inc, df, nodes=nodes(spark, [("t", "n1", "Machine", "Mill")])).first()
    assert (r["n_hypotheses"], r["n_recommendations"], r["n_evidence"], r["unsupported_claims"], r["target_name"]) == (2, 2, 4, 0, "Mill")
    asked = spark.createDataFrame([("t", "i"), ("t", "zzz")], "tenant_id string, incident_id string")
    assert {r["chosen_id"] for r in reason.incident_or_first(inc, asked).collect()} == {"i"}


def test_feedback_states(spark):
    rows = spark.createDataFrame([("RESOLVED_HEALTHY", 58.0, 15.0), ("DETERIORATING", 82.5, 5.0), ("MONITORING_IN_PROGRESS", 68.0, 10.0), ("TIMEOUT_FAILED", 66.0, 45.0)], "want string, v double, e double")
    got = rows.select("want", action.feedback_status(F.col("v"), F.lit(74.2), F.lit(60.0), F.lit("<="), F.col("e"), F.lit(30.0)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_guardrails_block_in_order(spark):
    p = spark.createDataFrame([("t", "p1", "A", "SETPOINT", "SCADA", {"targetRpm": "30000"}, "OPERATOR", "APPROVED"), ("t", "p2", "A", "WORK", "CMMS", {}, "OPERATOR", "PENDING"), ("t", "p3", "B", "WORK", "CMMS", {"targetRpm": "abc"}, "OPERATOR", "APPROVED")],
                              "tenant_id string, id string, target_entity_id string, command_type string, system_target string, parameters map<string,string>, required_approval_role string, approval_status string")
    now = T(2024, 1, 1, 12)
    states = spark.createDataFrame([("t", "A", "IDLE", T(2024, 1, 1)), ("t", "A", "RUNNING_CRITICAL", T(2024, 1, 1, 1))], "tenant_id string, entity_id string, state string, ts timestamp")
    env = spark.createDataFrame([], "tenant_id string, entity_id string, max_rpm double, max_pressure_bar double, max_temperature_celsius double, min_pressure_bar double")
    times = spark.createDataFrame([("t", "B", T(2024, 1, 1, 11, m)) for m in range(1, 6)] + [("t", "A", T(2024, 1, 1, 11, 0))] * 9, "tenant_id string, entity_id string, ts timestamp")
    long, verdict = action.evaluate_guardrails(p, states, env, times, now)
    failed = {(r["proposal_id"], r["check_no"]) for r in long.filter("NOT passed").collect()}
    assert failed == {("p1", 3), ("p1", 4), ("p2", 1), ("p3", 5)}
    v = {r["proposal_id"]: r["blocked_reason"] for r in verdict.collect()}
    assert v["p1"].startswith("no parameter change") and v["p3"].startswith("5 actions")
    plan = action.plan_executions(p.withColumn("system_target", F.lit("X")), verdict, "now")
    assert {r["status"] for r in plan.collect()} == {"GUARDRAIL_BLOCKED"}


def test_approvals(spark):
    p = spark.createDataFrame([("t", "a", "PROCESS_ENGINEER", "PENDING", None), ("t", "b", "OPERATOR", "PENDING", None)], "tenant_id string, id string, required_approval_role string, approval_status string, approved_by string")
    d = spark.createDataFrame([("t", "a", "x@y", "ORG_ADMIN"), ("t", "b", "x@y", "PLANT_MANAGER"), ("t", "zz", "x@y", "OPERATOR")], "tenant_id string, id string, email string, role string")
    after, refused = action.apply_approvals(p, d)
    assert {r["id"]: r["approval_status"] for r in after.collect()} == {"a": "PENDING", "b": "APPROVED"}
    assert {r["id"]: r["reason"] for r in refused.collect()} == {"a": "INSUFFICIENT_PRIVILEGE", "zz": "NOT_FOUND"}
    r = action.apply_rejections(p, spark.createDataFrame([("t", "a", "no")], "tenant_id string, id string, reason string"))
    assert {x["id"]: x["approval_status"] for x in r.collect()} == {"a": "REJECTED", "b": "PENDING"}


def test_hmac_and_tampering(spark):
    key, message = "k" * 70, "päy"
    got = spark.range(1).select(hashing.hmac_sha256(F.lit(message), key)).first()[0]
    assert got == hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("1", "t", "u", "e", "r", "act", "res", None, '{"a":1}', "SUCCESS", "2024")], "id string, tenant_id string, actor_id string, actor_email string, actor_role string, action string, resource_type string, resource_id string, details string, status string, timestamp string")
    from opsgraph.sources.sinks import export_audit, stamp_audit

    logs = stamp_audit(rows, "key")
    assert audit.verify(logs, "key").first()["integrity_verified"]
    for c in ("action", "details", "actor_id"):
        s = audit.verify_summary(logs.withColumn(c, F.lit("x")), "key").first()
        assert (s["tampered"], s["is_intact"], s["corrupted_ids"]) == (1, False, ["1"])
    assert export_audit(logs).first()["total"] == 1


def test_access(spark):
    m = access.role_permissions(spark)
    assert m.filter("role = 'SUPER_ADMIN'").count() == 19 and access.roles_with_permissions(m).count() == 7
    c = spark.createDataFrame([("1", "VIEWER", ["data:read", "org:write"]), ("2", "GHOST", ["data:read"]), ("3", "OPERATOR", [])], "check_id string, role string, permissions array<string>")
    assert {r["check_id"]: (r["has_all"], r["has_any"]) for r in access.role_checks(c, m).collect()} == {"1": (False, True), "2": (False, False), "3": (True, False)}
    now = spark.createDataFrame([("u", "t", "VIEWER", 1)], "user_id string, tenant_id string, role string, updated_at int")
    inv = spark.createDataFrame([("u", "t", "OPERATOR", 2), ("v", "t", "SUPER_ADMIN", 2), ("w", "t", "KING", 2)], now.schema)
    after, bad = access.upsert_memberships(now, inv)
    assert after.first()["role"] == "OPERATOR" and after.count() == 1
    assert {r["reason"] for r in bad.collect()} == {"ROLE_NOT_ASSIGNABLE", "UNKNOWN_ROLE"}
    q = spark.createDataFrame([("VIEWER", "org:write"), ("VIEWER", "data:read")], "role string, permission string")
    assert access.denied_permissions(q, m).count() == 1


def test_listing(spark):
    df = spark.createDataFrame([(str(i), "t", i) for i in range(60)], "id string, tenant_id string, ts int")
    p = listing.page(df, "ts").collect()
    assert len(p) == 50 and p[0]["ts"] == 59 and p[0]["total"] == 60
    assert listing.latest_n(df, "ts", 3).count() == 3 and listing.page(df, "ts", 10, 55).count() == 5
