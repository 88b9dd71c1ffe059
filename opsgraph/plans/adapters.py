"""Domain tables derived from the star-schema tables.

Each is a text in the SQL that Spark and DuckDB share, over base tables and over
adapters before it, so that queries and their SQL twins start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "nodes": """
SELECT 't' || CAST(r_regionkey % 3 AS STRING) AS tenant_id, 'R' || CAST(r_regionkey AS STRING) AS id, 'Plant' AS entity_type, 'PHYSICAL' AS category, r_name AS name, r_name AS canonical_id, CAST(r_regionkey AS BIGINT) AS seq FROM region
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'N' || CAST(n_nationkey AS STRING), 'Line', 'PHYSICAL', n_name, n_name, CAST(1000 + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'S' || CAST(s_suppkey AS STRING), 'Sensor', 'PHYSICAL', s_name, s_name, 100000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'C' || CAST(c_custkey AS STRING), 'WorkOrder', 'PROCESS', c_name, c_name, 100000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'O' || CAST(o_orderkey AS STRING), 'Batch', 'PROCESS', 'Order ' || CAST(o_orderkey AS STRING), 'O-' || CAST(o_orderkey AS STRING), 100000000000 + o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "edges": """
SELECT 't' || CAST(n_regionkey % 3 AS STRING) AS tenant_id, 'e1_' || CAST(n_nationkey AS STRING) AS id, 'R' || CAST(n_regionkey AS STRING) AS source_id, 'N' || CAST(n_nationkey AS STRING) AS target_id, 'CONTAINS' AS relation_type,
  CAST('1990-01-01 00:00:00' AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, CAST(n_nationkey AS BIGINT) AS seq FROM nation
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'e2_' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING), 'S' || CAST(s_suppkey AS STRING), 'MONITORS',
  CAST('1990-01-01 00:00:00' AS TIMESTAMP), CASE WHEN s_suppkey % 2 = 1 THEN CAST('1996-06-30 00:00:00' AS TIMESTAMP) END, 100000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'e3_' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING), 'C' || CAST(c_custkey AS STRING), 'EXECUTES',
  CAST('1990-01-01 00:00:00' AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 100000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 't' || CAST(n_regionkey % 3 AS STRING), 'e4_' || CAST(o_orderkey AS STRING), 'C' || CAST(o_custkey AS STRING), 'O' || CAST(o_orderkey AS STRING), 'PRODUCES',
  o_orderdate, o_orderdate + INTERVAL 400 DAY, 100000000000 + o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "docs": "SELECT 't' || CAST(doc_id % 4 AS STRING) AS tenant_id, 'doc' || CAST(doc_id AS STRING) AS id, doc_id AS seq, text AS content, lang AS title, source AS doc_type FROM documents",
    "asked": """
SELECT t.tenant_id, q.query_id, q.query FROM (SELECT DISTINCT 't' || CAST(doc_id % 4 AS STRING) AS tenant_id FROM documents) t
CROSS JOIN (SELECT 'q1' AS query_id, 'apache license version 2.0' AS query UNION ALL SELECT 'q2', 'the MIT License and the GNU' UNION ALL SELECT 'q3', 'token password example.com' UNION ALL SELECT 'q4', 'de la que ciudad' UNION ALL SELECT 'q5', 'under cc by-nc 4.0') q""",
    "telemetry": """
SELECT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'i' || CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) AS incident_id, 'A' || CAST(user_id % 50 AS STRING) AS entity_id,
  CASE event_type WHEN 'error' THEN 'Spindle Temp' WHEN 'click' THEN 'coolant_pressure' WHEN 'view' THEN 'vibration_rms' WHEN 'signup' THEN 'temp_motor' ELSE 'rpm' END AS metric, value,
  CASE WHEN event_id % 11 = 0 THEN CAST(NULL AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END AS threshold, ts, event_id AS seq FROM events""",
    "incidents": "SELECT tenant_id, incident_id AS id, MIN(entity_id) AS target_entity_id, CASE WHEN MIN(seq) % 10 = 0 THEN 'E-4012' ELSE 'E-' || CAST(1000 + MIN(seq) % 9000 AS STRING) END AS error_code, MIN(seq) AS seq FROM telemetry GROUP BY tenant_id, incident_id",
    "raw_rows": """
SELECT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'events' AS data_source_id, 'j' || CAST(event_id % 20 AS STRING) AS job_id, event_id AS row_index,
  CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 89 = 0 THEN '{}' WHEN event_id % 83 = 0 THEN '{"__proto__x":1,"sku":"' || CAST(event_id AS STRING) || '"}' WHEN event_id % 79 = 0 THEN '[1]'
  ELSE '{"order_id":"' || CAST(user_id % 40 AS STRING) || '","sku":"' || event_type || '"}' END AS raw_json FROM events""",
    "proposals": """
SELECT 't' || CAST(o_custkey % 3 AS STRING) AS tenant_id, 'p' || CAST(o_orderkey AS STRING) AS id, 'A' || CAST(o_custkey % 50 AS STRING) AS target_entity_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'SETPOINT_CHANGE' WHEN 1 THEN 'MODIFY_FEED' WHEN 2 THEN 'CREATE_WORK_ORDER' ELSE 'override_spindle' END AS command_type, CASE WHEN o_orderkey % 2 = 0 THEN 'SCADA' ELSE 'CMMS' END AS system_target,
  CASE o_orderkey % 3 WHEN 0 THEN 'targetPressureBar' WHEN 1 THEN 'targetRpm' ELSE 'targetTempCelsius' END AS param, CASE WHEN o_orderkey % 29 = 0 THEN 'high' ELSE CAST(o_orderkey * 37 % 30000 - 50 AS STRING) END AS param_value,
  CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'PLANT_MANAGER' WHEN '2' THEN 'PROCESS_ENGINEER' WHEN '3' THEN 'ORG_ADMIN' WHEN '4' THEN 'OPERATOR' ELSE 'MAINTENANCE_SUPERVISOR' END AS required_approval_role,
  CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END AS approval_status, o_orderkey AS seq FROM orders""",
    "states": "SELECT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'A' || CAST(user_id % 50 AS STRING) AS entity_id, CASE event_type WHEN 'error' THEN 'EMERGENCY_STOP' WHEN 'click' THEN 'RUNNING_CRITICAL' WHEN 'view' THEN 'IDLE' ELSE 'RUNNING_NORMAL' END AS state, ts FROM events WHERE user_id % 50 < 45",
    "envelopes": "SELECT DISTINCT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'A' || CAST(user_id % 50 AS STRING) AS entity_id, CAST(12000 AS DOUBLE) AS max_rpm, CAST(NULL AS DOUBLE) AS max_pressure_bar, CAST(75 AS DOUBLE) AS max_temperature_celsius, CAST(5 AS DOUBLE) AS min_pressure_bar FROM events WHERE user_id % 50 < 20",
    "action_times": "SELECT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'A' || CAST(user_id % 50 AS STRING) AS entity_id, ts FROM events WHERE event_type <> 'view'",
    "executions": """
SELECT 't' || CAST(o_custkey % 3 AS STRING) AS tenant_id, 'x' || CAST(o_orderkey AS STRING) AS execution_id, 'p' || CAST(o_orderkey AS STRING) AS proposal_id, 'A' || CAST(o_custkey % 50 AS STRING) AS entity_id,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(o_orderkey % 720 AS INT) * INTERVAL 1 HOUR AS evaluated_at, CAST(o_orderkey % 60 AS DOUBLE) AS elapsed_minutes, o_orderkey % 3 <> 0 AS rollback_enabled FROM orders""",
    "conditions": "SELECT 't' || CAST(o_custkey % 3 AS STRING) AS tenant_id, 'p' || CAST(o_orderkey AS STRING) AS proposal_id, CAST(45 AS DOUBLE) AS baseline_value, CAST(30 AS DOUBLE) AS target_healthy_value, CASE o_orderkey % 4 WHEN 0 THEN '<' WHEN 1 THEN '<=' WHEN 2 THEN '>' ELSE '>=' END AS comparison_operator, CAST(20 AS DOUBLE) AS max_evaluation_window_minutes FROM orders WHERE o_orderkey % 5 <> 0",
    "audit_raw": """
SELECT 'a' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id, 't' || CAST(conv_id % 3 AS STRING) AS tenant_id, 'u' || CAST(conv_id % 17 AS STRING) AS actor_id, 'u' || CAST(conv_id % 17 AS STRING) || '@example.com' AS actor_email,
  CASE role WHEN 'user' THEN 'OPERATOR' ELSE 'AUDITOR' END AS actor_role, CASE WHEN turn % 2 = 0 THEN 'DATA_INGEST' ELSE 'GRAPH_NODE_MERGE' END AS action, 'CONVERSATION' AS resource_type,
  CASE WHEN conv_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'r' || CAST(conv_id AS STRING) END AS resource_id, '{"turn":' || CAST(turn AS STRING) || '}' AS details, CASE WHEN conv_id % 4 = 0 THEN 'BLOCKED' ELSE 'SUCCESS' END AS status,
  CAST(CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(conv_id % 5000 AS INT) * INTERVAL 1 MINUTE AS STRING) AS "timestamp" FROM conversations""",
    "manuals": """
SELECT 't' || CAST(p_partkey % 3 AS STRING) AS tenant_id, 'man' || CAST(p_partkey AS STRING) AS id, p_partkey AS seq, p_name AS title, 'MANUAL' AS doc_type,
  '# Manual of ' || p_name || chr(10) || 'Alarm E-' || CAST(4000 + p_partkey % 40 AS STRING) || ' is raised when the ' || p_type || ' line overheats.' || chr(10) || 'Max Pressure: ' || CAST(p_size AS STRING) || ' bar' || chr(10)
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '## Alarm Table' || chr(10) || '| Code | Text |' || chr(10) || '|---|---|' || chr(10) || '| E-' || CAST(1000 + p_partkey % 300 AS STRING) || ' | ' || p_brand || ' |' || chr(10) END
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '## Service' || chr(10) END || repeat('Check the seal of the ' || p_type || ' unit and the coolant flow.' || chr(10), CAST(3 + p_partkey % 31 AS INT)) || 'See part-' || CAST(p_partkey AS STRING) || '.' AS content FROM part""",
    "asked_manuals": """
SELECT t.tenant_id, q.query_id, q.query FROM (SELECT DISTINCT 't' || CAST(p_partkey % 3 AS STRING) AS tenant_id FROM part) t
CROSS JOIN (SELECT 'm1' AS query_id, 'E-4012' AS query UNION ALL SELECT 'm2', 'red widget alarm table e-1007' UNION ALL SELECT 'm3', 'service of the seal, seal check' UNION ALL SELECT 'm4', ' max pressure of part-12 ') q""",
    "assets": "SELECT DISTINCT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'A' || CAST(user_id % 50 AS STRING) AS id, 'Asset ' || CAST(user_id % 50 AS STRING) AS name FROM events WHERE user_id % 50 < 40",
    "orgs": "SELECT 't' || CAST(n_nationkey AS STRING) AS id, n_name AS name FROM nation",
    "users": "SELECT 'u' || CAST(c_custkey AS STRING) AS id, LOWER(c_name) || '@example.com' AS email, c_name AS full_name, c_custkey % 100 = 0 AS is_super_admin FROM customer",
    "memberships": "SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, 't' || CAST(c_nationkey AS STRING) AS tenant_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'OPERATOR' WHEN 'HOUSEHOLD' THEN 'VIEWER' WHEN 'BUILDING' THEN 'PLANT_MANAGER' ELSE 'AUDITOR' END AS role, CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status FROM customer UNION ALL SELECT 'ghost' || CAST(s_suppkey AS STRING), 't' || CAST(s_nationkey + 20 AS STRING), 'VIEWER', 'ACTIVE' FROM supplier",
    "requests": "SELECT 'q' || CAST(o_orderkey AS STRING) AS request_id, 'u' || CAST(o_custkey AS STRING) AS user_id, 't' || CAST(o_orderkey % 27 AS STRING) AS tenant_id FROM orders",
    "existing_parts": "SELECT 't' || CAST(p_partkey % 2 AS STRING) AS tenant_id, 'E' || CAST(p_partkey AS STRING) AS id, 'P-' || CAST(p_partkey AS STRING) AS canonical_id, p_type AS entity_type, p_name AS name, 'M' || CAST(p_size % 5 AS STRING) AS model, CASE WHEN p_partkey % 7 = 0 THEN 'TAG' || CAST(p_partkey AS STRING) END AS tag, p_partkey AS seq FROM part WHERE p_partkey % 4 < 2",
    "incoming_parts": "SELECT 't' || CAST(p_partkey % 2 AS STRING) AS tenant_id, p_partkey AS in_id, CASE WHEN p_partkey % 10 = 2 THEN 'p-' || CAST(p_partkey - 2 AS STRING) ELSE 'X-' || CAST(p_partkey AS STRING) END AS canonical_id, p_type AS entity_type, CASE WHEN p_partkey % 3 = 0 THEN SUBSTRING(p_name, 1, 4) || ' unit' ELSE p_name || CAST(p_partkey % 9 AS STRING) END AS name, CASE WHEN p_partkey % 4 = 2 THEN 'M' || CAST(p_size % 5 AS STRING) END AS model, CASE WHEN p_partkey % 7 = 2 THEN 'tag' || CAST(p_partkey - 2 AS STRING) END AS tag FROM part WHERE p_partkey % 4 >= 2",
}

# Texts made from these tables are hundreds of times their rows: what is one split of a file becomes many tasks' work.
SPREAD = {"manuals": "part"}


def _needs(text: str) -> list[str]:
    """Adapters that a text reads, in order of definition."""
    found = {n for n in SQL if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)}
    for n in list(found):
        found |= set(_needs(SQL[n]))
    return [n for n in SQL if n in found]


def twin(text: str) -> str:
    """A DuckDB query over adapters: those that it reads come first as common tables."""
    ctes = [f"{n} AS ({SQL[n]})" for n in _needs(text)]
    body = text.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, or a base table's."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name].replace('"timestamp"', "`timestamp`")
    used = {n: load(spark, sf_dir, n) for n in (*BASE, *SQL) if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)}
    if name in SPREAD:
        used[SPREAD[name]] = used[SPREAD[name]].repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    for n in used:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text)
    text = re.sub(r"\{(?!" + "|".join(f"{n}\\}}" for n in used) + r")", "{{", text)
    text = re.sub(r"(?<!" + ")(?<!".join(f"{{{n}" for n in used) + r")\}", "}}", text)
    return spark.sql(text, **used)
