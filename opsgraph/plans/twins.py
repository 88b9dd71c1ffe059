"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..operators.access import ROLE_PERMISSIONS
from ..operators.guards import KEYWORDS
from .adapters import twin

_MATRIX = ", ".join(f"('{r}', '{p}')" for r, ps in ROLE_PERMISSIONS.items() for p in ps.split())

_TOKENS = r"""
tok AS (SELECT tenant_id, id, seq, list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9\-_./]', ' ', 'g'), '\s+'), lambda x: x <> '') AS raw FROM docs),
words AS (SELECT tenant_id, id, seq, unnest(raw) AS t FROM tok),
terms AS (SELECT tenant_id, id, seq, t AS term FROM words UNION ALL SELECT tenant_id, id, seq, replace(t, '-', '') FROM words WHERE contains(t, '-'))"""

_RAW_QTOK = r"""
qtok AS (SELECT tenant_id, query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9\-_./]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS t,
  generate_subscripts(list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9\-_./]', ' ', 'g'), '\s+'), lambda x: x <> ''), 1) AS p FROM asked),
qt AS (SELECT tenant_id, query_id, t AS term, p * 2 AS p FROM qtok UNION ALL SELECT tenant_id, query_id, replace(t, '-', ''), p * 2 + 1 FROM qtok WHERE contains(t, '-')),
qterm AS (SELECT tenant_id, query_id, term, count(*) AS times, min(p) AS first FROM qt GROUP BY ALL)"""

_BM25 = "WITH " + _TOKENS.strip() + "," + _RAW_QTOK + r""",
len AS (SELECT d.tenant_id, d.id, d.seq, count(term) AS len FROM docs d LEFT JOIN terms t ON d.tenant_id = t.tenant_id AND d.id = t.id GROUP BY ALL),
st AS (SELECT tenant_id, avg(len) AS mean, count(*) AS n FROM len GROUP BY ALL),
tf AS (SELECT tenant_id, id, term, count(*) AS tf FROM terms WHERE (tenant_id, term) IN (SELECT tenant_id, term FROM qterm) GROUP BY ALL),
df AS (SELECT tenant_id, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT q.tenant_id, q.query_id, tf.id, len.seq, min(first) AS first,
  sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (greatest(len, 1) / mean)))) AS s
  FROM qterm q JOIN tf ON q.tenant_id = tf.tenant_id AND q.term = tf.term JOIN df ON df.tenant_id = tf.tenant_id AND df.term = tf.term JOIN st ON st.tenant_id = tf.tenant_id JOIN len ON len.tenant_id = tf.tenant_id AND len.id = tf.id GROUP BY ALL),
r AS (SELECT tenant_id, query_id, id AS doc_id, floor(s * 100 + 0.5) / 100 AS score, first, seq FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY score DESC, first, seq) AS rank FROM r WHERE score > 0)
SELECT tenant_id, query_id, doc_id, score, rank FROM k WHERE rank <= 10"""

_INFER = r"""CASE WHEN lower(trim(value)) IN ('true', 'false', 'yes', 'no') THEN 'BOOLEAN' WHEN regexp_full_match(trim(value), '-?\d+') THEN 'INTEGER' WHEN regexp_full_match(trim(value), '-?\d+\.\d+') THEN 'FLOAT'
 WHEN regexp_full_match(trim(value), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?') THEN 'TIMESTAMP' ELSE 'STRING' END"""

_PROFILE = f"""
WITH w AS (SELECT o_orderkey AS i, o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
  CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN '' END AS flag, 'order' AS kind FROM orders),
l AS ({" UNION ALL ".join(f"SELECT i, '{c}' AS column_name, nullif({c}, '') AS value FROM w" for c in ("o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice", "o_orderdate", "flag", "kind"))}),
k AS (SELECT *, CASE WHEN value IS NOT NULL THEN {_INFER} END AS t FROM l),
v AS (SELECT column_name, count(*) FILTER (t = 'INTEGER') AS ni, count(*) FILTER (t = 'FLOAT') AS nf, count(*) FILTER (t = 'TIMESTAMP') AS nt, count(*) FILTER (t = 'BOOLEAN') AS nb, count(*) FILTER (t = 'STRING') AS ns,
  bool_or(value IS NULL) AS nullable, count(DISTINCT value) AS unique_count, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT column_name, string_agg(value, '|' ORDER BY i) AS sample_values FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY i) AS r FROM l WHERE value IS NOT NULL) WHERE r <= 5 GROUP BY ALL)
SELECT v.column_name, CASE WHEN ni > 0 AND nf = 0 AND ns = 0 THEN 'INTEGER' WHEN nf > 0 AND ns = 0 THEN 'FLOAT' WHEN nt > 0 AND ns = 0 THEN 'TIMESTAMP' WHEN nb > 0 AND ns = 0 THEN 'BOOLEAN' ELSE 'STRING' END AS inferred_type,
  nullable, unique_count, coalesce(sample_values, '') AS sample_values, unique_count = 1 AND n > 5 AS is_constant FROM v LEFT JOIN s USING (column_name)"""

_TAGGED = """
k AS (SELECT *, CASE WHEN raw_json IS NULL THEN NULL WHEN raw_json[1] = '{' THEN json_keys(raw_json) END AS ks, row_number() OVER (PARTITION BY tenant_id, job_id, raw_json ORDER BY row_index) AS rn FROM raw_rows),
t AS (SELECT *, list_filter(ks, lambda x: starts_with(x, '__proto__') OR x = 'constructor')[1] AS bad_key,
  CASE WHEN raw_json IS NULL OR raw_json = '{}' THEN 'EMPTY_OR_INVALID_ROW' WHEN rn > 1 THEN 'DUPLICATE' WHEN list_filter(ks, lambda x: starts_with(x, '__proto__') OR x = 'constructor')[1] IS NOT NULL THEN 'PROTOTYPE_POLLUTION_DETECTED' ELSE 'VALID' END AS outcome FROM k)"""

_SENT = "(CASE WHEN contains(lower(metric), 'temp') OR contains(lower(metric), 'vib') THEN value > threshold ELSE value < threshold END)"
_FIRST = """
f AS (SELECT tenant_id, incident_id,
  arg_min(struct_pack(e := entity_id, v := value, t := ts), (ts, seq)) FILTER (contains(lower(metric), 'pressure') AND threshold <> 0 AND value < threshold) AS p,
  arg_min(struct_pack(e := entity_id, v := value, t := ts), (ts, seq)) FILTER (contains(lower(metric), 'temp') AND threshold <> 0 AND value > threshold) AS t,
  arg_max(struct_pack(e := entity_id, v := value, t := ts), (ts, seq)) FILTER (contains(lower(metric), 'temp') AND threshold <> 0 AND value > threshold) AS tl,
  arg_min(struct_pack(e := entity_id, v := value, t := ts), (ts, seq)) FILTER (contains(lower(metric), 'vib') AND threshold <> 0 AND value > threshold) AS v,
  count(*) FILTER (contains(lower(metric), 'temp') AND threshold <> 0 AND value > threshold) AS n FROM telemetry GROUP BY ALL)"""
_CORRELATE = "WITH " + _FIRST.strip() + """,
g AS (SELECT *, abs(epoch_us(p.t) - epoch_us(t.t)) / 1e6 AS pt, abs(epoch_us(v.t) - epoch_us(t.t)) / 1e6 AS vt FROM f)
SELECT tenant_id, incident_id, 'CROSS_SYSTEM_CASCADE' AS pattern_type, p.e || ',' || t.e AS entities, CAST(floor(pt + 0.5) AS BIGINT) AS seconds, 0.94::DOUBLE AS coefficient, true AS causal FROM g WHERE pt <= 21600
UNION ALL SELECT tenant_id, incident_id, 'MULTI_ENTITY_SPIKE', v.e || ',' || t.e, CAST(floor(vt + 0.5) AS BIGINT), 0.88::DOUBLE, false FROM g WHERE vt <= 21600
UNION ALL SELECT tenant_id, incident_id, 'PROGRESSIVE_DRIFT', t.e, 21600::BIGINT, 0.91::DOUBLE, true FROM g WHERE n >= 2 AND tl.v > t.v"""

_HYP = f"""
ev AS (SELECT tenant_id, incident_id, count(*) AS n FROM telemetry WHERE threshold IS NOT NULL AND {_SENT} GROUP BY ALL),
ft AS (SELECT tenant_id, incident_id, arg_min(value, seq) FILTER (contains(lower(metric), 'temp')) AS x FROM telemetry GROUP BY ALL),
b AS (SELECT i.tenant_id, i.id AS incident_id, i.error_code, i.target_entity_id, coalesce(ev.n, 0) AS n, i.error_code = 'E-4012' OR coalesce(ft.x > 68, false) AS fires
  FROM incidents i LEFT JOIN ev ON i.tenant_id = ev.tenant_id AND i.id = ev.incident_id LEFT JOIN ft ON i.tenant_id = ft.tenant_id AND i.id = ft.incident_id),
h AS (SELECT tenant_id, incident_id, 1::BIGINT AS rank, 'COOLANT_FLOW_STARVATION' AS failure_mode, 0.88::DOUBLE AS probability, true AS verified, n AS n_evidence FROM b WHERE fires
  UNION ALL SELECT tenant_id, incident_id, 2, 'THERMOCOUPLE_CALIBRATION_DRIFT', 0.12::DOUBLE, false, n FROM b WHERE fires UNION ALL SELECT tenant_id, incident_id, 1, 'UNSPECIFIED_ANOMALY', 0.75::DOUBLE, false, n FROM b WHERE NOT fires)"""

_GUARD = """
st AS (SELECT tenant_id, entity_id, arg_max(state, ts) AS state FROM (SELECT tenant_id, entity_id, ts, max(state) AS state FROM states GROUP BY ALL) GROUP BY ALL),
ra AS (SELECT tenant_id, entity_id, count(*) AS n FROM action_times WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR GROUP BY ALL),
b AS (SELECT p.*, coalesce(st.state, 'RUNNING_NORMAL') AS state, coalesce(ra.n, 0) AS recent, TRY_CAST(param_value AS DOUBLE) AS x, coalesce(max_rpm, 24000) AS max_rpm, coalesce(max_pressure_bar, 250) AS max_p, coalesce(min_pressure_bar, 0) AS min_p, coalesce(max_temperature_celsius, 90) AS max_t
  FROM proposals p LEFT JOIN st ON p.tenant_id = st.tenant_id AND p.target_entity_id = st.entity_id LEFT JOIN envelopes e ON p.tenant_id = e.tenant_id AND p.target_entity_id = e.entity_id LEFT JOIN ra ON p.tenant_id = ra.tenant_id AND p.target_entity_id = ra.entity_id),
c AS (
SELECT tenant_id, id, 1::BIGINT AS check_no, 'HUMAN_APPROVAL_GATE' AS check_name, approval_status = 'APPROVED' AS passed, 'approval status is ' || approval_status AS reason FROM b
UNION ALL SELECT tenant_id, id, 2, 'EMERGENCY_STOP_OVERRIDE', state <> 'EMERGENCY_STOP', 'asset is in emergency stop' FROM b
UNION ALL SELECT tenant_id, id, 3, 'ACTIVE_RUNNING_CRITICAL_LOCKOUT', NOT (regexp_matches(command_type, 'SETPOINT|MODIFY|OVERRIDE') AND state = 'RUNNING_CRITICAL'), 'no parameter change while running critical' FROM b
UNION ALL SELECT tenant_id, id, 4, 'PARAMETER_BOUNDS_CHECK', NOT coalesce(CASE param WHEN 'targetPressureBar' THEN x > max_p OR x < min_p WHEN 'targetRpm' THEN x > max_rpm OR x < 0 ELSE x > max_t END, false),
  CASE param WHEN 'targetPressureBar' THEN 'pressure ' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ' outside ' || CAST(CAST(min_p AS BIGINT) AS VARCHAR) || ' - ' || CAST(CAST(max_p AS BIGINT) AS VARCHAR)
   WHEN 'targetRpm' THEN 'speed ' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ' exceeds ' || CAST(CAST(max_rpm AS BIGINT) AS VARCHAR) ELSE 'temperature ' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ' exceeds ' || CAST(CAST(max_t AS BIGINT) AS VARCHAR) END FROM b
UNION ALL SELECT tenant_id, id, 5, 'ACTUATOR_RATE_LIMIT', recent < 5, CAST(recent AS VARCHAR) || ' actions in the past hour, limit 5' FROM b),
v AS (SELECT tenant_id, id AS proposal_id, bool_and(passed) AS can_execute, arg_min(reason, check_no) FILTER (NOT passed) AS blocked_reason FROM c GROUP BY ALL)"""

_STATUS = """CASE WHEN CASE o WHEN '<' THEN value < t WHEN '<=' THEN value <= t WHEN '>' THEN value > t ELSE value >= t END THEN 'RESOLVED_HEALTHY'
 WHEN CASE WHEN o IN ('<', '<=') THEN value > b + 1.0 ELSE value < b - 0.2 END THEN 'DETERIORATING' WHEN elapsed_minutes > w THEN 'TIMEOUT_FAILED' ELSE 'MONITORING_IN_PROGRESS' END"""
_COND = "coalesce(baseline_value, 70) AS b, coalesce(target_healthy_value, 60) AS t, coalesce(comparison_operator, '<=') AS o, coalesce(max_evaluation_window_minutes, 30) AS w"


def _xor(byte: int) -> str:
    return bytes(x ^ byte for x in b"plant-audit-key".ljust(64, b"\0")).hex()


_MESSAGE = """('{"tenantId":"' || tenant_id || '","actorId":"' || actor_id || '","actorEmail":"' || actor_email || '","actorRole":"' || actor_role || '","action":"' || action || '","resourceType":"' || resource_type
 || '","resourceId":"' || coalesce(resource_id, '') || '","details":' || details || ',"status":"' || status || '","timestamp":"' || "timestamp" || '"}')"""
_HMAC = f"sha256(unhex('{_xor(0x5C)}') || unhex(sha256(unhex('{_xor(0x36)}') || encode({_MESSAGE}))))"

_SIM = lambda a, b: f"(CASE WHEN lower({a}) = lower({b}) THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))::DOUBLE END)"
_RESOLVE = f"""
m AS (SELECT i.tenant_id, i.in_id, e.id AS e_id, e.seq, CASE WHEN lower(e.canonical_id) = lower(i.canonical_id) THEN 1.0 WHEN lower(e.tag) = lower(i.tag) THEN 0.98 WHEN e.entity_type <> i.entity_type THEN 0.0
  ELSE floor((0.3::DOUBLE + {_SIM('i.name', 'e.name')} * 0.5 + CASE WHEN i.model IS NULL OR e.model IS NULL THEN 0 ELSE {_SIM('i.model', 'e.model')} * 0.2 END) / (0.8::DOUBLE + CASE WHEN i.model IS NULL OR e.model IS NULL THEN 0 ELSE 0.2::DOUBLE END) * 100 + 0.5) / 100 END AS confidence
  FROM incoming_parts i JOIN existing_parts e ON i.tenant_id = e.tenant_id),
b AS (SELECT tenant_id, in_id, arg_max(e_id, (confidence, -seq)) AS e_id, max(confidence) AS c FROM m WHERE confidence > 0 GROUP BY ALL),
r AS (SELECT i.*, CASE WHEN c >= 0.8 THEN 'MERGED_AUTOMATIC' WHEN c >= 0.5 THEN 'QUEUED_FOR_REVIEW' ELSE 'CREATED_NEW' END AS action, CASE WHEN c >= 0.5 THEN e_id END AS matched_id, CASE WHEN c >= 0.5 THEN c ELSE 1.0 END::DOUBLE AS confidence FROM incoming_parts i LEFT JOIN b USING (tenant_id, in_id))"""

_ACTIVE = "act AS (SELECT * FROM edges WHERE valid_from <= TIMESTAMP '1997-03-01 00:00:00' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1997-03-01 00:00:00'))"
_BOTH = """WITH RECURSIVE """ + _ACTIVE + """,
st AS (SELECT tenant_id, source_id AS a, target_id AS b FROM act UNION ALL SELECT tenant_id, target_id, source_id FROM act),
w AS (SELECT tenant_id, id AS root_id, id AS node_id, 0 AS depth FROM nodes WHERE entity_type = 'Line' UNION SELECT w.tenant_id, w.root_id, st.b, w.depth + 1 FROM w JOIN st ON w.tenant_id = st.tenant_id AND w.node_id = st.a WHERE w.depth < {depth}),
m AS (SELECT tenant_id, root_id, node_id, min(depth)::BIGINT AS depth FROM w GROUP BY ALL)"""

_LINES = r"""
l AS (SELECT tenant_id, id, generate_subscripts(string_split(content, chr(10)), 1) AS n, unnest(string_split(content, chr(10))) AS line FROM docs),
a AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l),
b AS (SELECT *, starts_with(t, '#') AS h, NOT starts_with(t, '#') AND (starts_with(t, '|') OR ends_with(t, '|') OR length(t) - length(replace(t, '|', '')) >= 2) AS tb FROM a),
c AS (SELECT *, coalesce(last_value(CASE WHEN h THEN regexp_replace(t, '^#+\s*', '') END IGNORE NULLS) OVER w, 'General Overview') AS section, CASE WHEN tb THEN sum(CASE WHEN tb THEN 0 ELSE 1 END) OVER w END AS run FROM b WINDOW w AS (PARTITION BY tenant_id, id ORDER BY n ROWS UNBOUNDED PRECEDING))"""



def chunks_sql(source: str, size: int = 800, overlap: int = 100) -> str:
    """Common tables that cut ``source(tenant_id, id, seq, content)`` line by line; ``ck`` has the chunks."""
    bare = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    kept = lambda e: f"greatest(b, least(len(list_filter(upto, lambda x: x <= upto[{e} + 1] - {overlap})) - 1, {e} - 1))"
    return rf"""
cd0 AS (SELECT tenant_id, id, seq, string_split(content, chr(10)) AS lines FROM {source} WHERE content IS NOT NULL),
cd1 AS (SELECT *, list_transform(lines, lambda x: {bare}) AS bare FROM cd0),
cd2 AS (SELECT *, list_transform(bare, lambda x: starts_with(x, '#')) AS hd, list_transform(bare, lambda x: NOT starts_with(x, '#') AND (starts_with(x, '|') OR ends_with(x, '|') OR length(x) - length(replace(x, '|', '')) >= 2)) AS tb,
  list_transform(range(0, len(lines) + 1), lambda k: coalesce(list_sum(list_transform(lines[1:k], lambda x: length(x) + 1)), 0)) AS upto,
  list_transform(range(0, len(lines) + 1), lambda k: len(list_filter(bare[1:k], lambda x: x <> ''))) AS ink FROM cd1),
cr AS (SELECT tenant_id, id, 0::BIGINT AS i, 0::BIGINT AS b, NULL::BIGINT AS s1, NULL::BIGINT AS e1 FROM cd2
  UNION ALL SELECT r.tenant_id, r.id, r.i + 1,
    CASE WHEN tb[i + 1] THEN i + 1 WHEN hd[i + 1] THEN CASE WHEN ink[i + 1] > ink[b + 1] THEN {kept('i')} ELSE b END
         WHEN upto[i + 2] - upto[b + 1] >= {size} AND ink[i + 2] > ink[b + 1] THEN {kept('(i + 1)')} ELSE b END,
    CASE WHEN tb[i + 1] OR hd[i + 1] THEN CASE WHEN ink[i + 1] > ink[b + 1] THEN b END WHEN upto[i + 2] - upto[b + 1] >= {size} AND ink[i + 2] > ink[b + 1] THEN b END,
    CASE WHEN tb[i + 1] OR hd[i + 1] THEN i ELSE i + 1 END
  FROM cr r JOIN cd2 d ON r.tenant_id = d.tenant_id AND r.id = d.id WHERE r.i < len(d.lines)),
ce AS (SELECT tenant_id, id, i, 0 AS k, s1 AS s, e1 AS e, false AS is_table FROM cr WHERE s1 IS NOT NULL
  UNION ALL SELECT r.tenant_id, r.id, r.i, 2, b, r.i, false FROM cr r JOIN cd2 d ON r.tenant_id = d.tenant_id AND r.id = d.id WHERE r.i = len(d.lines) AND ink[r.i + 1] > ink[b + 1]
  UNION ALL SELECT tenant_id, id, max(n), 1, min(n) - 1, max(n), true FROM (SELECT tenant_id, id, n, n - row_number() OVER (PARTITION BY tenant_id, id ORDER BY n) AS g FROM (SELECT tenant_id, id, unnest(range(1, len(lines) + 1)) AS n, unnest(tb) AS t FROM cd2) WHERE t) GROUP BY tenant_id, id, g),
ck AS (SELECT c.tenant_id, c.id AS document_id, d.seq, row_number() OVER (PARTITION BY c.tenant_id, c.id ORDER BY c.i, c.k) - 1 AS chunk_index, is_table,
  regexp_replace(array_to_string(lines[s + 1:e], chr(10)), '^\s+|\s+$', '', 'g') AS content,
  coalesce(regexp_replace(list_filter(bare[1:e], lambda x: starts_with(x, '#'))[-1], '^#+\s*', ''), 'General Overview') AS section_header
  FROM ce c JOIN cd2 d ON c.tenant_id = d.tenant_id AND c.id = d.id)"""


_CODES = r"list_distinct(list_transform(regexp_extract_all(content, '(?i)\b((?:E|W|A|F|ALM|ERR|CODE)[-_]?(?:[A-Za-z0-9]{1,6}[-_])?[0-9]{2,6}[A-Za-z]?)\b', 1), lambda x: upper(x)))"
_TOK = lambda c: rf"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\-_./]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_FORMS = lambda c: f"flatten(list_transform({_TOK(c)}, lambda x: CASE WHEN contains(x, '-') THEN [x, replace(x, '-', '')] ELSE [x] END))"
_MANUALS = "WITH RECURSIVE " + chunks_sql("manuals").strip() + rf""",
mc AS (SELECT *, tenant_id || document_id || '_' || chunk_index AS cid, {_CODES} AS codes, {_FORMS('content')} AS forms FROM ck),
ln AS (SELECT tenant_id, cid, len(forms) AS len FROM mc), st AS (SELECT tenant_id, avg(len) AS mean, count(*) AS n FROM ln GROUP BY ALL),
tf AS (SELECT tenant_id, cid, term, sum(w) AS tf FROM (SELECT tenant_id, cid, unnest(forms) AS term, 1 AS w FROM mc UNION ALL SELECT tenant_id, cid, lower(unnest(codes)), 5 FROM mc) GROUP BY ALL),
df AS (SELECT tenant_id, term, count(*) AS df FROM tf GROUP BY ALL),
qp AS (SELECT tenant_id, query_id, upper(regexp_replace(query, '^\s+|\s+$', '', 'g')) AS q, unnest({_FORMS('query')}) AS term, generate_subscripts({_FORMS('query')}, 1) AS p FROM asked_manuals),
hit AS (SELECT q.tenant_id, q.query_id, q.p, q.term, tf.cid, tf.tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (greatest(len, 1) / mean))) AS s
  FROM qp q JOIN tf ON q.tenant_id = tf.tenant_id AND q.term = tf.term JOIN df ON df.tenant_id = tf.tenant_id AND df.term = tf.term JOIN st ON st.tenant_id = tf.tenant_id JOIN ln ON ln.tenant_id = tf.tenant_id AND ln.cid = tf.cid),
bo AS (SELECT q.tenant_id, q.query_id, q.q, m.cid, len(list_filter(codes, lambda x: contains(q.q, x))) > 0 AS code, section_header, contains(q.q, upper(section_header)) AS head FROM (SELECT DISTINCT tenant_id, query_id, q FROM qp) q JOIN mc m ON m.tenant_id = q.tenant_id),
al AS (SELECT tenant_id, query_id, cid, s, p AS first, 1 AS k, p, 'Matched keyword "' || term || '" (TF: ' || tf || ', IDF: ' || printf('%.2f', idf) || ')' AS reason FROM hit
  UNION ALL SELECT tenant_id, query_id, cid, 50.0, NULL, 0, 0, 'Exact industrial error code match [' || q || ']' FROM bo WHERE code
  UNION ALL SELECT tenant_id, query_id, cid, 10.0, NULL, 2, 0, 'Matched section header "' || section_header || '"' FROM bo WHERE head),
sm AS (SELECT tenant_id, query_id, cid, floor(sum(s) * 100 + 0.5) / 100 AS score, min(first) AS first, string_agg(reason, ' | ' ORDER BY k, p) AS reasons FROM al GROUP BY ALL),
rk AS (SELECT sm.*, document_id, chunk_index, row_number() OVER (PARTITION BY sm.tenant_id, query_id ORDER BY score DESC, first NULLS LAST, seq, chunk_index) AS rank FROM sm JOIN mc ON mc.cid = sm.cid WHERE score > 0)
SELECT tenant_id, query_id, document_id, chunk_index, score, rank, reasons FROM rk WHERE rank <= 20"""

_FULL = "WITH RECURSIVE " + chunks_sql("manuals").strip() + f""",
cc AS (SELECT *, {_CODES} AS codes FROM ck),
wo AS (SELECT tenant_id, target_entity_id, count(*) AS n FROM proposals WHERE command_type = 'CREATE_WORK_ORDER' AND approval_status = 'PENDING' GROUP BY ALL),
ev AS (SELECT tenant_id, incident_id, count(*) AS n FROM telemetry WHERE threshold IS NOT NULL AND {_SENT} GROUP BY ALL),
mn AS (SELECT c.tenant_id, e.error_code, count(*) AS n FROM cc c JOIN (SELECT DISTINCT tenant_id, error_code FROM incidents) e ON e.tenant_id = c.tenant_id AND (list_contains(c.codes, e.error_code) OR contains(lower(c.content), lower(e.error_code))) GROUP BY ALL),
ft AS (SELECT tenant_id, incident_id, arg_min(value, seq) FILTER (contains(lower(metric), 'temp')) AS x FROM telemetry GROUP BY ALL),
b AS (SELECT i.tenant_id, i.id AS incident_id, i.error_code, coalesce(a.name, i.target_entity_id) AS target, coalesce(ev.n, 0) AS s, coalesce(mn.n, 0) AS m, coalesce(wo.n, 0) AS w, i.error_code = 'E-4012' OR coalesce(ft.x > 68, false) AS fires
  FROM incidents i LEFT JOIN ev ON i.tenant_id = ev.tenant_id AND i.id = ev.incident_id LEFT JOIN ft ON i.tenant_id = ft.tenant_id AND i.id = ft.incident_id LEFT JOIN mn ON i.tenant_id = mn.tenant_id AND i.error_code = mn.error_code
  LEFT JOIN wo ON i.tenant_id = wo.tenant_id AND i.target_entity_id = wo.target_entity_id LEFT JOIN assets a ON a.tenant_id = i.tenant_id AND a.id = i.target_entity_id),
c AS (SELECT *, s + m + w AS n, CASE WHEN fires THEN 2 ELSE 1 END AS nh, CASE WHEN fires THEN 2 ELSE 0 END AS nr FROM b)"""

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_BUCKET = lambda t: f"(CAST(('0x' || substr(md5({t}), 1, 4)) AS INTEGER) % 64)"

_QWORDS = _WORDS.replace("content", "query")
_HYBRID = _BM25[: _BM25.index("SELECT tenant_id, query_id, doc_id, score, rank FROM k")].rstrip() + f""",
dw AS (SELECT tenant_id, id, seq, unnest({_WORDS}) AS t FROM docs), qw AS (SELECT tenant_id, query_id, unnest({_QWORDS}) AS t FROM asked),
dg AS (SELECT tenant_id, id, seq, {_BUCKET('t')} AS b, 2.0::DOUBLE AS w FROM dw UNION ALL SELECT tenant_id, id, seq, {_BUCKET('g')}, 0.5 FROM (SELECT tenant_id, id, seq, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM dw WHERE length(t) >= 4)),
qg AS (SELECT tenant_id, query_id, {_BUCKET('t')} AS b, 2.0::DOUBLE AS w FROM qw UNION ALL SELECT tenant_id, query_id, {_BUCKET('g')}, 0.5 FROM (SELECT tenant_id, query_id, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM qw WHERE length(t) >= 4)),
ds AS (SELECT tenant_id, id, seq, b, sum(w) AS w FROM dg GROUP BY ALL), qs AS (SELECT tenant_id, query_id, b, sum(w) AS w FROM qg GROUP BY ALL),
dn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY tenant_id, id)) AS v FROM ds), qn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY tenant_id, query_id)) AS v FROM qs),
vc AS (SELECT dn.tenant_id, query_id, id, seq, floor(least(1, sum(dn.v * qn.v)) * 1000 + 0.5) / 1000 AS sim FROM dn JOIN qn ON dn.tenant_id = qn.tenant_id AND dn.b = qn.b GROUP BY ALL),
vr AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY sim DESC, seq) AS rank FROM vc),
gr AS (SELECT d.tenant_id, a.query_id, d.id, row_number() OVER (PARTITION BY d.tenant_id, a.query_id ORDER BY d.seq) AS rank FROM docs d JOIN asked a ON d.tenant_id = a.tenant_id WHERE a.query_id <> 'q5' AND d.seq % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)),
un AS (SELECT tenant_id, query_id, doc_id AS id, rank AS b, NULL AS v, NULL AS g, score AS bs, NULL AS vs, NULL AS gs FROM k UNION ALL SELECT tenant_id, query_id, id, NULL, rank, NULL, NULL, sim, NULL FROM vr WHERE rank <= 30 UNION ALL SELECT tenant_id, query_id, id, NULL, NULL, rank, NULL, NULL, 1.0 FROM gr),
fu AS (SELECT tenant_id, query_id, id, max(b) AS b, max(v) AS v, max(g) AS g, max(bs) AS bs, max(vs) AS vs, max(gs) AS gs FROM un GROUP BY ALL),
sc2 AS (SELECT *, floor((coalesce(1.0::DOUBLE / (60 + b), 0) + coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.5::DOUBLE / (60 + g), 0)) * 10000 + 0.5) / 10000 AS rrf FROM fu),
rk AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY rrf DESC, b NULLS LAST, v NULLS LAST, g NULLS LAST) AS rank FROM sc2)
SELECT tenant_id, query_id, rank, id AS document_id, rrf AS rrf_score, coalesce(bs, 0)::DOUBLE AS bm25_score, coalesce(vs, 0)::DOUBLE AS vector_score, coalesce(gs, 0)::DOUBLE AS graph_score FROM rk WHERE rank <= 10"""

_RAW = {
    "bm25_search": _BM25,
    "hybrid_search": _HYBRID,
    "profile_columns": _PROFILE,
    "detect_delimiter": r"""WITH o AS (SELECT o_custkey % 200 AS f, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS n, CAST(o_orderkey AS VARCHAR) || sep || o_orderstatus || sep || '"a' || sep || 'b"' AS line
  FROM (SELECT *, [',', ';', chr(9), '|'][(o_custkey % 200) % 4 + 1] AS sep FROM orders)),
b AS (SELECT f, regexp_replace(line, '"[^"]*"?', '', 'g') AS line FROM o WHERE n <= 10),
c AS (SELECT f, k, d, min(len(string_split(line, d))) AS lo, max(len(string_split(line, d))) AS hi FROM b, (SELECT unnest([0, 1, 2, 3]) AS k, unnest([',', ';', chr(9), '|']) AS d) GROUP BY ALL)
SELECT 'f' || CAST(f AS VARCHAR) AS file, coalesce(arg_max(d, (lo, -k)) FILTER (lo = hi AND lo > 1), ',') AS delimiter FROM c GROUP BY f""",
    "ingest_outcomes": "WITH " + _TAGGED.strip() + """
SELECT tenant_id, job_id, row_index, outcome, sha256(raw_json) AS row_hash, coalesce(CASE WHEN raw_json[1] = '{' THEN nullif(nullif(json_extract_string(raw_json, '$.order_id'), '0'), '') END, CASE WHEN raw_json[1] = '{' THEN json_extract_string(raw_json, '$.sku') END, 'ext_' || CAST(row_index AS VARCHAR)) AS external_id, bad_key FROM t""",
    "job_summary": "WITH " + _TAGGED.strip() + """
SELECT tenant_id, job_id, count(*) AS total_rows, count(*) FILTER (outcome = 'VALID') AS valid_rows, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate_rows, count(*) FILTER (outcome NOT IN ('VALID', 'DUPLICATE')) AS error_rows,
  CASE WHEN count(*) FILTER (outcome NOT IN ('VALID', 'DUPLICATE')) = 0 THEN 'COMPLETED' WHEN count(*) FILTER (outcome = 'VALID') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM t GROUP BY ALL""",
    "dead_letters": "WITH " + _TAGGED.strip() + """
SELECT tenant_id, job_id, row_index, outcome AS error_code, CASE WHEN outcome = 'EMPTY_OR_INVALID_ROW' THEN 'Row is empty, null or not an object' ELSE 'Forbidden key: ' || bad_key END AS error_message FROM t WHERE outcome NOT IN ('VALID', 'DUPLICATE')""",
    "extract_records": r"""WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"data":{"items":[{"id":' || CAST(event_id AS VARCHAR) || '},{"id":2},3]}}' WHEN 1 THEN '{"data":{"items":{"id":1}}}' WHEN 3 THEN '{"data":{}}' WHEN 4 THEN '{"data":{"items":5}}' END AS body FROM events),
t AS (SELECT event_id, body, json_type(body, '$.data.items') AS k, json_extract(body, '$.data.items') AS x FROM b)
SELECT event_id, CASE k WHEN 'ARRAY' THEN len(list_filter(CAST(x AS JSON[]), lambda y: json_type(y) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END::BIGINT AS n_records, body IS NOT NULL AND coalesce(k NOT IN ('ARRAY', 'OBJECT'), true) AS failed FROM t""",
    "accept_pages": """WITH n AS (SELECT 's' || CAST(user_id AS VARCHAR) AS source, day(ts)::BIGINT AS page, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT *, max(CASE WHEN n < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM n WHERE page BETWEEN 1 AND 20) SELECT source, page, n FROM b WHERE coalesce(s, 0) = 0""",
    "incremental_read": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500",
    "incremental_cursor": "SELECT max(event_id) AS next_cursor FROM (SELECT event_id FROM events WHERE event_id > 50 ORDER BY event_id LIMIT 100)",
    "classify_url": r"""WITH u AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'http://169.254.169.254/latest' WHEN 1 THEN 'http://10.1.2.3/x' WHEN 2 THEN 'ftp://host/x' WHEN 3 THEN 'http://[::1]:80/' WHEN 4 THEN 'http://LOCALHOST/' WHEN 5 THEN 'http://2130706433/' WHEN 6 THEN 'no url' ELSE url END AS url FROM pages),
a AS (SELECT page_id, lower(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), '')) AS protocol, lower(regexp_replace(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '^\[|\]$', '', 'g')) AS h FROM u),
h AS (SELECT page_id, protocol, CASE WHEN regexp_full_match(h, '[0-9]{1,10}') AND CAST(h AS BIGINT) < 4294967296 THEN (CAST(h AS BIGINT) >> 24) % 256 || '.' || (CAST(h AS BIGINT) >> 16) % 256 || '.' || (CAST(h AS BIGINT) >> 8) % 256 || '.' || CAST(h AS BIGINT) % 256 ELSE h END AS host FROM a)
SELECT page_id, CASE WHEN protocol IS NULL THEN 'MALFORMED' WHEN protocol NOT IN ('http', 'https') THEN 'BAD_PROTOCOL' WHEN host = '' THEN 'MALFORMED' WHEN host IN ('169.254.169.254', 'metadata.google.internal', 'instance-data') THEN 'METADATA_HOST'
 WHEN regexp_matches(host, '^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') OR host IN ('localhost', '::1') OR starts_with(host, 'fc') OR starts_with(host, 'fd') OR starts_with(host, 'fe80:') THEN 'PRIVATE_HOST' ELSE 'OK' END AS verdict FROM h""",
    "flag_unsafe_sql": r"""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'SELECT * FROM orders WHERE id = ' || o_orderkey WHEN 1 THEN ' with x as (select 1) select * from x;   ' WHEN 2 THEN 'SELECT 1; DROP TABLE orders' WHEN 3 THEN 'delete from orders where id=' || o_orderkey WHEN 4 THEN '  '
  WHEN 5 THEN 'SELECT ''truncate'' AS x' WHEN 6 THEN 'SELECT a INTO  OUTFILE ''x'' ' WHEN 7 THEN 'WITH t AS (SELECT 1) COPY t  TO ''x'' ' WHEN 8 THEN 'SELECT created_at, updates FROM t' || o_orderkey ELSE '' END AS sql FROM orders),
s AS (SELECT o_orderkey, trim(sql) AS s FROM q)
SELECT o_orderkey, CASE WHEN s = '' THEN 'EMPTY' WHEN len(list_filter(string_split(s, ';'), lambda x: trim(x) <> '')) > 1 THEN 'MULTI_STATEMENT' WHEN NOT regexp_matches(s, '(?i)^(SELECT|WITH)\b') THEN 'NOT_SELECT' """
    + " ".join(rf"WHEN regexp_matches(s, '(?i)\b{k}\b') THEN 'FORBIDDEN:{k}'" for k in KEYWORDS)
    + r""" WHEN regexp_matches(s, '(?i)\bINTO\b\s+OUTFILE') THEN 'FORBIDDEN:INTO OUTFILE' WHEN regexp_matches(s, '(?i)\bCOPY\b\s+.*\s+TO\b') THEN 'FORBIDDEN:COPY TO' END AS violation FROM s""",
    "flag_bad_identifier": "SELECT p_partkey, NOT regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END, '[a-zA-Z_][a-zA-Z0-9_]*') AS bad FROM part",
    "graph_stats": """SELECT tenant_id, 'nodes' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT tenant_id, 'category', category, count(*) FROM nodes GROUP BY ALL
UNION ALL SELECT tenant_id, 'entity_type', entity_type, count(*) FROM nodes GROUP BY ALL UNION ALL SELECT tenant_id, 'edges', NULL, count(*) FROM edges GROUP BY ALL""",
    "check_endpoints": "WITH k AS (SELECT tenant_id, id FROM nodes WHERE seq % 10 <> 3) SELECT tenant_id, id, (tenant_id, source_id) IN (SELECT tenant_id, id FROM k) AND (tenant_id, target_id) IN (SELECT tenant_id, id FROM k) AS ok FROM edges",
    "traverse_down": "WITH RECURSIVE " + _ACTIVE + """,
w AS (SELECT tenant_id, id AS root_id, id AS node_id, 0::BIGINT AS depth, CAST(NULL AS VARCHAR) AS edge_id FROM nodes WHERE entity_type = 'Plant' UNION ALL SELECT w.tenant_id, w.root_id, a.target_id, w.depth + 1, a.id FROM w JOIN act a ON w.tenant_id = a.tenant_id AND w.node_id = a.source_id WHERE w.depth < 3) SELECT * FROM w""",
    "traverse_up": "WITH RECURSIVE " + _ACTIVE + """,
w AS (SELECT tenant_id, id AS root_id, id AS node_id, 0::BIGINT AS depth, 'DOWNSTREAM' AS dir FROM nodes WHERE entity_type = 'WorkOrder' UNION ALL SELECT w.tenant_id, w.root_id, a.source_id, w.depth + 1, 'UPSTREAM' FROM w JOIN act a ON w.tenant_id = a.tenant_id AND w.node_id = a.target_id WHERE w.depth < 3) SELECT * FROM w""",
    "traverse_both_asof": _BOTH.replace("{depth}", "2") + " SELECT * FROM m",
    "dossier_counts": _BOTH.replace("{depth}", "3") + """, x AS (SELECT m.*, n.entity_type, n.name, n.seq FROM m JOIN nodes n ON m.tenant_id = n.tenant_id AND m.node_id = n.id WHERE node_id <> root_id)
SELECT tenant_id, root_id, max(name) FILTER (entity_type = 'Plant') AS plant, count(*) FILTER (entity_type = 'Sensor') AS n_sensors, count(*) FILTER (entity_type = 'WorkOrder') AS n_work_orders, count(*) FILTER (entity_type = 'Batch') AS n_products FROM x GROUP BY ALL""",
    "resolve_entities": "WITH " + _RESOLVE.strip() + " SELECT tenant_id, in_id, action, matched_id, confidence FROM r",
    "merge_nodes": "WITH " + _RESOLVE.strip() + """ SELECT e.tenant_id, e.id, count(*) AS n, 2::BIGINT AS version, max(greatest(length(e.name), length(r.name)))::BIGINT AS longest, (2 * count(*))::BIGINT AS n_refs
FROM existing_parts e JOIN r ON e.tenant_id = r.tenant_id AND e.id = r.matched_id WHERE action = 'MERGED_AUTOMATIC' GROUP BY ALL""",
    "chunk_structure": "WITH " + _LINES.strip() + " SELECT tenant_id, id, count(*) AS n_lines, count(*) FILTER (h) AS n_headers, count(*) FILTER (tb) AS n_table_lines, count(DISTINCT run) AS n_tables, count(DISTINCT section) AS n_sections FROM c GROUP BY ALL",
    "error_codes": r"""WITH a AS (SELECT event_id, 'Alarm e-' || CAST(event_id % 9000 + 1000 AS VARCHAR) || ' and ERR-HYD-' || CAST(event_id % 90 + 10 AS VARCHAR) || ' again E-' || CAST(event_id % 9000 + 1000 AS VARCHAR) || '.' || chr(10) || 'Max Pressure: ' || CAST(user_id AS VARCHAR) || ' bar, Speed = ' || CAST(event_id % 700 AS VARCHAR) || ' RPM' AS text FROM events),
c AS (SELECT *, list_transform(regexp_extract_all(text, '(?i)\b((?:E|W|A|F|ALM|ERR|CODE)[-_]?(?:[A-Za-z0-9]{1,6}[-_])?[0-9]{2,6}[A-Za-z]?)\b', 1), lambda x: upper(x)) AS l,
  list_transform(regexp_extract_all(text, '(?i)([A-Za-z\s]+)[:=]\s*([0-9.]+\s*(?:bar|psi|rpm|mm|m/s|kw|v|vac|vdc|hz|khz|c|°c|celsius|kg|kn))\b', 1), lambda x: trim(x, chr(10) || ' ')) AS names,
  regexp_extract_all(text, '(?i)([A-Za-z\s]+)[:=]\s*([0-9.]+\s*(?:bar|psi|rpm|mm|m/s|kw|v|vac|vdc|hz|khz|c|°c|celsius|kg|kn))\b', 2) AS vals FROM a)
SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS codes, vals[list_position(names, 'Max Pressure')] AS pressure, len(list_distinct(names))::BIGINT AS n_specs, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM c""",
    "hash_embedding": f"""WITH w AS (SELECT id, unnest({_WORDS}) AS t FROM docs),
g AS (SELECT id, {_BUCKET('t')} AS bucket, 2.0::DOUBLE AS v FROM w UNION ALL SELECT id, {_BUCKET('g')}, 0.5 FROM (SELECT id, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM w WHERE length(t) >= 4)),
s AS (SELECT id, bucket::BIGINT AS bucket, sum(v) AS v FROM g GROUP BY ALL) SELECT id, bucket, floor(v / sqrt(sum(v * v) OVER (PARTITION BY id)) * 100000 + 0.5) / 100000 AS v FROM s""",
    "vector_topk": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
p AS (SELECT a.label, a.vec_id AS q, b.vec_id AS c, list_dot_product(a.v, b.v) / (a.n * b.n) AS cos FROM u a JOIN u b ON a.label = b.label WHERE a.vec_id % 100 = 0),
r AS (SELECT *, floor(least(1, cos) * 1000 + 0.5) / 1000 AS similarity FROM p WHERE cos > 0), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM r)
SELECT CAST(label AS VARCHAR) AS tenant_id, CAST(q AS VARCHAR) AS query_id, CAST(c AS VARCHAR) AS chunk_id, similarity, rank FROM k WHERE rank <= 5""",
    "correlate": _CORRELATE,
    "breach_flags": f"""SELECT seq, coalesce(contains(lower(metric), 'pressure') AND threshold <> 0 AND value < threshold, false) AS pressure, coalesce(contains(lower(metric), 'temp') AND threshold <> 0 AND value > threshold, false) AS temp,
 coalesce(contains(lower(metric), 'vib') AND threshold <> 0 AND value > threshold, false) AS vib, coalesce({_SENT}, false) AS deviates, coalesce(CASE WHEN contains(lower(metric), 'temp') THEN value > threshold WHEN contains(lower(metric), 'press') THEN value < threshold END, false) AS alert FROM telemetry""",
    "rca_evidence": f"SELECT tenant_id, incident_id, count(*) AS n, floor(count(*) * 0.98::DOUBLE * 100 + 0.5) / 100 AS weight FROM telemetry WHERE threshold IS NOT NULL AND {_SENT} GROUP BY ALL",
    "rca_hypotheses": "WITH " + _HYP.strip() + " SELECT * FROM h",
    "analyze_incidents": "WITH " + _HYP.strip() + """, c AS (SELECT b.*, CASE WHEN fires THEN 2 ELSE 1 END AS nh, CASE WHEN fires THEN 2 ELSE 0 END AS nr FROM b)
SELECT tenant_id, incident_id, CASE WHEN fires THEN 'COOLANT_FLOW_STARVATION' ELSE 'UNSPECIFIED_ANOMALY' END AS top_cause, CASE WHEN fires THEN 0.88 ELSE 0.75 END::DOUBLE AS top_probability, nh::BIGINT AS n_hypotheses, nr::BIGINT AS n_recommendations, n AS n_evidence,
 CASE WHEN n = 0 THEN nh + nr ELSE 0 END::BIGINT AS unsupported_claims, 'Diagnostic investigation of ' || error_code || ' on ' || target_entity_id || '. Identified ' || nh || ' evidence-backed hypotheses and ' || nr || ' actionable recommendations.' AS summary FROM c""",
    "evaluate_guardrails": "WITH " + _GUARD.strip() + " SELECT tenant_id, id AS proposal_id, check_no, check_name, passed, CASE WHEN passed THEN 'INFO' ELSE 'CRITICAL_BLOCK' END AS severity FROM c",
    "guardrail_verdicts": "WITH " + _GUARD.strip() + " SELECT * FROM v",
    "plan_executions": "WITH " + _GUARD.strip() + """, x AS (SELECT p.tenant_id, p.id, p.system_target, p.approval_status, can_execute, CASE WHEN can_execute THEN 'exec_' ELSE 'exec_blocked_' END || substr(sha256(p.tenant_id || '|' || p.id || '|2024-01-20 12:00:00'), 1, 12) AS execution_id FROM proposals p JOIN v ON p.tenant_id = v.tenant_id AND p.id = v.proposal_id)
SELECT tenant_id, id AS proposal_id, execution_id, CASE WHEN can_execute THEN 'SUCCESS' ELSE 'GUARDRAIL_BLOCKED' END AS status, sha256(execution_id || ':' || id || ':' || CASE WHEN can_execute THEN system_target ELSE 'BLOCKED' END || ':2024-01-20 12:00:00') AS audit_checksum, CASE WHEN can_execute THEN 'EXECUTED' ELSE approval_status END AS proposal_status FROM x""",
    "apply_approvals": """WITH r AS (SELECT *, ['VIEWER', 'OPERATOR', 'MAINTENANCE_SUPERVISOR', 'PROCESS_ENGINEER', 'PLANT_MANAGER', 'SUPER_ADMIN'] AS l, ['VIEWER', 'OPERATOR', 'MAINTENANCE_SUPERVISOR', 'PROCESS_ENGINEER', 'PLANT_MANAGER', 'SUPER_ADMIN', 'ORG_ADMIN'][CAST(seq % 7 + 1 AS INT)] AS role FROM proposals),
s AS (SELECT *, seq % 2 = 0 AND coalesce(list_position(l, role), 0) >= coalesce(list_position(l, required_approval_role), 0) AS ok FROM r)
SELECT tenant_id, id, CASE WHEN ok THEN 'APPROVED' ELSE approval_status END AS approval_status, CASE WHEN ok THEN 'u' || CAST(seq AS VARCHAR) || '@example.com (' || role || ')' END AS approved_by FROM s""",
    "verify_feedback": f"""WITH j AS (SELECT e.*, r.value FROM executions e ASOF JOIN (SELECT tenant_id, entity_id, ts, arg_max(value, seq) AS value FROM telemetry GROUP BY ALL) r ON e.tenant_id = r.tenant_id AND e.entity_id = r.entity_id AND e.evaluated_at >= r.ts),
c AS (SELECT j.*, {_COND} FROM j LEFT JOIN conditions USING (tenant_id, proposal_id)), s AS (SELECT *, {_STATUS} AS feedback_status FROM c)
SELECT tenant_id, execution_id, value, feedback_status, feedback_status IN ('DETERIORATING', 'TIMEOUT_FAILED') AND rollback_enabled AS rollback_triggered FROM s""",
    "rollback_queue": f"""WITH c AS (SELECT e.*, elapsed_minutes * 7 % 90 AS value, {_COND} FROM executions e LEFT JOIN conditions USING (tenant_id, proposal_id)), s AS (SELECT *, {_STATUS} AS fs FROM c)
SELECT s.tenant_id, execution_id, proposal_id, p.system_target, 'ROLLBACK' AS command_type, p.param_value AS to_value FROM s JOIN proposals p ON s.tenant_id = p.tenant_id AND s.proposal_id = p.id WHERE fs IN ('DETERIORATING', 'TIMEOUT_FAILED') AND rollback_enabled""",
    "machine_states": "SELECT tenant_id, entity_id, arg_max(state, ts) AS state, max(ts) AS ts FROM (SELECT tenant_id, entity_id, ts, max(state) AS state FROM states GROUP BY ALL) GROUP BY ALL",
    "audit_checksums": f"SELECT id, {_HMAC} AS checksum FROM audit_raw",
    "verify_audit_summary": f"""WITH s AS (SELECT *, {_HMAC} AS checksum FROM audit_raw), t AS (SELECT * REPLACE (CASE WHEN substr(id, 2, 1) = '7' THEN 'TAMPERED' ELSE action END AS action) FROM s), v AS (SELECT *, checksum = {_HMAC} AS ok FROM t)
SELECT tenant_id, count(*) AS checked, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS tampered, bool_and(ok) AS is_intact, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT ok), '') AS corrupted_ids FROM v GROUP BY ALL""",
    "audit_page": f"""WITH s AS (SELECT *, {_HMAC} AS checksum FROM audit_raw), t AS (SELECT * REPLACE (CASE WHEN substr(id, 2, 1) = '7' THEN 'TAMPERED' ELSE action END AS action) FROM s), g AS (SELECT * FROM t WHERE contains(lower(action), 'ingest') AND status = 'SUCCESS')
SELECT id, tenant_id, action, "timestamp", (SELECT count(*) FROM g) AS total, checksum = {_HMAC} AS integrity_verified FROM g ORDER BY "timestamp" DESC, id LIMIT 20 OFFSET 10""",
    "access_gate": """SELECT request_id, user_id, tenant_id, CASE WHEN tenant_id NOT IN (SELECT id FROM orgs) THEN 'NOT_FOUND' WHEN user_id IN (SELECT id FROM users WHERE is_super_admin) OR (user_id, tenant_id) IN (SELECT user_id, tenant_id FROM memberships WHERE status = 'ACTIVE') THEN 'ALLOWED' ELSE 'TENANT_ACCESS_DENIED' END AS decision FROM requests""",
    "member_listing": "SELECT m.user_id, m.tenant_id, m.role, m.status, u.email, o.name AS org_name FROM memberships m LEFT JOIN users u ON m.user_id = u.id LEFT JOIN orgs o ON m.tenant_id = o.id",
    "organizations_of_users": "SELECT m.user_id, m.tenant_id, o.name AS org_name, m.role FROM memberships m JOIN orgs o ON m.tenant_id = o.id WHERE m.status = 'ACTIVE'",
    "role_checks": f"""WITH p AS (SELECT * FROM (VALUES {_MATRIX}) AS t(role, permission)), c AS (SELECT user_id || '/' || tenant_id AS check_id, role, unnest(['data:read', 'action:approve']) AS permission FROM memberships)
SELECT check_id, c.role, bool_and(p.role IS NOT NULL) AS has_all, bool_or(p.role IS NOT NULL) AS has_any FROM c LEFT JOIN p ON c.role = p.role AND c.permission = p.permission GROUP BY ALL""",
    "duplicate_keys": "SELECT lower(trim(p_name)) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "health_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")),
    "token_lengths": "WITH " + _TOKENS.strip() + f", c AS (SELECT id, count(*) AS n FROM terms GROUP BY ALL) SELECT d.id, coalesce(c.n, 0) AS n_tokens, coalesce(len({_WORDS}), 0)::BIGINT AS n_words FROM docs d LEFT JOIN c USING (id)",
    "term_buckets": f"SELECT DISTINCT p_name, {_BUCKET('p_name')}::BIGINT AS bucket FROM part",
    "list_nodes": "SELECT id, name, seq FROM nodes WHERE tenant_id = 't1' AND entity_type = 'Line'",
    "find_by_canonical": "SELECT id, canonical_id FROM nodes WHERE tenant_id = 't0' AND lower(canonical_id) = 'supplier#000000007' ORDER BY seq LIMIT 1",
    "filter_records": "WITH " + _TAGGED.strip() + """ SELECT tenant_id, job_id, row_index, coalesce(CASE WHEN raw_json[1] = '{' THEN nullif(nullif(json_extract_string(raw_json, '$.order_id'), '0'), '') END, CASE WHEN raw_json[1] = '{' THEN json_extract_string(raw_json, '$.sku') END, 'ext_' || CAST(row_index AS VARCHAR)) AS external_id, '1.0.0' AS schema_version FROM t WHERE outcome = 'VALID'""",
    "rows_by_tenant": "SELECT tenant_id, count(*) AS n FROM raw_rows GROUP BY ALL",
    "latest_orders": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50",
    "recent_actions": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY "timestamp" DESC, id) AS rank FROM audit_raw) SELECT tenant_id, id, action, rank FROM k WHERE rank <= 5""",
    "describe_tables": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE lower(column_type) END AS data_type,
 "null" = 'YES' AS nullable, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count, (SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE {t})""" for t in ("nation", "orders", "events")),
    "link_mentions": """WITH x AS (SELECT tenant_id, id, unnest(['Apache License', 'TOKEN', 'mit license']) AS k, lower(content) AS c FROM docs) SELECT tenant_id, id, string_agg(k, ',' ORDER BY k) AS links FROM x WHERE contains(c, lower(k)) GROUP BY ALL""",
    "first_mention": """WITH n AS (SELECT * FROM (VALUES ('n1', 'license', 'MIT', 1), ('n2', 'token', 'version 3', 2)) AS t(node_id, name, canonical_id, seq)),
h AS (SELECT tenant_id, d.id, n.seq, node_id FROM docs d JOIN n ON contains(lower(content), lower(name)) OR contains(lower(content), lower(canonical_id))) SELECT tenant_id, id, arg_min(node_id, seq) AS node_id FROM h GROUP BY ALL""",
    "apply_rejections": "SELECT tenant_id, id, CASE WHEN seq % 3 = 0 THEN 'REJECTED' ELSE approval_status END AS approval_status, CASE WHEN seq % 3 = 0 THEN 'no' END AS rejection_reason FROM proposals",
    "denied_permissions": f"""WITH p AS (SELECT * FROM (VALUES {_MATRIX}) AS t(role, permission))
SELECT user_id, tenant_id, role, 'PERMISSION_DENIED' AS action, 'BLOCKED' AS status FROM memberships m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.role = m.role AND p.permission = 'audit:export')""",
    "denied_audit": "SELECT tenant_id, count(*) AS n FROM requests WHERE tenant_id IN (SELECT id FROM orgs) AND user_id NOT IN (SELECT id FROM users WHERE is_super_admin) AND (user_id, tenant_id) NOT IN (SELECT user_id, tenant_id FROM memberships WHERE status = 'ACTIVE') GROUP BY ALL",
    "actions_last_hour": "SELECT p.tenant_id, p.id, (SELECT count(*) FROM action_times a WHERE a.tenant_id = p.tenant_id AND a.entity_id = p.target_entity_id AND a.ts > TIMESTAMP '2024-01-20 11:00:00') AS recent_actions FROM proposals p",
    "review_queue": "WITH " + _RESOLVE.strip() + " SELECT tenant_id, in_id AS candidate_id, matched_id AS primary_node_id, confidence, 'PENDING' AS status FROM r WHERE action = 'QUEUED_FOR_REVIEW'",
    "chunk_documents": "WITH RECURSIVE " + chunks_sql("docs").strip() + " SELECT tenant_id, document_id, chunk_index::BIGINT AS chunk_index, section_header, is_table, sha256(content) AS checksum, ceil(length(content) / 4)::BIGINT AS token_count FROM ck",
    "chunk_manuals": "WITH RECURSIVE " + chunks_sql("manuals").strip() + f""" SELECT tenant_id, document_id, chunk_index::BIGINT AS chunk_index, section_header, is_table, content, array_to_string(list_sort({_CODES}), ',') AS codes,
 CASE WHEN is_table THEN regexp_extract(content, '\\| (E-[0-9]+) \\|', 1) END AS cell FROM ck""",
    "search_manuals": _MANUALS,
    "rca_evidence_full": _FULL + " SELECT tenant_id, incident_id, s::BIGINT AS n_readings, m::BIGINT AS n_manuals, w::BIGINT AS n_work_orders, floor((s * 0.98::DOUBLE + m * 0.95::DOUBLE + w * 0.9::DOUBLE) * 100 + 0.5) / 100 AS weight FROM c WHERE n > 0",
    "analyze_incidents_full": _FULL + """ SELECT tenant_id, incident_id, nh::BIGINT AS n_hypotheses, nr::BIGINT AS n_recommendations, n::BIGINT AS n_evidence,
 (CASE WHEN fires THEN (CASE WHEN s + m = 0 THEN 1 ELSE 0 END + CASE WHEN s = 0 THEN 1 ELSE 0 END) WHEN n = 0 THEN 1 ELSE 0 END + CASE WHEN n = 0 THEN nr ELSE 0 END)::BIGINT AS unsupported_claims,
 'Diagnostic investigation of ' || error_code || ' on ' || target || '. Identified ' || nh || ' evidence-backed hypotheses and ' || nr || ' actionable recommendations.' AS summary FROM c""",
    "resolve_reasons": "WITH " + _RESOLVE.strip() + f""",
x AS (SELECT r.tenant_id, r.in_id, r.name, r.model, r.tag, r.canonical_id, r.confidence, e.canonical_id AS ec, e.tag AS et, e.name AS en, e.model AS em, e.entity_type AS ty FROM r JOIN existing_parts e ON e.tenant_id = r.tenant_id AND e.id = r.matched_id)
SELECT tenant_id, in_id, CASE WHEN lower(ec) = lower(canonical_id) THEN 'Exact canonical ID match: "' || ec || '"' WHEN lower(et) = lower(tag) THEN 'Exact asset tag/serial match: "' || et || '"'
 ELSE 'Same entity type: ' || ty || CASE WHEN {_SIM('name', 'en')} > 0.6 THEN ' | Name similarity: ' || printf('%.1f', {_SIM('name', 'en')} * 100) || '% ("' || en || '" vs "' || name || '")' ELSE '' END
  || CASE WHEN model IS NOT NULL AND em IS NOT NULL AND {_SIM('model', 'em')} > 0.7 THEN ' | Model/Product similarity: ' || printf('%.1f', {_SIM('model', 'em')} * 100) || '%' ELSE '' END END AS reasons FROM x""",
    "apply_resolution": "WITH " + _RESOLVE.strip() + """,
n AS (SELECT tenant_id, count(*) AS old FROM existing_parts GROUP BY ALL), nm AS (SELECT tenant_id, count(*) FILTER (action <> 'MERGED_AUTOMATIC') AS fresh, count(DISTINCT CASE WHEN action = 'MERGED_AUTOMATIC' THEN matched_id END) AS merged, count(*) FILTER (action = 'QUEUED_FOR_REVIEW') AS queued FROM r GROUP BY ALL),
s AS (SELECT tenant_id, max(seq) AS top FROM existing_parts GROUP BY ALL)
SELECT tenant_id, (old + coalesce(fresh, 0))::BIGINT AS n_nodes, coalesce(merged, 0)::BIGINT AS n_merged, coalesce(queued, 0)::BIGINT AS n_queued, (top + coalesce(fresh, 0))::BIGINT AS last_seq FROM n LEFT JOIN nm USING (tenant_id) JOIN s USING (tenant_id)""",
    "decide_reviews": "WITH " + _RESOLVE.strip() + """,
q AS (SELECT tenant_id, in_id, matched_id FROM r WHERE action = 'QUEUED_FOR_REVIEW')
SELECT tenant_id, in_id AS candidate_id, CASE in_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END AS status, CASE WHEN in_id % 3 < 2 THEN 'r' || (in_id % 7) || '@example.com' END AS reviewed_by,
 CASE WHEN in_id % 3 < 2 THEN 'note ' || in_id END AS decision_notes, CASE in_id % 3 WHEN 0 THEN 'ENTITY_MERGE_APPROVED' WHEN 1 THEN 'ENTITY_MERGE_REJECTED' END AS audit_action FROM q""",
    "ingestion_jobs": "WITH " + _TAGGED.strip() + """,
c AS (SELECT tenant_id, job_id, count(*) AS total, count(*) FILTER (outcome = 'VALID') AS valid, count(*) FILTER (outcome = 'DUPLICATE') AS dup, count(*) FILTER (outcome NOT IN ('VALID', 'DUPLICATE')) AS err FROM t GROUP BY ALL)
SELECT tenant_id, job_id AS id, total AS total_records, valid AS valid_records, err AS error_records, dup AS duplicate_records, CASE WHEN err = 0 THEN 'COMPLETED' WHEN valid > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status,
 (1000 * (1 + CAST(substr(job_id, 2) AS BIGINT)))::BIGINT AS duration_ms, floor(valid::DOUBLE / (1 + CAST(substr(job_id, 2) AS BIGINT))::DOUBLE * 100 + 0.5) / 100 AS records_per_second FROM c""",
    "number_rows": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_index FROM events",
    "append_edges": """WITH k AS (SELECT tenant_id, id FROM nodes), n AS (SELECT tenant_id, id, source_id, CASE WHEN seq % 5 = 0 THEN 'missing' ELSE target_id END AS target_id, CASE WHEN seq % 2 = 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN seq % 3 = 0 THEN NULL ELSE valid_from END AS valid_from FROM edges)
SELECT tenant_id, id, (tenant_id, source_id) IN (SELECT (tenant_id, id) FROM k) AND (tenant_id, target_id) IN (SELECT (tenant_id, id) FROM k) AS accepted, coalesce(confidence, 1.0::DOUBLE) AS confidence, coalesce(valid_from, TIMESTAMP '2024-01-20 12:00:00') AS valid_from FROM n""",
    "ingest_documents": "WITH RECURSIVE " + chunks_sql("manuals").strip() + f""", d AS (SELECT *, {_CODES} AS codes, {_FORMS('content')} AS forms FROM ck),
p AS (SELECT DISTINCT tenant_id, document_id, chunk_index, unnest(list_concat(forms, list_transform(codes, lambda x: lower(x)))) AS t FROM d), pn AS (SELECT tenant_id, count(*) AS n FROM p GROUP BY ALL)
SELECT tenant_id, count(*) AS n_chunks, sum(len(forms))::BIGINT AS total_length, any_value(pn.n) AS n_postings FROM d JOIN pn USING (tenant_id) GROUP BY ALL""",
    "ingest_rollup": "WITH RECURSIVE " + chunks_sql("manuals").strip() + f""", c AS (SELECT *, {_CODES} AS codes FROM ck)
SELECT tenant_id, document_id, count(*) AS chunk_count, count(*) FILTER (is_table) AS table_count, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') AS codes FROM c GROUP BY ALL""",
    "documents_of_tenant": "WITH RECURSIVE " + chunks_sql("manuals").strip() + " SELECT m.id, m.title, count(ck.document_id) AS chunk_count FROM manuals m LEFT JOIN ck ON ck.tenant_id = m.tenant_id AND ck.document_id = m.id WHERE m.tenant_id = 't1' GROUP BY ALL",
    "chunks_of_document": "WITH RECURSIVE " + chunks_sql("manuals").strip() + " SELECT document_id, chunk_index::BIGINT AS chunk_index, section_header FROM ck WHERE document_id = 'man7'",
    "bm25_remove": "WITH RECURSIVE " + chunks_sql("manuals").strip() + f""", c AS (SELECT *, tenant_id || document_id || '_' || chunk_index AS cid, {_CODES} AS codes, {_FORMS('content')} AS forms FROM ck WHERE NOT is_table),
t AS (SELECT tenant_id, cid, unnest(forms) AS term, 1 AS w FROM c UNION ALL SELECT tenant_id, cid, lower(unnest(codes)), 5 FROM c), p AS (SELECT tenant_id, count(DISTINCT cid) AS n_chunks, sum(w)::BIGINT AS total_tf FROM t GROUP BY ALL)
SELECT tenant_id, any_value(n_chunks) AS n_chunks, any_value(total_tf) AS total_tf, sum(len(forms))::BIGINT AS total_length FROM c JOIN p USING (tenant_id) GROUP BY ALL""",
    "roles_with_permissions": f"""WITH p AS (SELECT role, string_agg(permission, ',' ORDER BY permission) AS permissions, count(*) AS n FROM (VALUES {_MATRIX}) AS t(role, permission) GROUP BY ALL)
SELECT role, permissions, n, (SELECT count(*) FROM memberships m WHERE m.role = p.role) AS n_members FROM p WHERE role IN (SELECT role FROM memberships)""",
    "permissions_by_category": f"SELECT split_part(permission, ':', 1) AS category, count(DISTINCT permission) AS n FROM (VALUES {_MATRIX}) AS t(role, permission) WHERE role IN (SELECT role FROM memberships) GROUP BY ALL",
    "clean_cells": "SELECT p_partkey, trim(p_name) AS cell FROM part",
    "connected_names": _BOTH.replace("{depth}", "3").replace("'Line'", "'WorkOrder'") + """, x AS (SELECT m.tenant_id, m.root_id, count(*) FILTER (n.entity_type IN ('Sensor', 'WorkOrder', 'MaintenanceOrder') AND m.node_id <> m.root_id) AS n FROM m JOIN nodes n ON n.tenant_id = m.tenant_id AND n.id = m.node_id GROUP BY ALL)
SELECT x.tenant_id, x.root_id, o.name AS own, x.n + 1 AS n FROM x JOIN nodes o ON o.tenant_id = x.tenant_id AND o.id = x.root_id""",
    "incident_or_first": """WITH f AS (SELECT tenant_id, arg_min(id, seq) AS first_id FROM incidents GROUP BY ALL), a AS (SELECT DISTINCT tenant_id, CASE WHEN seq % 3 = 0 THEN 'none' ELSE id END AS incident_id FROM incidents)
SELECT a.tenant_id, a.incident_id, coalesce(i.id, first_id) AS chosen_id FROM a JOIN f USING (tenant_id) LEFT JOIN incidents i ON i.tenant_id = a.tenant_id AND i.id = a.incident_id""",
    "upsert_memberships": """WITH i AS (SELECT 'u' || c_custkey AS user_id, 't' || c_nationkey AS tenant_id, ['VIEWER', 'OPERATOR', 'SUPER_ADMIN', 'KING'][c_custkey % 4 + 1] AS role FROM customer), g AS (SELECT * FROM i WHERE role IN ('VIEWER', 'OPERATOR'))
SELECT user_id, tenant_id, role, status, CAST(NULL AS VARCHAR) AS reason FROM memberships WHERE (user_id, tenant_id) NOT IN (SELECT (user_id, tenant_id) FROM g) UNION ALL SELECT user_id, tenant_id, role, 'ACTIVE', NULL FROM g
UNION ALL SELECT user_id, tenant_id, role, 'ACTIVE', CASE role WHEN 'SUPER_ADMIN' THEN 'ROLE_NOT_ASSIGNABLE' ELSE 'UNKNOWN_ROLE' END FROM i WHERE role NOT IN ('VIEWER', 'OPERATOR')""",
    "upsert_rows": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 >= 1 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size % 2 = 0 THEN greatest(1, p_partkey % 3) ELSE 1 END::BIGINT AS version FROM part",
    "delete_tenant": "SELECT CASE WHEN row_index % 7 > 0 THEN tenant_id END AS tenant_id, row_index FROM raw_rows WHERE (CASE WHEN row_index % 7 > 0 THEN tenant_id END) IS DISTINCT FROM 't1'",
    "register_sources": "SELECT 't' || (s_suppkey % 3) AS tenant_id, s_name AS name, 'CSV' AS kind, sha256('t' || (s_suppkey % 3) || '|' || s_name) AS id, CASE WHEN s_suppkey % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS created_at FROM supplier",
    "append_partitioned": "SELECT tenant_id, count(*) AS n, max(seq) AS last FROM (SELECT tenant_id, seq FROM telemetry UNION ALL SELECT tenant_id, seq FROM telemetry WHERE value > 50) GROUP BY ALL",
    "page_checksum": """WITH p AS (SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j FROM orders ORDER BY o_orderkey LIMIT 200) SELECT count(*) AS n, sha256('[' || string_agg(j, ',' ORDER BY o_orderkey) || ']') AS checksum FROM p""",
    "sheet_inventory": "SELECT o_orderstatus AS file, 'S' || (o_custkey % 9) AS sheet, min(o_custkey % 9) AS sheet_pos, count(*) AS row_count, max(CASE WHEN o_custkey % 3 > 0 THEN 2 ELSE 1 END)::BIGINT AS column_count FROM orders GROUP BY 1, 2",
    "pending_reviews": "WITH " + _RESOLVE.strip() + " SELECT in_id AS candidate_id, 'PENDING' AS status FROM r WHERE action = 'QUEUED_FOR_REVIEW' AND tenant_id = 't1'",
    "mark_rolled_back": "SELECT tenant_id, id, CASE WHEN approval_status = 'APPROVED' AND system_target = 'SCADA' THEN 'ROLLED_BACK' ELSE approval_status END AS approval_status FROM proposals",
    "assemble_context": _HYBRID[: _HYBRID.index("SELECT tenant_id, query_id, rank, id AS document_id")].replace("WHERE a.query_id <> 'q5' AND", "WHERE").rstrip() + """,
sp AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)),
cu AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)),
hd AS (SELECT chr(10) || '[PHYSICAL ASSET & TOPOLOGY]' || chr(10) || 'Asset: ' || n.n_name || ' (' || n.n_name || ')' || chr(10) || 'Hierarchy: Plant: ' || r_name || ' // Line: ' || (SELECT coalesce(max(o.n_name), 'N/A') FROM nation o WHERE o.n_nationkey = (SELECT max(x.n_nationkey) FROM nation x WHERE x.n_regionkey = n.n_regionkey AND x.n_nationkey <> n.n_nationkey))
  || chr(10) || 'Sensors (' || (SELECT count(*) FROM sp) || '): ' || coalesce((SELECT string_agg(s_name, ', ' ORDER BY n_nationkey <> 0, n_nationkey, s_suppkey) FROM sp), 'None')
  || chr(10) || 'Active Work Orders: ' || coalesce((SELECT string_agg(c_name, ' | ' ORDER BY n_nationkey <> 0, n_nationkey, c_custkey) FROM cu), 'None') || chr(10) || 'Maintenance History: None' AS head FROM nation n JOIN region ON n_regionkey = r_regionkey WHERE n.n_nationkey = 0),
ln AS (SELECT tenant_id, query_id, rank, chr(10) || '--- Document Source #' || rank || ': ' || title || ' [Type: ' || doc_type || '] ---' || coalesce(chr(10) || 'Content:' || chr(10) || content, '') AS line FROM rk JOIN docs USING (tenant_id, id) WHERE rank <= 5),
bd AS (SELECT tenant_id, query_id, string_agg(line, chr(10) ORDER BY rank) AS body FROM ln GROUP BY ALL)
SELECT tenant_id, query_id, 'N0' AS target_entity_id, '=== INDUSTRIAL OPERATIONAL CONTEXT ===' || chr(10) || 'QUERY: ' || query || chr(10) || 'TENANT: ' || tenant_id || chr(10) || 'TIMESTAMP: 2024-01-20 12:00:00' || chr(10) || head || chr(10) || chr(10)
 || '[RETRIEVED TECHNICAL DOCUMENTATION (HYBRID BM25 + VECTOR + GRAPH)]' || chr(10) || coalesce(body, 'No matching technical manuals or SOP documents found.') AS context FROM asked LEFT JOIN bd USING (tenant_id, query_id), hd""",
    "stream_ingest": "WITH " + _TAGGED.strip() + """ SELECT tenant_id, job_id, count(*) AS total_rows, count(*) FILTER (outcome = 'VALID') AS valid_rows, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate_rows, count(*) FILTER (outcome NOT IN ('VALID', 'DUPLICATE')) AS error_rows,
 CASE WHEN count(*) FILTER (outcome NOT IN ('VALID', 'DUPLICATE')) = 0 THEN 'COMPLETED' WHEN count(*) FILTER (outcome = 'VALID') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM t GROUP BY ALL""",
    "stream_correlate": """WITH t AS (SELECT * FROM telemetry WHERE contains(lower(metric), 'temp') AND threshold <> 0 AND value > threshold),
o AS (SELECT *, 'CROSS_SYSTEM_CASCADE' AS pattern_type FROM telemetry WHERE contains(lower(metric), 'pressure') AND threshold <> 0 AND value < threshold UNION ALL SELECT *, 'MULTI_ENTITY_SPIKE' FROM telemetry WHERE contains(lower(metric), 'vib') AND threshold <> 0 AND value > threshold)
SELECT o.tenant_id, o.incident_id, o.pattern_type, o.seq, t.seq AS temp_seq, t.entity_id FROM o JOIN t ON o.tenant_id = t.tenant_id AND o.incident_id = t.incident_id AND abs(epoch_us(o.ts) - epoch_us(t.ts)) <= 21600::BIGINT * 1000000""",
    "stream_rate_guard": "SELECT tenant_id, entity_id, ts, n FROM (SELECT tenant_id, entity_id, ts, count(*) OVER (PARTITION BY tenant_id, entity_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM action_times) WHERE n >= 2",
    "stream_feedback": """WITH r AS (SELECT incident_id AS execution_id, ts, value, date_trunc('day', ts) AS d, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 60e6 AS el FROM telemetry),
s AS (SELECT *, CASE WHEN value <= 30 THEN 'RESOLVED_HEALTHY' WHEN value > 46 THEN 'DETERIORATING' WHEN el > 720 THEN 'TIMEOUT_FAILED' END AS st FROM r),
f AS (SELECT execution_id, arg_min(struct_pack(s := st, v := value, e := el), ts) FILTER (st IS NOT NULL) AS x, arg_max(value, ts) AS last, min(d) AS d FROM s GROUP BY ALL)
SELECT execution_id, coalesce(x.s, 'TIMEOUT_FAILED') AS status, coalesce(x.v, last) AS value, coalesce(x.e, 720.0) AS elapsed_minutes FROM f WHERE x IS NOT NULL OR epoch_ms(d) + 720 * 60000 < (SELECT epoch_ms(max(ts)) FROM telemetry) - 3600000""",
}

_RAW |= {
    "stream_patterns": _RAW["correlate"],
    "dossier_members": _BOTH.replace("{depth}", "3") + """, x AS (SELECT m.*, n.name, CASE WHEN n.entity_type = 'Sensor' THEN ['sensors', 'components', 'tools', 'maintenance_orders', 'failure_modes', 'spare_parts', 'defects', 'inspections', 'products'][n.seq % 9 + 1] WHEN n.entity_type = 'WorkOrder' THEN 'work_orders' WHEN n.entity_type = 'Batch' THEN 'products' END AS bucket FROM m JOIN nodes n ON m.tenant_id = n.tenant_id AND m.node_id = n.id WHERE node_id <> root_id)
SELECT tenant_id, root_id, node_id, name, bucket, depth FROM x WHERE bucket IS NOT NULL""",
    "indexed_search": "WITH live AS (SELECT * FROM docs WHERE seq % 7 <> 0), " + re.sub(r"\bdocs\b", "live", _BM25).removeprefix("WITH "),
    "bm25_ranking": _BM25.replace(" WHERE rank <= 10", ""),
    "graph_channel": """WITH a AS (SELECT tenant_id, query_id, lower(CASE query_id WHEN 'q1' THEN 'state of the FRANCE line, and of china' WHEN 'q2' THEN 'Algeria again' ELSE query END) AS q, query_id IN ('q1', 'q3') AS aimed FROM asked),
s AS (SELECT d.tenant_id, a.query_id, d.id AS chunk_id, d.seq, CASE WHEN aimed AND n_regionkey = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN contains(q, lower(n_name)) THEN 2.0 ELSE 0.0 END AS score FROM docs d JOIN nation ON n_nationkey = d.seq % 25 JOIN a ON a.tenant_id = d.tenant_id)
SELECT tenant_id, query_id, chunk_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY score DESC, seq) AS rank FROM s WHERE score > 0""",
    "link_to_linked": """WITH x AS (SELECT tenant_id, id, 'N' || (seq % 25) AS own, lower(content) AS c, unnest(['License', 'N3', 'token']) AS k FROM docs)
SELECT tenant_id, id, own || coalesce(string_agg(',' || k, '' ORDER BY k) FILTER (contains(c, lower(k)) AND k <> own), '') AS links FROM x GROUP BY tenant_id, id, own""",
    "evidence_quotes": f"SELECT tenant_id, incident_id, 'SENSOR_TELEMETRY' AS source_type, entity_id AS source_id, 'Telemetry reading ' || CAST(value AS VARCHAR) || ' deviated from threshold ' || CAST(threshold AS VARCHAR) AS quote, 0.98::DOUBLE AS weight, seq FROM telemetry WHERE threshold IS NOT NULL AND {_SENT}",
    "export_audit": f"""WITH s AS (SELECT *, {_HMAC} AS checksum FROM audit_raw) SELECT id, tenant_id, action, "timestamp" AS at, checksum, (SELECT count(*) FROM s) AS total, 'HMAC-SHA256' AS algorithm FROM s ORDER BY "timestamp" DESC, id LIMIT 5000""",
    "user_listing": "SELECT id, email, full_name, is_super_admin FROM users",
    "resolve_dead_letter": "WITH " + _TAGGED.strip() + """, l AS (SELECT tenant_id, job_id, row_index, outcome AS error_code FROM t WHERE outcome NOT IN ('VALID', 'DUPLICATE')), f AS (SELECT job_id, row_index FROM l ORDER BY job_id, row_index LIMIT 1)
SELECT l.*, (job_id, row_index) IN (SELECT (job_id, row_index) FROM f) AS resolved, true AS found FROM l""",
    "one_source": "SELECT tenant_id, id, command_type, approval_status FROM proposals ORDER BY tenant_id, id LIMIT 1",
    "scan_folder": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, 'a,b;c|' || o_orderpriority AS note, CAST(o_custkey AS VARCHAR) AS who, true AS gapless FROM orders",
    "scan_profile": f"""WITH w AS (SELECT c_custkey AS i, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
l AS (SELECT i, 'c_custkey' AS column_name, c_custkey AS value FROM w UNION ALL SELECT i, 'c_name', c_name FROM w UNION ALL SELECT i, 'c_acctbal', c_acctbal FROM w UNION ALL SELECT i, 'c_mktsegment', c_mktsegment FROM w), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN {_INFER} END AS kind FROM l),
s AS (SELECT column_name, string_agg(value, '|' ORDER BY i) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY i) AS r FROM l WHERE value IS NOT NULL) WHERE r <= 5 GROUP BY ALL)
SELECT k.column_name, CASE WHEN bool_or(kind = 'STRING') THEN 'STRING' WHEN bool_or(kind = 'FLOAT') THEN 'FLOAT' ELSE 'INTEGER' END AS inferred_type, bool_or(value IS NULL) AS nullable, count(DISTINCT value) AS unique_count, any_value(samples) AS samples, count(DISTINCT value) = 1 AND count(*) > 5 AS is_constant, count(*) AS n_rows
FROM k JOIN s USING (column_name) GROUP BY k.column_name""",
}
TWINS = {name: twin(text) for name, text in _RAW.items()}
