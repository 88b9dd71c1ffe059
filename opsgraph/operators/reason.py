"""Telemetry correlation and rule-based incident analysis.

Telemetry: ``tenant_id, incident_id, entity_id, metric, value, threshold, ts, seq``.
Incidents: ``tenant_id, id, target_entity_id, error_code``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round
from .graph import materialize
from .mentions import mentions

KEY = ["tenant_id", "incident_id"]
WINDOW_SECONDS = 300
# Pattern type, coefficient, whether cause is confirmed.
CASCADE, SPIKE, DRIFT = ("CROSS_SYSTEM_CASCADE", 0.94, True), ("MULTI_ENTITY_SPIKE", 0.88, False), ("PROGRESSIVE_DRIFT", 0.91, True)
WEIGHTS = {"SENSOR_TELEMETRY": 0.98, "MANUAL_SPECIFICATION": 0.95, "WORK_ORDER": 0.90}
RULE_CODE, RULE_TEMP, GATE = "E-4012", 68.0, 0.80


def metric_has(part: str) -> Column:
    return F.lower("metric").contains(part)


def breaches(kind: str) -> Column:
    """Correlation's breach of a signal class: pressure below, temperature or vibration above a threshold other than 0."""
    part, below = {"pressure": ("pressure", True), "temp": ("temp", False), "vib": ("vib", False)}[kind]
    side = F.col("value") < F.col("threshold") if below else F.col("value") > F.col("threshold")
    return F.coalesce(metric_has(part) & (F.col("threshold") != 0) & side, F.lit(False))


def deviates() -> Column:
    """Evidence's breach: temperature and vibration above, anything else below, a threshold that may be 0."""
    up = metric_has("temp") | metric_has("vib")
    return F.coalesce(F.when(up, F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")), F.lit(False))


def reading_alert() -> Column:
    """The dashboard's flag: temperature above, pressure below; other metrics never."""
    return F.coalesce(F.when(metric_has("temp"), F.col("value") > F.col("threshold")).when(metric_has("press"), F.col("value") < F.col("threshold")), F.lit(False))


def first_and_last_breach(telemetry: DataFrame, *also: Column) -> DataFrame:
    """One row per incident (and ``also``, such as a session): first breach of each class, last temperature breach, and the count of these."""
    at = F.struct("ts", "seq")
    row = F.struct("entity_id", "value", "ts")
    pick = lambda f, k: f(F.when(breaches(k), row), F.when(breaches(k), at))
    return telemetry.groupBy(*also, *KEY).agg(pick(F.min_by, "pressure").alias("p"), pick(F.min_by, "temp").alias("t"), pick(F.min_by, "vib").alias("v"), pick(F.max_by, "temp").alias("t_last"), F.sum(breaches("temp").cast("int")).alias("n_temp"))


def correlate(telemetry: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """``tenant_id, incident_id, pattern_type, entities, seconds, coefficient, causal`` of each pattern found; one aggregation."""
    return patterns(first_and_last_breach(telemetry), window)


def patterns(f: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """The patterns in rows of ``first_and_last_breach``."""
    gap = lambda a, b: F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)

    def pattern(kind, when, entities, seconds):
        return F.when(when, F.struct(F.lit(kind[0]).alias("pattern_type"), entities.alias("entities"), seconds.cast("long").alias("seconds"), F.lit(kind[1]).alias("coefficient"), F.lit(kind[2]).alias("causal")))

    pt, vt = gap(F.col("p.ts"), F.col("t.ts")), gap(F.col("v.ts"), F.col("t.ts"))
    found = F.array(pattern(CASCADE, pt <= window, F.array("p.entity_id", "t.entity_id"), js_round(pt)), pattern(SPIKE, vt <= window, F.array("v.entity_id", "t.entity_id"), js_round(vt)),
                    pattern(DRIFT, (F.col("n_temp") >= 2) & (F.col("t_last.value") > F.col("t.value")), F.array("t.entity_id"), F.lit(window)))
    return f.select(*KEY, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*KEY, "x.*")


def doc_hits(incidents: DataFrame, chunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Chunks that cite an incident's code or contain it, ignoring case; of the retrieved ``hits(incident_id, chunk_id)`` if given."""
    c = chunks.select("tenant_id", F.col("id").alias("chunk_id"), "document_id", "content", "section_header", "error_codes")
    if hits is not None:
        c = c.join(hits.select("tenant_id", "incident_id", "chunk_id"), ["tenant_id", "chunk_id"])
        asked = incidents.select("tenant_id", F.col("id").alias("incident_id"), "error_code")
        met = c.join(asked, KEY)
        return met.filter(F.array_contains("error_codes", F.col("error_code")) | F.contains(F.lower("content"), F.lower("error_code")))
    asked = incidents.select("tenant_id", F.col("id").alias("incident_id"), "error_code")
    return c.join(_cited(incidents, chunks), ["tenant_id", "chunk_id"]).join(asked, ["tenant_id", "error_code"])


def _cited(incidents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``tenant_id, chunk_id, error_code`` of each code of the incidents that a chunk cites or contains."""
    c = chunks.select("tenant_id", F.col("id").alias("chunk_id"), "content", "error_codes")
    codes = incidents.select("tenant_id", "error_code", F.lower("error_code").alias("term")).filter("error_code IS NOT NULL").distinct()
    inside = mentions(c.select("tenant_id", "chunk_id", F.lower("content").alias("text")), codes, "chunk_id").join(codes, ["tenant_id", "term"])
    cited = c.select("tenant_id", "chunk_id", F.explode("error_codes").alias("error_code")).join(codes, ["tenant_id", "error_code"], "left_semi")
    return inside.select("tenant_id", "chunk_id", "error_code").unionByName(cited).distinct()


def build_evidence(incidents: DataFrame, telemetry: DataFrame, document_hits: DataFrame | None = None, work_orders: DataFrame | None = None) -> DataFrame:
    """Evidence rows ``tenant_id, incident_id, source_type, source_id, quote, weight, source_order`` from readings, manuals and work orders."""
    def rows(df, kind, source, quote, order):
        return df.select(*KEY, F.lit(kind).alias("source_type"), source.alias("source_id"), quote.alias("quote"), F.lit(WEIGHTS[kind]).alias("weight"), F.struct(F.lit(list(WEIGHTS).index(kind)).alias("k"), order.cast("string").alias("n")).alias("source_order"))

    readings = telemetry.join(incidents.select("tenant_id", F.col("id").alias("incident_id")), KEY, "left_semi").filter(F.col("threshold").isNotNull() & deviates())
    out = rows(readings, "SENSOR_TELEMETRY", F.col("entity_id"), F.concat(F.lit("Telemetry reading "), F.col("value").cast("string"), F.lit(" deviated from threshold "), F.col("threshold").cast("string")), F.col("seq"))
    if document_hits is not None:
        out = out.unionByName(rows(document_hits, "MANUAL_SPECIFICATION", F.col("document_id"), F.substring("content", 1, 300), F.col("chunk_id")))
    if work_orders is not None:
        out = out.unionByName(rows(work_orders, "WORK_ORDER", F.col("node_id"), F.concat(F.lit("Work order "), F.col("name")), F.col("node_id")))
    return out


def count_evidence(evidence: DataFrame) -> DataFrame:
    """``tenant_id, incident_id, n_<source type>`` of the incidents that have evidence."""
    return evidence.groupBy(*KEY).agg(*[F.sum((F.col("source_type") == k).cast("long")).alias(f"n_{k}") for k in WEIGHTS])


def evidence_counts(incidents: DataFrame, telemetry: DataFrame, chunks: DataFrame | None = None, work_orders: DataFrame | None = None) -> DataFrame:
    """What ``count_evidence`` gives for the readings, the ``chunks`` that cite an incident's code and the ``work_orders(tenant_id, target_entity_id)`` of its asset.

    Manuals are counted by code and orders by asset, before incidents are joined: a code of many incidents and many
    manuals, or a busy asset, is one count and not all their pairs.
    """
    asked = incidents.select("tenant_id", F.col("id").alias("incident_id"), "target_entity_id", "error_code")
    sensor, manual, order = (f"n_{k}" for k in WEIGHTS)
    read = build_evidence(incidents, telemetry).groupBy(*KEY).agg(F.count(F.lit(1)).alias(sensor))
    none = F.lit(0).cast("long")
    out = asked.join(read, KEY, "left")
    count = F.count(F.lit(1))
    out = out.join(_cited(incidents, chunks).groupBy("tenant_id", "error_code").agg(count.alias(manual)), ["tenant_id", "error_code"], "left") if chunks is not None else out.withColumn(manual, none)
    out = out.join(work_orders.groupBy("tenant_id", "target_entity_id").agg(count.alias(order)), ["tenant_id", "target_entity_id"], "left") if work_orders is not None else out.withColumn(order, none)
    out = out.na.fill(0, [sensor, manual, order]).filter(F.col(sensor) + F.col(manual) + F.col(order) > 0)
    return out.select(*KEY, sensor, manual, order)


def hypotheses(incidents: DataFrame, telemetry: DataFrame, evidence: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``tenant_id, incident_id, rank, failure_mode, probability, verified, n_evidence``.

    The coolant rule fires on its code or on a first temperature reading above
    its limit; else one unspecified hypothesis.  ``counts`` (``evidence_counts``) may stand for the evidence.
    """
    first = telemetry.groupBy(*KEY).agg(F.min_by(F.when(metric_has("temp"), F.col("value")), F.when(metric_has("temp"), F.col("seq"))).alias("first_temp"))
    n = counts if counts is not None else count_evidence(evidence)
    base = incidents.select("tenant_id", F.col("id").alias("incident_id"), "error_code").join(first, KEY, "left").join(n, KEY, "left").na.fill(0, [f"n_{k}" for k in WEIGHTS])
    sensor, manual, orders = (F.col(f"n_{k}") for k in WEIGHTS)
    one = lambda rank, mode, p, sure, count: F.struct(F.lit(rank).alias("rank"), F.lit(mode).alias("failure_mode"), F.lit(p).alias("probability"), F.lit(sure).alias("verified"), count.alias("n_evidence"))
    coolant = F.array(one(1, "COOLANT_FLOW_STARVATION", 0.88, True, sensor + manual), one(2, "THERMOCOUPLE_CALIBRATION_DRIFT", 0.12, False, sensor))
    other = F.array(one(1, "UNSPECIFIED_ANOMALY", 0.75, False, sensor + manual + orders))
    fires = (F.col("error_code") == RULE_CODE) | F.coalesce(F.col("first_temp") > RULE_TEMP, F.lit(False))
    return base.select(*KEY, F.explode(F.when(F.coalesce(fires, F.lit(False)), coolant).otherwise(other)).alias("h")).select(*KEY, "h.*")


def _in_all(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, reduce(lambda a, b: a + b, [F.col(f"n_{k}") for k in WEIGHTS]).alias("n_evidence"))


def recommendations(found: DataFrame, incidents: DataFrame, evidence: DataFrame | None = None, nodes: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Corrective and preventive rows where the first hypothesis reaches the gate."""
    one = lambda kind, command, role, minutes, cost: F.struct(F.lit(kind).alias("category"), F.lit(command).alias("command_type"), F.lit(role).alias("required_role"), F.lit(minutes).alias("downtime_minutes"), F.lit(cost).alias("cost_usd"))
    both = F.array(one("CORRECTIVE_ACTION", "CREATE_EMERGENCY_WORK_ORDER", "PROCESS_ENGINEER", 45, 140), one("PREVENTIVE_ACTION", "UPDATE_PM_INTERVAL", "PLANT_MANAGER", 15, 50))
    n = _in_all(counts if counts is not None else count_evidence(evidence))
    top = found.filter((F.col("rank") == 1) & (F.col("probability") >= GATE)).select(*KEY)
    target = incidents.select("tenant_id", F.col("id").alias("incident_id"), "target_entity_id")
    out = top.join(target, KEY).join(n, KEY, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    out = with_target_name(out, nodes) if nodes is not None else out.withColumn("target_name", F.col("target_entity_id"))
    return out.select("*", F.explode(both).alias("r")).select(*KEY, "target_entity_id", "target_name", "n_evidence", "r.*")


def with_target_name(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``target_name``: the node's name, or its id where there is no node."""
    n = nodes.select("tenant_id", F.col("id").alias("target_entity_id"), F.col("name").alias("__n"))
    return df.join(n, ["tenant_id", "target_entity_id"], "left").withColumn("target_name", F.coalesce("__n", "target_entity_id")).drop("__n")


def analyze_incidents(incidents: DataFrame, telemetry: DataFrame, document_hits: DataFrame | None = None, work_orders: DataFrame | None = None, nodes: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row per incident: top hypothesis and probability, counts of hypotheses, recommendations, evidence and unsupported claims, and a summary.

    Only the number of evidence rows matters, so ``counts`` (``evidence_counts``) may stand for hits and work orders.
    """
    n = counts if counts is not None else materialize(count_evidence(build_evidence(incidents, telemetry, document_hits, work_orders)))
    h = hypotheses(incidents, telemetry, counts=n)
    r = recommendations(h, incidents, nodes=nodes, counts=n)
    hs = h.groupBy(*KEY).agg(F.min_by("failure_mode", "rank").alias("top_cause"), F.min_by("probability", "rank").alias("top_probability"), F.count(F.lit(1)).alias("n_hypotheses"), F.sum((F.col("n_evidence") == 0).cast("long")).alias("u1"))
    rs = r.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_recommendations"), F.sum((F.col("n_evidence") == 0).cast("long")).alias("u2"))
    ev = _in_all(n)
    out = incidents.withColumnRenamed("id", "incident_id").join(hs, KEY).join(rs, KEY, "left").join(ev, KEY, "left").na.fill(0, ["n_recommendations", "u2", "n_evidence"])
    out = with_target_name(out, nodes) if nodes is not None else out.withColumn("target_name", F.col("target_entity_id"))
    # The wording of the summary.
    text = F.format_string("Diagnostic investigation of %s on %s. Identified %d evidence-backed hypotheses and %d actionable recommendations.", "error_code", "target_name", "n_hypotheses", "n_recommendations")
    return out.withColumn("unsupported_claims", F.col("u1") + F.col("u2")).withColumn("summary", text).drop("u1", "u2")


def incident_or_first(incidents: DataFrame, asked: DataFrame) -> DataFrame:
    """For ``asked(tenant_id, incident_id)`` the incident of that id, else the tenant's first."""
    first = incidents.groupBy("tenant_id").agg(F.min_by("id", "seq").alias("first_id"))
    known = incidents.select("tenant_id", F.col("id").alias("incident_id"), F.lit(True).alias("__k"))
    out = asked.join(known, KEY, "left").join(first, "tenant_id")
    return out.select("tenant_id", "incident_id", F.when(F.col("__k"), F.col("incident_id")).otherwise(F.col("first_id")).alias("chosen_id"))
