"""Action guardrails, approvals, executions and closed-loop feedback.

Proposals: ``tenant_id, id, target_entity_id, command_type, system_target,
parameters, required_approval_role, approval_status, approved_by, rollback_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import execution_checksum
from ..sources.sinks import latest_by_key

# Fixed values.
LADDER = ("VIEWER", "OPERATOR", "MAINTENANCE_SUPERVISOR", "PROCESS_ENGINEER", "PLANT_MANAGER", "SUPER_ADMIN")
DEFAULT_STATE = "RUNNING_NORMAL"
LIMITS = {"max_pressure_bar": 250.0, "min_pressure_bar": 0.0, "max_rpm": 24000.0, "max_temperature_celsius": 90.0}
MAX_PER_HOUR = 5
DEFAULT_CONDITION = {"baseline_value": 70.0, "target_healthy_value": 60.0, "comparison_operator": "<=", "max_evaluation_window_minutes": 30.0}


def role_rank(role: Column) -> Column:
    """Place in the ladder from 0; -1 for any other role."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in LADDER]), role) - 1, F.lit(-1))


def is_control_modification(command: Column) -> Column:
    return command.rlike("SETPOINT|MODIFY|OVERRIDE")


def bounds_violation(parameters: Column, limit) -> Column:
    """The reason of the last parameter outside its limits, or null; ``limit(name)`` gives a limit.  Values that are no numbers violate nothing."""
    def value(k):
        v = F.try_element_at(parameters, F.lit(k)).try_cast("double")
        return F.when(~F.isnan(v), v)

    p, r, t = value("targetPressureBar"), value("targetRpm"), value("targetTempCelsius")
    text = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    hot = F.when(t > limit("max_temperature_celsius"), F.concat(F.lit("temperature "), text(t), F.lit(" exceeds "), text(limit("max_temperature_celsius"))))
    fast = F.when((r > limit("max_rpm")) | (r < 0), F.concat(F.lit("speed "), text(r), F.lit(" exceeds "), text(limit("max_rpm"))))
    press = F.when((p > limit("max_pressure_bar")) | (p < limit("min_pressure_bar")), F.concat(F.lit("pressure "), text(p), F.lit(" outside "), text(limit("min_pressure_bar")), F.lit(" - "), text(limit("max_pressure_bar"))))
    return F.coalesce(hot, fast, press)


def current_machine_state(states: DataFrame) -> DataFrame:
    return latest_by_key(states.select("tenant_id", "entity_id", "state", "ts"), ["tenant_id", "entity_id"], ["ts"])


def actions_last_hour(proposals: DataFrame, action_times: DataFrame, now: Column) -> DataFrame:
    """Per proposal, its asset's action times strictly after ``now`` less one hour."""
    recent = action_times.filter(F.col("ts") > now - F.expr("INTERVAL 1 HOUR")).groupBy("tenant_id", "entity_id").agg(F.count(F.lit(1)).alias("recent_actions"))
    return proposals.join(recent.withColumnRenamed("entity_id", "target_entity_id"), ["tenant_id", "target_entity_id"], "left").withColumn("recent_actions", F.coalesce("recent_actions", F.lit(0)))


def evaluate_guardrails(proposals: DataFrame, states: DataFrame, envelopes: DataFrame, action_times: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Five ordered checks per proposal (long table), and the verdicts: can it run, and the first failing check's reason."""
    now = F.lit(now).cast("timestamp")
    s = current_machine_state(states).select("tenant_id", F.col("entity_id").alias("target_entity_id"), "state")
    e = envelopes.select("tenant_id", F.col("entity_id").alias("target_entity_id"), *[F.col(c).alias(f"e_{c}") for c in LIMITS])
    p = actions_last_hour(proposals.join(s, ["tenant_id", "target_entity_id"], "left").join(e, ["tenant_id", "target_entity_id"], "left"), action_times, now)
    state = F.coalesce("state", F.lit(DEFAULT_STATE))
    bad = bounds_violation(F.col("parameters"), lambda k: F.coalesce(F.col(f"e_{k}"), F.lit(LIMITS[k])))

    def check(no, name, failed, reason):
        failed = F.coalesce(failed, F.lit(False))
        return F.struct(F.lit(no).alias("check_no"), F.lit(name).alias("check_name"), (~failed).alias("passed"), F.when(failed, reason).otherwise(F.lit("ok")).alias("reason"), F.when(failed, "CRITICAL_BLOCK").otherwise("INFO").alias("severity"))

    checks = F.array(
        check(1, "HUMAN_APPROVAL_GATE", ~F.col("approval_status").eqNullSafe("APPROVED"), F.concat(F.lit("approval status is "), F.coalesce("approval_status", F.lit("null")))),
        check(2, "EMERGENCY_STOP_OVERRIDE", state == "EMERGENCY_STOP", F.lit("asset is in emergency stop")),
        check(3, "ACTIVE_RUNNING_CRITICAL_LOCKOUT", is_control_modification(F.col("command_type")) & (state == "RUNNING_CRITICAL"), F.lit("no parameter change while running critical")),
        check(4, "PARAMETER_BOUNDS_CHECK", bad.isNotNull(), bad),
        check(5, "ACTUATOR_RATE_LIMIT", F.col("recent_actions") >= MAX_PER_HOUR, F.concat(F.col("recent_actions").cast("string"), F.lit(f" actions in the past hour, limit {MAX_PER_HOUR}"))))
    long = p.select("tenant_id", F.col("id").alias("proposal_id"), F.explode(checks).alias("c")).select("tenant_id", "proposal_id", "c.*")
    failed = ~F.col("passed")
    verdict = long.groupBy("tenant_id", "proposal_id").agg(F.bool_and("passed").alias("can_execute"), F.min_by(F.when(failed, F.col("reason")), F.when(failed, F.col("check_no"))).alias("blocked_reason"))
    return long, verdict


def apply_approvals(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals after approvals (``tenant_id, id, email, role``) and the refused decisions.  The present status is not looked at."""
    d = decisions.select("tenant_id", "id", F.col("email").alias("__e"), F.col("role").alias("__r"))
    seen = proposals.join(d, ["tenant_id", "id"], "left")
    enough = F.col("__r").isNotNull() & (role_rank(F.col("__r")) >= role_rank(F.col("required_approval_role")))
    after = seen.withColumn("approval_status", F.when(enough, "APPROVED").otherwise(F.col("approval_status"))).withColumn("approved_by", F.when(enough, F.format_string("%s (%s)", "__e", "__r")).otherwise(F.col("approved_by"))).drop("__e", "__r")
    missing = decisions.join(proposals.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti").withColumn("reason", F.lit("NOT_FOUND"))
    low = decisions.join(proposals.select("tenant_id", "id", "required_approval_role"), ["tenant_id", "id"]).filter(role_rank(F.col("role")) < role_rank(F.col("required_approval_role"))).drop("required_approval_role").withColumn("reason", F.lit("INSUFFICIENT_PRIVILEGE"))
    return after, missing.unionByName(low)


def apply_rejections(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.select("tenant_id", "id", F.col("reason").alias("__r"), F.lit(True).alias("__d"))
    seen = proposals.join(d, ["tenant_id", "id"], "left")
    return seen.withColumn("approval_status", F.when(F.col("__d"), "REJECTED").otherwise(F.col("approval_status"))).withColumn("rejection_reason", F.col("__r")).drop("__r", "__d")


def plan_executions(proposals: DataFrame, verdicts: DataFrame, now: str) -> DataFrame:
    """One execution row per proposal: SUCCESS or GUARDRAIL_BLOCKED, a deterministic id and checksum, and the proposal's next status."""
    v = verdicts.withColumnRenamed("proposal_id", "id")
    out = proposals.join(v, ["tenant_id", "id"])
    ok = F.col("can_execute")
    eid = F.concat(F.when(ok, "exec_").otherwise("exec_blocked_"), F.substring(F.sha2(F.concat_ws("|", "tenant_id", "id", F.lit(now)), 256), 1, 12))
    out = out.withColumn("execution_id", eid).withColumn("status", F.when(ok, "SUCCESS").otherwise("GUARDRAIL_BLOCKED"))
    check = F.when(ok, execution_checksum(F.col("execution_id"), F.col("id"), F.col("system_target"), F.lit(now))).otherwise(execution_checksum(F.col("execution_id"), F.col("id"), F.lit("BLOCKED"), F.lit(now)))
    return out.select("tenant_id", "execution_id", F.col("id").alias("proposal_id"), "target_entity_id", "system_target", "command_type", "status", F.lit(now).alias("dispatched_at"), "blocked_reason",
                      F.lit(None).cast("string").alias("external_reference_id"), check.alias("audit_checksum"), F.when(ok, "EXECUTED").otherwise(F.col("approval_status")).alias("proposal_status"))


def feedback_status(value: Column, baseline: Column, target: Column, op: Column, elapsed: Column, window: Column) -> Column:
    """RESOLVED_HEALTHY, then DETERIORATING, then TIMEOUT_FAILED, else MONITORING_IN_PROGRESS."""
    met = F.when(op == "<", value < target).when(op == "<=", value <= target).when(op == ">", value > target).when(op == ">=", value >= target).otherwise(False)
    worse = F.when(op.isin("<", "<="), value > baseline + 1.0).when(op.isin(">", ">="), value < baseline - 0.2).otherwise(False)
    return F.when(met, "RESOLVED_HEALTHY").when(worse, "DETERIORATING").when(elapsed > window, "TIMEOUT_FAILED").otherwise("MONITORING_IN_PROGRESS")


def latest_reading(executions: DataFrame, readings: DataFrame) -> DataFrame:
    """Executions (``execution_id, entity_id, evaluated_at``) with the entity's last reading at or before the evaluation.

    Both sides meet in one pass over each entity's time line: a running last value
    in hour buckets, so no pair of execution and reading is formed.
    """
    from pyspark.sql import Window as W

    hour = F.date_trunc("hour", "ts")
    e = executions.select("tenant_id", "entity_id", F.col("evaluated_at").alias("ts"), F.lit(1).alias("side"), "execution_id", F.lit(None).cast("double").alias("value"))
    r = readings.select("tenant_id", "entity_id", "ts", F.lit(0).alias("side"), F.lit(None).cast("string").alias("execution_id"), "value")
    line = e.withColumn("execution_id", F.col("execution_id").cast("string")).unionByName(r).withColumn("hour", hour)
    inside = W.partitionBy("tenant_id", "entity_id", "hour").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumn("here", F.last("value", ignorenulls=True).over(inside))
    # each hour's last value, carried over the hours of an entity
    hours = line.groupBy("tenant_id", "entity_id", "hour").agg(F.max_by(F.when(F.col("side") == 0, F.col("value")), F.when(F.col("side") == 0, F.col("ts"))).alias("last"))
    before = W.partitionBy("tenant_id", "entity_id").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    hours = hours.withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    found = line.filter("side = 1").join(hours, ["tenant_id", "entity_id", "hour"]).select("execution_id", "tenant_id", F.coalesce("here", "carried").alias("value"))
    return executions.withColumn("execution_id", F.col("execution_id").cast("string")).join(found, ["tenant_id", "execution_id"], "left")


def verify_feedback(executions: DataFrame, conditions: DataFrame) -> DataFrame:
    """Executions (``tenant_id, execution_id, proposal_id, value, elapsed_minutes, rollback_enabled``) with ``feedback_status`` and ``rollback_triggered``, by the tenant's conditions; proposals without condition use the default."""
    c = conditions.select("tenant_id", "proposal_id", *[F.col(k).alias(f"__{k}") for k in DEFAULT_CONDITION])
    x = {k: F.coalesce(F.col(f"__{k}"), F.lit(v)) for k, v in DEFAULT_CONDITION.items()}
    out = executions.join(c, ["tenant_id", "proposal_id"], "left")
    status = feedback_status(F.col("value"), x["baseline_value"], x["target_healthy_value"], x["comparison_operator"], F.col("elapsed_minutes"), x["max_evaluation_window_minutes"])
    out = out.withColumn("feedback_status", status).drop(*[f"__{k}" for k in DEFAULT_CONDITION])
    return out.withColumn("rollback_triggered", F.col("feedback_status").isin("DETERIORATING", "TIMEOUT_FAILED") & F.coalesce("rollback_enabled", F.lit(False)))


def rollback_queue(verified: DataFrame, proposals: DataFrame) -> DataFrame:
    """What has to be rolled back, with the plan's target, command and parameters."""
    plan = proposals.select("tenant_id", F.col("id").alias("proposal_id"), F.col("rollback_plan").alias("__p"))
    return verified.filter("rollback_triggered").join(plan, ["tenant_id", "proposal_id"]).select("tenant_id", "execution_id", "proposal_id", "__p.system_target", "__p.command_type", "__p.rollback_parameters")


def mark_rolled_back(proposals: DataFrame, asked: DataFrame) -> DataFrame:
    d = asked.select("tenant_id", "id", F.lit(True).alias("__d"))
    return proposals.join(d, ["tenant_id", "id"], "left").withColumn("approval_status", F.when(F.col("__d"), "ROLLED_BACK").otherwise(F.col("approval_status"))).drop("__d")
