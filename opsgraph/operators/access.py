"""Members, organisations, roles, permissions and access gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import upsert

# What each role may do.
ROLE_PERMISSIONS = {
    "SUPER_ADMIN": "org:read org:write org:delete user:read user:invite user:manage_roles data:read data:ingest data:manage knowledge:read knowledge:explore audit:read audit:export policy:read policy:write action:propose action:approve action:execute system:admin",
    "ORG_ADMIN": "org:read org:write user:read user:invite user:manage_roles data:read data:ingest data:manage knowledge:read knowledge:explore audit:read audit:export policy:read policy:write action:propose action:approve action:execute",
    "PLANT_MANAGER": "org:read user:read data:read data:ingest data:manage knowledge:read knowledge:explore audit:read policy:read action:propose action:approve",
    "PROCESS_ENGINEER": "org:read user:read data:read data:ingest knowledge:read knowledge:explore audit:read action:propose",
    "OPERATOR": "org:read data:read knowledge:read action:propose",
    "AUDITOR": "org:read user:read data:read knowledge:read audit:read audit:export policy:read",
    "VIEWER": "org:read data:read knowledge:read",
}


def role_permissions(spark: SparkSession) -> DataFrame:
    """``role, permission`` of the fixed matrix."""
    rows = ", ".join(f"('{r}', '{p}')" for r, ps in ROLE_PERMISSIONS.items() for p in ps.split())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(role, permission)")


def members(memberships: DataFrame, users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Memberships with user and organisation, kept where either is missing."""
    u = users.select(F.col("id").alias("user_id"), "email", "full_name")
    o = orgs.select(F.col("id").alias("tenant_id"), F.col("name").alias("org_name"))
    return memberships.join(u, "user_id", "left").join(o, "tenant_id", "left")


def organizations_of_users(memberships: DataFrame, orgs: DataFrame) -> DataFrame:
    o = orgs.select(F.col("id").alias("tenant_id"), F.col("name").alias("org_name"))
    return memberships.filter("status = 'ACTIVE'").join(o, "tenant_id").select("user_id", "tenant_id", "org_name", "role")


def access_gate(requests: DataFrame, memberships: DataFrame, users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Add ``decision``: NOT_FOUND (unknown organisation), ALLOWED (active member or super admin) or TENANT_ACCESS_DENIED."""
    o = orgs.select(F.col("id").alias("tenant_id")).distinct().withColumn("__org", F.lit(True))
    m = memberships.filter("status = 'ACTIVE'").select("user_id", "tenant_id").distinct().withColumn("__member", F.lit(True))
    s = users.filter("is_super_admin").select(F.col("id").alias("user_id")).distinct().withColumn("__super", F.lit(True))
    seen = requests.join(o, "tenant_id", "left").join(m, ["user_id", "tenant_id"], "left").join(s, "user_id", "left")
    decision = F.when(F.col("__org").isNull(), "NOT_FOUND").when(F.col("__super") | F.col("__member"), "ALLOWED").otherwise("TENANT_ACCESS_DENIED")
    return seen.withColumn("decision", decision).drop("__org", "__member", "__super")


def denied_audit(gated: DataFrame) -> DataFrame:
    """Audit rows of the denied requests."""
    return gated.filter("decision = 'TENANT_ACCESS_DENIED'").select("tenant_id", F.col("user_id").alias("actor_id"), F.lit("TENANT_ACCESS_DENIED").alias("action"), F.lit("BLOCKED").alias("status"))


def role_checks(checks: DataFrame, matrix: DataFrame) -> DataFrame:
    """Add ``has_all`` and ``has_any`` to rows of ``check_id, role, permissions`` (array); unknown roles have none."""
    one = checks.select("check_id", "role", F.explode_outer("permissions").alias("permission"))
    held = one.join(F.broadcast(matrix.withColumn("__h", F.lit(True))), ["role", "permission"], "left").withColumn("__h", F.coalesce("__h", F.lit(False)))
    asked = F.col("permission").isNotNull()
    out = held.groupBy("check_id", "role").agg(F.coalesce(F.bool_and(F.when(asked, F.col("__h"))), F.lit(True)).alias("has_all"), F.coalesce(F.bool_or(F.when(asked, F.col("__h"))), F.lit(False)).alias("has_any"))
    return out


def denied_permissions(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Requests (``role, permission``) that the matrix does not grant, as audit rows."""
    return requests.join(F.broadcast(matrix), ["role", "permission"], "left_anti").withColumn("action", F.lit("PERMISSION_DENIED")).withColumn("status", F.lit("BLOCKED"))


def roles_with_permissions(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("role").agg(F.sort_array(F.collect_list("permission")).alias("permissions"), F.count(F.lit(1)).alias("n"))


def permissions_by_category(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.substring_index("permission", ":", 1).alias("category"), "permission").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def upsert_memberships(current: DataFrame, invites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New memberships after invites (one per user and tenant, the last invite's role) and the rejected invites."""
    known = F.col("role").isin(*ROLE_PERMISSIONS)
    good = known & (F.col("role") != "SUPER_ADMIN")
    bad = invites.filter(~F.coalesce(good, F.lit(False))).withColumn("reason", F.when(F.col("role") == "SUPER_ADMIN", "ROLE_NOT_ASSIGNABLE").otherwise("UNKNOWN_ROLE"))
    return upsert(current, invites.filter(good), ["user_id", "tenant_id"], ["updated_at"]), bad
