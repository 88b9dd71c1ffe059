"""Guards over columns of queries, identifiers and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Fixed values, in the order in which they are tested.
KEYWORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "CALL", "EXEC", "EXECUTE")
PRIVATE_RANGE = r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "instance-data")


def flag_unsafe_sql(sql: Column) -> Column:
    """EMPTY, MULTI_STATEMENT, NOT_SELECT, FORBIDDEN:<keyword>, or null for a read-only query."""
    s = trimmed(F.coalesce(sql, F.lit("")))
    out = (F.when(s == "", "EMPTY").when(F.size(F.filter(F.split(s, ";"), lambda x: trimmed(x) != "")) > 1, "MULTI_STATEMENT")
           .when(~s.rlike(r"(?i)^(SELECT|WITH)\b"), "NOT_SELECT"))
    for k in KEYWORDS:
        out = out.when(s.rlike(rf"(?i)\b{k}\b"), f"FORBIDDEN:{k}")
    return out.when(s.rlike(r"(?i)\bINTO\b\s+OUTFILE"), "FORBIDDEN:INTO OUTFILE").when(s.rlike(r"(?i)\bCOPY\b\s+.*\s+TO\b"), "FORBIDDEN:COPY TO")


def flag_bad_identifier(name: Column) -> Column:
    return ~F.coalesce(name.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), F.lit(False))


def _dotted(host: Column) -> Column:
    """A host that is one decimal number, as four octets."""
    n = F.when(host.rlike(r"^\d{1,10}$"), host).cast("long")
    part = lambda s: F.pmod(F.floor(n / F.lit(1 << s)), F.lit(256)).cast("string")
    return F.when(n < (1 << 32), F.concat_ws(".", part(24), part(16), part(8), part(0))).otherwise(host)


def classify_url(url: Column) -> Column:
    """MALFORMED, BAD_PROTOCOL, METADATA_HOST, PRIVATE_HOST or OK; the private test is on the host's text."""
    protocol = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = _dotted(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^\[|\]$", ""))
    private = host.rlike(PRIVATE_RANGE) | host.isin("localhost", "::1") | host.startswith("fc") | host.startswith("fd") | host.startswith("fe80:")
    return (F.when(protocol.isNull(), "MALFORMED").when(~protocol.isin("http", "https"), "BAD_PROTOCOL").when(host.isNull(), "MALFORMED")
            .when(host.isin(*METADATA_HOSTS), "METADATA_HOST").when(private, "PRIVATE_HOST").otherwise("OK"))
