"""Scalar text expressions: type inference, tokens, codes, specs, cells, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ID_COLUMNS = ("id", "ID", "order_id", "OrderID", "order_number", "telemetry_id", "ticket_id", "code", "sku", "SKU")
ERROR_CODE = r"(?i)\b((?:E|W|A|F|ALM|ERR|CODE)[-_]?(?:[A-Za-z0-9]{1,6}[-_])?[0-9]{2,6}[A-Za-z]?)\b"
# a name is looked for where a run of letters and blanks begins (or the last match ended) and is not given back, so a run is read once
TECH_SPEC = r"(?i)(?:\G|(?<![A-Za-z\s]))[A-Za-z\s]++[:=]\s*(?:[0-9.]+\s*(?:bar|psi|rpm|mm|m/s|kw|v|vac|vdc|hz|khz|c|°c|celsius|kg|kn))\b"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}(T|\s)\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def trimmed(c: Column) -> Column:
    """Without white space (blanks, tabs, line ends) on both sides."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.when(c != "", c)


def first_truthy(attributes: Column, *keys: str) -> Column:
    """The first non-empty of several keys of a map."""
    return F.coalesce(*[truthy(F.try_element_at(attributes, F.lit(k))) for k in keys])


def is_timestamp(value: Column) -> Column:
    """A date and time by its pattern, with a month, day, hour, minute and second that exist, and no fraction without seconds."""
    part = lambda a, n: F.try_to_number(F.substring(value, a, n), F.lit("99"))
    second = F.when(F.substring(value, 17, 1) == ":", part(18, 2)).otherwise(0)
    inside = part(6, 2).between(1, 12) & part(9, 2).between(1, 31) & (part(12, 2) <= 23) & (part(15, 2) <= 59) & (second <= 59) & (F.substring(value, 17, 1) != ".")
    return value.rlike(TIMESTAMP) & F.coalesce(inside, F.lit(False))


def infer_type(value: Column) -> Column:
    """INTEGER, FLOAT, BOOLEAN, TIMESTAMP, JSON or STRING (also for null and empty values)."""
    v = trimmed(value)
    braces = (v.startswith("{") & v.endswith("}")) | (v.startswith("[") & v.endswith("]"))
    return (F.when(value.isNull() | (value == ""), "STRING")
            .when(F.lower(v).isin("true", "false", "yes", "no"), "BOOLEAN")
            .when(v.rlike(r"^-?\d+$"), "INTEGER")
            .when(v.rlike(r"^-?\d+\.\d+$"), "FLOAT")
            .when(is_timestamp(v), "TIMESTAMP")
            .when(braces & F.try_parse_json(v).isNotNull(), "JSON")
            .otherwise("STRING"))


def clean_cell(cell: Column) -> Column:
    """Trimmed, with one quote taken off each end."""
    return trimmed(F.regexp_replace(trimmed(cell), r"^[\"']|[\"']$", ""))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, ignoring case and outer blanks; 1 if equal, 0 if one is empty."""
    x, y = F.lower(trimmed(a)), F.lower(trimmed(b))
    longest = F.greatest(F.length(x), F.length(y))
    return (F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0)
            .otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased tokens of letters, digits and ``- _ . /``; a hyphenated one is followed by its joined form."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\-_./]", " "), r"\s+"), lambda t: t != "")
    return F.flatten(F.transform(raw, lambda t: F.when(t.contains("-"), F.array(t, F.replace(t, F.lit("-"), F.lit("")))).otherwise(F.array(t))))


def error_codes(text: Column) -> Column:
    """Alarm codes, upper-cased, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ERROR_CODE), F.lit(1)), F.upper))


def tech_specs(text: Column) -> Column:
    """``name: number unit`` pairs as a map; the last of equal names counts."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TECH_SPEC), F.lit(0)), lambda m: F.transform(F.split(m, "[:=]"), trimmed))
    # the pairs are bound to a name by a list of one, else the text would be matched anew for each of them
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y[0] == x[0]))
    maps = F.transform(F.array(found), lambda p: F.map_from_entries(F.transform(last(p), lambda x: F.struct(x[0], x[1]))))
    return F.coalesce(F.get(maps, 0), F.create_map().cast("map<string,string>"))


def table_cells(lines: Column) -> Column:
    """Rows of trimmed cells of ``|`` lines, without rule cells and empty rows."""
    rows = F.transform(F.filter(lines, lambda x: x.contains("|")), lambda x: F.filter(F.transform(F.split(x, r"\|"), trimmed), lambda c: (c != "") & ~c.rlike("^[-:]+$")))
    return F.filter(rows, lambda r: F.size(r) > 0)


def token_count(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def external_id(payload: Column, row_index: Column, column: str | None = None) -> Column:
    """The configured column, else the first id-like one with a value, else ``ext_<n>``; 0, false and empty count as none."""
    def value(k):
        v = F.try_element_at(payload, F.lit(k))
        return F.when(~v.isin("", "0", "false"), v)

    return F.coalesce(*[value(k) for k in ([column] if column else ID_COLUMNS)], F.concat(F.lit("ext_"), row_index.cast("string")))


def any_match(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])
