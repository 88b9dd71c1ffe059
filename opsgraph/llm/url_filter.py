"""URL filter: a broadcast trie over reversed host labels and path segments.

``judge_urls(pages, rules)`` judges each row's ``url``.

* Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
  end, A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the end.  A null
  url, or one without ``://``, has an empty host and path.
* A rule fits its host and all subdomains if the url's path starts with the
  rule's path.  Of several that fit, the one with the longest host and path
  together wins, then the longer host.
* A url that no rule fits gets ``default`` (allow) and a null rule.
* A null page_id stays null and its url is judged like others.
* Empty tables give empty results; repeated rows are judged one by one; columns
  of the input other than the id are not carried, so names cannot clash.

The rules are a parameter list and not data; ``MAX_RULE_BYTES`` bounds what is
sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_RULE_BYTES = 64 << 20


def build_trie(rules) -> dict:
    """Host labels from the last to the first, then a path trie at each host that has rules.

    A path node keeps at ``None`` the list of ``(tail, rule, verdict)`` of rules
    that end inside the next segment, an empty tail where they end with ``/``.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("." + label, {})
        node = node.setdefault("paths", {})
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        node.setdefault(None, []).append((tail, host, path, verdict))
    return root


def longest_match(trie: dict, host: str, path: str):
    """The best ``(host, path, verdict)`` rule for a host and path, or None."""
    best = None
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get("." + label)
        if node is None:
            break
        at = node.get("paths")
        for segment in segments:
            if at is None:
                break
            for tail, *rule in at.get(None, ()):
                if segment.startswith(tail):
                    key = (len(rule[0]) + len(rule[1]), len(rule[0]))
                    if best is None or key > best[0]:
                        best = (key, rule)
            at = at.get("/" + segment)
    return best and tuple(best[1])


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Return ``key, host, path, rule, verdict`` for each row of ``pages``."""
    size = sum(len(h) + len(p) + 64 for h, p, _ in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"the rules take {size} bytes; the broadcast trie is bounded by {MAX_RULE_BYTES}")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in parts:
            found = [longest_match(root, h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({
                "rule": [f and f[0] + f[1] for f in found],
                "verdict": [f[2] if f else default for f in found],
            })

    judged = F.pandas_udf(judge, T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    parts = pages.select(F.col(key).alias(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    return parts.withColumn("__j", judged("host", "path")).select(key, "host", "path", "__j.rule", "__j.verdict")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT p.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY p.page_id)
SELECT p.page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
