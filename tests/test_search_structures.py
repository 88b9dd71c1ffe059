"""Gram search of names, mention automaton and blocked nearest vectors against brute force."""

import random

import numpy as np
import pytest
from opsgraph.operators import mentions, names, nearest, reason, resolve, search
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sim(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))


def some_names(rng, n):
    base = ["pump station", "pumpe", "hot bolt", "cold bolt", "valve 12", "valve 21", "x", "", "aaaaaaaa", "motor-7", "pumppump", "élan vital"]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), rng.choice("ab 12")) if rng.random() < 0.6 or not w else w.pop(rng.randrange(len(w)))
        out.append("".join(w).strip())
    return out


def test_pairs_above_any_similarity(spark):
    rng = random.Random(2)
    known, asked = sorted(set(some_names(rng, 120))), sorted(set(some_names(rng, 80)))
    least = {a: rng.choice([0.95, 0.8, 0.6, 0.45, 0.3, 0.0, -0.5, 1.0]) for a in asked}
    kept = spark.createDataFrame([("t", "k", y) for y in known], "tenant_id string, kind string, y string")
    ask = spark.createDataFrame([("t", "k", x, v) for x, v in least.items()] + [("u", "k", "pumpe", 0.5)], "tenant_id string, kind string, x string, least double")
    group = ["tenant_id", "kind"]
    postings = names.gram_postings(kept, group, "y")
    sizes = postings.groupBy(*group, "gram").agg(F.count(F.lit(1)).alias("df"))
    got = {(r["x"], r["y"]): r["sim"] for r in names.pairs_above(ask, kept, postings, sizes, group).collect()}
    want = {(x, y): sim(x, y) for x in asked for y in known if sim(x, y) >= least[x] - 1e-9}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def half_up(x):
    return np.floor(x * 100 + 0.5) / 100


def brute_best(nodes, rows):
    """Best node of each incoming row by the rule in plain Python."""
    out = {}
    for i, kind, name, model in rows:
        best = None
        for seq, (e, k, other, l) in enumerate(nodes):
            if k != kind:
                continue
            n = sim(name.lower().strip(), other.lower().strip()) if name and other else None
            m = sim(model.lower().strip(), l.lower().strip()) if model and l else None
            total = 0.3 + (n or 0) * 0.5 + (m or 0) * 0.2
            c = half_up(total / (0.3 + (0.5 if n is not None else 0) + (0.2 if m is not None else 0)))
            if best is None or c > best[0]:
                best = (c, e)
        if best and best[0] >= 0.5:
            out[i] = best
    return out


def test_best_name_is_exact(spark):
    rng = random.Random(7)
    kinds, models = ["A", "B"], ["M1", "m1x", "Q-77", "", None]
    nodes = [(f"n{i}", rng.choice(kinds), x or None, rng.choice(models)) for i, x in enumerate(some_names(rng, 90) + ["", ""])]
    rows = [(i, rng.choice(kinds + ["C"]), x, rng.choice(models)) for i, x in enumerate(some_names(rng, 120) + [None, "  ", "PUMPE"])]
    shape = "attributes map<string,string>, canonical_id string, entity_type string, name string, tenant_id string"
    existing = spark.createDataFrame([({"model": m} if m is not None else {}, f"c{e}", k, n, "t", e, s) for s, (e, k, n, m) in enumerate(nodes)], shape + ", id string, seq long")
    incoming = spark.createDataFrame([({"model": m} if m is not None else {}, f"x{i}", k, n, "t", i) for i, k, n, m in rows], shape + ", in_id long")
    got = {r["in_id"]: (r["confidence"], r["e_id"]) for r in resolve.match_candidates(existing, incoming).collect() if r["confidence"] >= 0.5}
    assert got == brute_best(nodes, rows)


@pytest.mark.parametrize("most, block", [(1 << 24, 1 << 25), (40, 300), (1, 1)])
def test_mentions(spark, most, block):
    rng = random.Random(1)
    words = ["e-4012", "pump", "pump station", "ump", "é", "😀", "a", "|", "", None, "not there"]
    texts = [(f"t{rng.randrange(3)}", i, " ".join(rng.choice([w or "x" for w in words[:8]] + ["fill", "er"]) for _ in range(rng.randrange(30)))) for i in range(200)] + [("t0", 900, None), ("t1", 901, ""), ("t9", 902, "pump")]
    terms = [(f"t{k}", w) for k in range(3) for w in words if w is None or (len(w) + k) % 3] + [("t0", "pump")] * 2 + [("t7", "pump")]
    got = mentions.mentions(spark.createDataFrame(texts, "tenant_id string, id long, text string"), spark.createDataFrame(terms, "tenant_id string, term string"), "id", most, block)
    want = sorted({(t, str(i), w) for t, i, x in texts if x is not None for u, w in terms if u == t and w is not None and w in x})
    assert sorted((r["tenant_id"], r["id"], r["term"]) for r in got.collect()) == want and want


def test_mention_operators(spark):
    texts = spark.createDataFrame([("t", "1", "The PUMP of e-4012 leaks"), ("t", "2", "valve"), ("t", "3", None), ("u", "4", "pump")], "tenant_id string, id string, content string")
    nodes = spark.createDataFrame([("t", "n2", "Pump", "P-1", 2), ("t", "n1", "of", "", 5), ("t", "n0", "nothing", "E-4012", 1)], "tenant_id string, id string, name string, canonical_id string, seq long")
    assert [tuple(r) for r in search.first_mention(texts, nodes).collect()] == [("t", "1", "n0")]
    chunks = texts.select("tenant_id", "id", "content", F.when(F.col("id") == "1", F.array(F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("linked_entity_ids"))
    linked = {r["id"]: r["linked_entity_ids"] for r in search.link_mentions(chunks, nodes.filter("canonical_id <> ''")).collect()}
    assert linked == {"1": ["old", "E-4012"], "2": [], "3": [], "4": []}
    docs = texts.select("tenant_id", "id", F.lit("d").alias("document_id"), "content", F.lit("").alias("section_header"), F.when(F.col("id") == "2", F.array(F.lit("W-1"))).otherwise(F.array().cast("array<string>")).alias("error_codes"))
    incidents = spark.createDataFrame([("t", "i1", "E-4012"), ("t", "i2", "W-1"), ("t", "i3", None), ("u", "i4", "E-4012")], "tenant_id string, id string, error_code string")
    assert sorted((r["incident_id"], r["chunk_id"]) for r in reason.doc_hits(incidents, docs).collect()) == [("i1", "1"), ("i2", "2")]


def brute_nearest(asked, rows, k, digits=3):
    out = set()
    for t, q, v in asked:
        found = []
        for u, c, place, w in rows:
            if u != t or not w or not v or len(w) != len(v):
                continue
            s = 0.0
            for x, y in zip(v, w):
                s += x * y
            s = max(-1.0, min(1.0, s))
            if s > 0:
                found.append((-np.floor(s * 10**digits + 0.5) / 10**digits, place, c))
        out |= {(t, q, c, -s, r) for r, (s, _, c) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("most", [1 << 25, 2000])
def test_nearest_vectors(spark, most):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 8))

    def unit(x):
        return (x / np.linalg.norm(x)).tolist()

    rows = [(f"t{i % 2}", str(i), [i % 7, i], unit(centres[i % 9] + 0.1 * rng.normal(size=8))) for i in range(900)]
    grid = [(f"t{i % 2}", str(1000 + i), [0, i], [0.25 * int(x) for x in rng.integers(0, 3, 8)]) for i in range(200)]  # many ties, halves at the edge of a step
    rows += grid + [("t0", "none", [9, 9], None), ("t0", "empty", [9, 9], []), ("t0", "short", [9, 9], [1.0, 0.0])]
    asked = [(f"t{i % 3}", f"q{i}", unit(centres[i % 9] + 0.3 * rng.normal(size=8))) for i in range(40)] + [("t0", "grid", [0.25] * 8), ("t0", "null", None), ("t1", "short", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "tenant_id string, chunk_id string, place array<long>, embedding array<double>").repartition(3)
    got = nearest.nearest(spark.createDataFrame(asked, "tenant_id string, query_id string, embedding array<double>"), df, 7, 3, most).collect()
    assert {(r["tenant_id"], r["query_id"], r["chunk_id"], r["similarity"], r["rank"]) for r in got} == brute_nearest(asked, rows, 7)


def test_cells_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 32))
    v = np.repeat(centres, 64, axis=0) + 0.02 * rng.normal(size=(4096, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    heap = nearest.Heap(5, 64)
    q = centres / np.linalg.norm(centres, axis=1)[:, None]
    skipped = nearest.search_block(heap, q, v, [([i], str(i)) for i in range(len(v))], 3)
    assert skipped > 0.5 * len(q) * len(v)
    s = np.floor(np.clip(q @ v.T, -1, 1) * 1000 + 0.5) / 1000
    for i in range(64):
        assert [int(n) for _, _, n in heap.rows[i]] == sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:5]
