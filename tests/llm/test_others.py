"""Vectors, URLs, quality, licenses, decontamination and the pipeline."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import DATA, LOWER, corpus, frame, prose
from opsgraph.llm import decontaminate, licenses, quality, url_filter, vector_graph
from opsgraph.llm.textops import prefix_sums
from test_documents import components


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    centres = rng.normal(size=(6, 16))
    for i in range(300):
        v = centres[i % 6] + rng.normal(size=16) * (0.08 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 16, 0), (505, [float("nan")] + [1.0] * 15, 0), (506, [None] + [1.0] * 15, 0), (507, [float("inf")] * 16, 0), (508, [], 0), (509, [1.0, 2.0], 0), (510, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string").repartition(3)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    good = {i: [float(np.float32(x)) for x in v] for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and cos(good[a], good[b]) >= 0.93]
    comp = components([r[0] for r in rows], links)
    degree = {r[0]: sum(r[0] in x for x in links) for r in rows}
    for options in ({}, {"per_centre": 20, "block": 25}):
        got = vector_graph.near_vectors(df, **options)
        found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()}
        if not options:
            assert found == {i: (degree[i], comp[i], comp[i] == i) for i in degree}
        else:
            assert sum(found[i][0] for i in found) >= 0.97 * sum(degree.values()) and all(found[i][0] <= degree[i] for i in found)
        hits, true = vector_graph.audit(df, every=2, **options)
        assert hits >= 0.97 * true > 0
    lost = spark.createDataFrame([(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in vector_graph.near_vectors(lost).collect()} == {(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)}
    assert vector_graph.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n, spread", [(150, 0.15), (1500, 0.05), (3000, 0.12)])
def test_graph_search_finds_nearly_all(n, spread):
    """Members and visiting queries against brute force, over many shards; a dense clump stays reachable."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 24))
    x[n // 3 :] = x[: n - n // 3] + rng.normal(size=(n - n // 3, 24)) * spread
    x[: n // 5] = x[0] + rng.normal(size=(n // 5, 24)) * spread
    x /= np.linalg.norm(x, axis=1)[:, None]
    members, queries = x[: n * 3 // 4], x[n * 3 // 4 :]
    true = x @ members.T >= 0.93
    found = np.zeros_like(true)
    for a, b in vector_graph.range_search(members, queries, 0.93, True):
        found[a, b] = True
    true[np.arange(len(members)), np.arange(len(members))] = False
    assert not (found & ~true).any() and (found & true).sum() >= 0.98 * true.sum() > 0


def test_robust_prune_drops_what_a_listed_one_covers():
    x = np.array([[1.0, 0.0], [0.99, 0.141], [0.98, 0.199], [0.9, -0.436]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    gram = x @ x.T
    np.fill_diagonal(inner := gram.copy(), -3.0)
    assert [set(r[r >= 0].tolist()) for r in vector_graph.robust_prune(inner, gram)][0] == {1, 3}


def test_urls(spark):
    cases = [(1, "http://www.Example.com/en/x?q#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"), (3, "https://m.example.com/enx", "m.example.com", "/enx", "com/", "allow"),
             (4, "http://example.com", "example.com", "", None, "allow"), (5, "x://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), (6, "http://notnet/es/", "notnet", "/es/", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"),
             (9, "a://b://c/d", "b:", "//c/d", None, "allow"), (10, "http://net/fr/\nx", "net", "/fr/\nx", "net/fr/", "block"), (1, "http://x.org?u=/en/", "x.org", "", None, "allow")]
    df = spark.createDataFrame([(c[0], c[1], "html", "r") for c in cases], "page_id long, url string, html string, rule string")
    assert sorted(map(str, (tuple(r) for r in url_filter.judge_urls(df).collect()))) == sorted(str((c[0], *c[2:])) for c in cases)
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    deep = url_filter.judge_urls(df.filter("page_id = 2"), [("example.com", "/e", "allow"), ("m.example.com", "/", "block")]).first()
    assert (deep["rule"], deep["verdict"]) == ("m.example.com/", "block")


def test_trie_against_all_rules():
    rng = random.Random(1)
    hosts, paths = ["com", "b.com", "a.b.com", "org"], ["/", "/x", "/x/", "/x/y", ""]
    rules = [(h, p, "block") for h in hosts for p in paths if rng.random() < 0.6]
    trie = url_filter.build_trie(rules)
    for host in [*hosts, "z.a.b.com", "bcom", ""]:
        for path in ["/", "/x", "/xx", "/x/y/z", "/q", ""]:
            fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
            want = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
            got = url_filter.longest_match(trie, host, path)
            assert (got is None) == (want is None) and (want is None or len(got[0] + got[1]) == len(want[0] + want[1]))


def test_quality_held_out(spark):
    d = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = [r for r in quality.classify(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == 1 for r in rows if r["quality"] == 1]) > 0.95


def test_quality_edges(spark):
    docs = frame(spark, corpus(n=10))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 0), (5, None)], "doc_id long, quality int")
    got = quality.classify(docs, one).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {1.0}
    mixed = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.classify(docs, mixed).collect())
    assert quality.classify(docs.limit(0), one).count() == 0


def test_ridge_is_the_direct_solution(spark):
    """Partition sums give the normal equations of numpy on the collected rows, and the model its weights and calibration."""
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(["word" if rng.random() < 0.5 + 0.4 * (i % 2) else "x!|7"] * int(rng.integers(5, 60))) + "." * int(i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)], "doc_id long, quality int")
    stats = quality.statistics(docs).cache()
    model = quality.fit(stats, labels)
    table = stats.selectExpr("doc_id", "stats", f"pmod(pmod(xxhash64(doc_id, {quality.SEED}), 1000003), 3) AS fold").collect()
    x = np.array([r["stats"] for r in table], float)
    y = np.array([r["doc_id"] % 2 for r in table], float)
    fold = np.array([r["fold"] for r in table])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    f = model.features(x[fold != 0])
    penalty = quality.RIDGE * np.eye(f.shape[1])
    penalty[-1, -1] = 1e-6
    assert np.allclose(model.beta, np.linalg.solve(f.T @ f + penalty, f.T @ y[fold != 0]), atol=1e-6)
    raw = model.raw(x[fold == 0])
    bins = np.clip((raw + 1) / 3 * quality.CALIBRATION_BINS, 0, quality.CALIBRATION_BINS - 1).astype(int)
    known = np.unique(bins)
    cx, cy = quality.pool_adjacent([raw[bins == b].mean() for b in known], [(bins == b).sum() for b in known], [y[fold == 0][bins == b].sum() for b in known])
    assert np.allclose(model.x, cx) and np.allclose(model.y, cy)
    got = {r["doc_id"]: r["score"] for r in quality.score(stats, model).collect()}
    assert np.allclose([got[r["doc_id"]] for r in table], np.interp(model.raw(x), cx, cy))
    # the random cosines approximate the Gaussian kernel
    z = np.clip((x[:40] - model.mean) / model.scale, -8, 8)
    kernel = np.exp(-quality.GAMMA / len(quality.NAMES) * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    g = model.features(x[:40])[:, :-1]
    assert np.abs(g @ g.T - kernel).max() < 0.35 and np.abs(g @ g.T - kernel).mean() < 0.08


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, "good text of words " * (i + 1) if i % 2 else "7|7|!!" * (i + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(quality.statistics(docs), quality.fit(quality.statistics(docs), labels)).collect()}
    assert np.mean([got[i] for i in range(1, 40, 2)]) > 0.5 + np.mean([got[i] for i in range(0, 40, 2)])


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(size=50))
    n = rng.integers(1, 9, 50)
    p = rng.binomial(n, x)
    cx, cy = quality.pool_adjacent(x, n, p)
    assert (np.diff(cy) > 0).all() and (np.diff(cx) > 0).all()


def full_alignment(template, text):
    """Longest common subsequence, without a band."""
    best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template):
        for j, b in enumerate(text):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no charge").replace("modify, ", "")
    rng = random.Random(3)
    texts = ["Released under the MIT License.", prose(rng, 40) + "\n" + edited + "\n" + prose(rng, 20), None, "", "mit license " * 20, "é RELEASED  under the\nmit license!", prose(rng, 300), "x Licensed under CC BY-NC 4.0. y Licensed under CC BY-NC 4.0."]
    df = frame(spark, list(enumerate(texts)))
    got = licenses.scan(df).collect()
    by = {(r["doc_id"], r["license"]): r for r in got}
    assert {(r["doc_id"], r["license"]) for r in got} == {(0, "MIT-notice"), (1, "MIT"), (5, "MIT-notice"), (7, "CC-BY-NC-4.0-notice")}
    r = by[(1, "MIT")]
    span = texts[1].encode()[r["start_byte"] : r["end_byte"]].decode()
    assert span.startswith("Permission is hereby") and span.endswith("copies of the Software") and 0.9 < r["coverage"] < 1
    raw = [np.frombuffer(t.encode(), np.uint8) for t in (mit, texts[1])]
    a, b = (licenses.words(x, np.array([0, len(x)]))[3].tolist() for x in raw)
    assert r["n_matched"] == full_alignment(a, b)
    assert sum(r["doc_id"] == 7 for r in got) == 2
    assert licenses.scan(df.limit(0)).count() == 0


def test_short_license_forms(spark):
    texts = ["This project is licensed under the terms of the MIT license", "# SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU Lesser General Public License v2.1 or later", "All rights reserved.",
             "Released under the ABC License.", "SPDX-License-Identifier: ABC", None, "", "All rights reserved. " * 2000]
    df = frame(spark, list(enumerate(texts)) + [(0, texts[0])])
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert {k: set(v) for k, v in got.items()} == {0: {"MIT-notice-terms"}, 1: {"MIT-spdx"}, 2: {"GPL-3.0-or-later-spdx"}, 3: {"LGPL-2.1-later"}, 4: {"all-rights-reserved-notice"}, 9: {"all-rights-reserved-notice"}}
    assert len(got[0]) == 2 and len(got[9]) == 2000  # repeated rows and repeated notices


def test_winnowing_keeps_a_hit_in_every_window():
    g = np.random.default_rng(0).integers(0, 1 << 60, 100).astype(np.uint64)
    kept = set(licenses.winnow(g).tolist())
    assert all(kept & set(range(i, i + licenses.WINNOW)) for i in range(97)) and {0, 99} <= kept
    assert prefix_sums(np.zeros(0, np.uint8)).tolist() == [0]


def test_leaks(spark):
    q1 = "A train leaves Paris at 9 and travels 120 km in 3 hours, how far does it go in 5 hours if Anna drives at 40 km per hour"
    q2 = "short item with only seven words"
    other = "A train leaves Lyon at 8 and travels 300 km in 4 hours, how far does it go in 6 hours if Bob drives at 70 km per hour"
    clash = "A train leaves Lyon at 8 and travels 120 km in 8 hours, how far does it go in 8 hours if Bob drives at 8 km per hour"
    rng = random.Random(7)
    texts = [prose(rng, 30) + ". " + q1 + " " + prose(rng, 30), "Intro.\n" + other, "Intro.\n" + clash, "x. Short item with only seven words! y", None, "", prose(rng, 500), "short item with only seven cats"]
    df = frame(spark, list(enumerate(texts)))
    bench = spark.createDataFrame([(1, q1, "c"), (2, q2, "c"), (3, None, "c"), (4, "too short", "c")], "item_id long, text string, id string")
    rows = {}
    for most in (1000, 0):  # with and without the thinning broadcast
        got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["consistent"], r["verbatim"], r["contaminated"]) for r in decontaminate.leaks(df, bench, max_broadcast=most).collect()}
        assert rows in ({}, got)
        rows = got
    assert {k for k, v in rows.items() if v[3]} == {(0, 1), (1, 1), (3, 2)}
    assert rows[(0, 1)][2] and not rows[(1, 1)][2] and not rows[(2, 1)][1]
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {2, 4, 5, 6, 7}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def brute_tokens(text):
    """``(kind, canonical, value)`` of an ASCII text by one regular expression after the other."""
    words = set(decontaminate.NUMBER_WORDS)
    out = []
    last_end, last_kind, gap_from = None, None, 0
    for m in re.finditer(r"\d[0-9A-Za-z]*(?:[.,]\d[0-9A-Za-z]*)*|[0-9A-Za-z]+", text):
        t = m.group()
        gap = text[gap_from : m.start()]
        spelled = t.lower() in words
        if t[0].isdigit() or spelled:
            if out and out[-1][0] == "N" and len(gap) == 1 and (spelled or out[-1][3]):
                k, c, v, _ = out.pop()
                out.append(("N", c, " ".join((v + gap + t).lower().split()), True if spelled else False))
            else:
                out.append(("N", "<N>", t.lower(), spelled))
        elif out and out[-1][0] == "N" and t.lower() in decontaminate.UNITS:
            out.append(("U", "<U>", t.lower(), False))
        elif t[0].isupper():
            if out and out[-1][0] == "P" and gap.strip() == "":
                k, c, v, _ = out.pop()
                out.append(("P", c, " ".join((v + " " + t).lower().split()), False))
            else:
                out.append(("P", "<P>", t.lower(), False))
        else:
            out.append(("L", t.lower(), None, False))
        gap_from = m.end()
    return [x[:3] for x in out]


def brute_windows(text, plain, least):
    tokens = [("L", t.lower(), None) for t in re.findall(r"[0-9A-Za-z]+", text)] if plain else brute_tokens(text)
    size = decontaminate.WINDOW if least is None else least
    out = {}
    for k in range(len(tokens) - size + 1):
        w = tokens[k : k + size]
        if sum(x[0] == "L" for x in w) >= decontaminate.LITERALS * size:
            out[k] = (tuple(x[1] for x in w), tuple(x[2] for x in w if x[0] != "L"))
    return out


def brute_leak(text, item):
    """Is the document contaminated by the item (of ``WINDOW`` tokens or more)?"""
    for plain in (True, False):
        own, doc = brute_windows(item, plain, None), brute_windows(text, plain, None)
        diagonals = {}
        for d, (key, slots) in doc.items():
            for i, (k, s) in own.items():
                if key == k:
                    diagonals.setdefault(d - i, []).append((i, slots, s))
        covered = set()
        for windows in diagonals.values():
            pairs = {p for _, a, b in windows for p in zip(a, b)}
            few = all(len(pairs) - len({p[side] for p in pairs}) <= decontaminate.CLASHES for side in (0, 1))
            verbatim = any(a == b for _, a, b in windows)
            if few or verbatim:  # the texts are too short for a run of RUN windows beside more clashes
                covered |= {i for i, _, _ in windows}
        if own and len(covered) / len(own) >= decontaminate.COVERAGE:
            return True
    return False


def test_leaks_against_brute_force(spark):
    """Re-parameterised, cut, mixed and unrelated texts against plain Python."""
    rng = random.Random(11)
    names, units = ["Anna", "Bob", "Carla Jones", "New York", "Paris"], ["kg", "km", "hours", "dollars"]
    number = lambda: rng.choice([str(rng.randint(2, 99)), f"{rng.randint(1, 9)},{rng.randint(100, 999)}", f"{rng.randint(1, 9)}.{rng.randint(1, 9)}", "twelve", "twenty-five", "three hundred"])
    verbs = "carries sells finds paints moves counts".split()

    def story(seed):
        r = random.Random(seed)
        parts = [[r.choice(verbs), *prose(r, r.randint(3, 6)).encode("ascii", "ignore").decode().split()] for _ in range(4)]

        def tell():
            n, p = rng.choice(names), number()
            return " ".join(f"{n if k % 2 else 'Then'} {' '.join(w)} {p if k != 2 else number()} {rng.choice(units)} and then some more of it." for k, w in enumerate(parts))

        return tell

    items, docs = [], []
    for k in range(8):
        tell = story(k)
        items.append((k, tell()))
        for _ in range(4):
            docs.append("Intro words here. " + tell() + " The end of the text")
        text = items[-1][1].split()
        docs += [" ".join(text[: len(text) // 3]), " ".join(text[len(text) // 3 :]), items[-1][1].upper(), " ".join(text[: len(text) // 2] + text[len(text) // 4 :]), prose(rng, 60)]
    df, bench = frame(spark, list(enumerate(docs))), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in enumerate(docs) for i, x in items if brute_leak(t, x)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect() if r["contaminated"]}
    assert got == want and 40 < len(want) < 200


def test_leaks_odd_rows(spark):
    item = "how many apples are left in the basket when 5 of the 12 apples are eaten by the children"
    docs = spark.createDataFrame([(None, item), (1, item), (1, item), (2, None), (3, "  "), (4, "is the total number of animals that are left at the end of the day")], "doc_id long, text string")
    long = "what " + prose(random.Random(3), 40) + " is the total number of animals that are left at the end of the year"
    bench = spark.createDataFrame([(None, item), (1, item), (1, item), (5, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == {(None, None), (None, 1), (1, None), (1, 1)}
    assert not got[(4, 5)]["contaminated"] and got[(4, 5)]["consistent"]  # a common phrase of a long item
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(docs, bench).collect()) == ["2", "3", "4", "None"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert 0 < len(rows) <= n
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs, n = spark.createDataFrame(rows, out.schema), len(rows)
    assert len(rows) == n
    kept = {r["doc_id"] for r in rows}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == kept
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_url_query(spark, duck):
    from opsgraph.llm import entries

    got, want = entries.QUERIES["op9_url_filter"](spark, DATA), duck.sql(entries.SQL["op9_url_filter"]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None)))
    assert key(got.toPandas()) == key(want)


def table_rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]


def test_leak_query(spark):
    """On the table every leak is a verbatim item: those whose words stand in a row in the document, and no others."""
    from opsgraph.llm import entries

    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate(LOWER))) + " "
    docs, items = table_rows(spark, "documents", "doc_id", "text"), table_rows(spark, "benchmark", "item_id", "text")
    want = {(d, i) for d, t in docs for i, x in items if plain(x) in plain(t)}
    got = entries.QUERIES["op1_decontaminate"](spark, DATA).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["contaminated"]} == want and want


def test_order_query(spark):
    from opsgraph.llm import entries, training_order

    docs = table_rows(spark, "documents", "doc_id", "text")
    got = entries.QUERIES["op3_training_order"](spark, DATA).collect()
    pieces = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(-(-len(raw) // training_order.LENGTH)):
            part = raw[k * training_order.LENGTH : (k + 1) * training_order.LENGTH]
            pieces[(i, k)] = (len(part), zlib.crc32(part.ljust(training_order.LENGTH, b"\0")))
    assert {(r["doc_id"], r["seq_in_doc"]): (r["n_tokens"], r["payload_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    # the table is one file, so the numbers follow its rows
    numbers = [(i, k) for i, t in docs for k in range(-(-len((t or "").encode()) // training_order.LENGTH))]
    slots = training_order.feistel(np.arange(len(numbers)), len(numbers), training_order.KEY)
    assert {(r["doc_id"], r["seq_in_doc"]): r["slot"] for r in got} == dict(zip(numbers, slots.tolist()))


def test_license_query(spark):
    """Every reported span holds the matched words of its template in order, by a full alignment."""
    from opsgraph.llm import entries

    texts = {i: (t or "").encode() for i, t in table_rows(spark, "documents", "doc_id", "text")}
    templates = licenses.all_templates()
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.translate(LOWER))
    got = entries.QUERIES["op5_licenses"](spark, DATA).collect()
    assert got
    for r in got:
        words = split(templates[r["license"]])
        span = split(texts[r["doc_id"]][r["start_byte"] : r["end_byte"]].decode())
        assert r["n_words"] == len(words) and full_alignment(words, span) >= r["n_matched"] >= licenses.COVERAGE * len(words)
    phrase = split("Licensed under the Apache License, Version 2.0")
    found = {r["doc_id"] for r in got if r["license"].startswith("Apache")}
    assert {i for i, t in texts.items() if " ".join(phrase) in " ".join(split(t.decode()))} == found


def test_packing_query(spark):
    from opsgraph.llm import entries, packing

    docs = table_rows(spark, "documents", "doc_id", "text")
    lengths = collections.Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in docs)
    edges = packing.optimal_boundaries(sorted(lengths), [lengths[x] for x in sorted(lengths)], packing.BUCKETS)
    got = entries.QUERIES["op8_packing"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in docs)
    assert all(r["boundary"] == min(e for e in edges if e >= r["n_tokens"]) for r in got)
    room = collections.Counter((r["bucket"], r["batch"]) for r in got)
    for (bucket, batch), n in room.items():
        most = max(1, packing.TOKEN_BUDGET // max(edges[bucket], 1))
        assert n == most or batch == max(b for k, b in room if k == bucket)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows, clashing ids and clashing columns."""
    import corpus_pipeline

    some = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).select(*corpus_pipeline.COLUMNS)
    text = some.first()["text"]
    odd = spark.createDataFrame([(None, text, None, None, None), (7, None, None, "a", None), (8, "", "en", None, 0), (9, text, "en", "a", 3), (9, text, "en", "a", 3), (9, "other text of the same id", "en", "a", 3), (None, None, None, None, None)], some.schema)
    docs = some.unionByName(odd).repartition(3)
    for c in ("id", "codes", "__version", "bucket", "rank", "size", "h"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert 0 < len(rows) <= docs.count()
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)


def test_whole_licenses_and_siblings(spark):
    texts = licenses.all_templates()
    rng = random.Random(11)
    gpl3, mit, gpl2 = texts["GPL-3.0-text"], texts["MIT-text"], texts["GPL-2.0"]
    half = len(gpl3) // 2
    docs = ["Copyright X. All rights reserved. " + prose(rng, 20), prose(rng, 9) + "\n" + mit, mit[mit.index("The above copyright"):], gpl2, texts["LGPL-2.1"], texts["CC-BY-SA-4.0"], texts["CC-BY-4.0"],
            gpl3[:half] + prose(rng, 60) + gpl3[half:] + "\n" + prose(rng, 400) + "\n" + texts["GPL-2.0-text"], texts["LGPL-3.0"], "Licensed under CC BY-NC 4.0.", texts["BSD-2-Clause-text"], texts["BSD-3-Clause-text"]]
    got = {}
    for r in licenses.scan(frame(spark, list(enumerate(docs)))).collect():
        got.setdefault(r["doc_id"], []).append((r["start_byte"], r["license"], r["end_byte"]))
    names = {d: [x[1] for x in sorted(v)] for d, v in got.items()}
    assert names == {0: ["all-rights-reserved-notice"], 1: ["MIT-text"], 2: ["MIT-body"], 3: ["GPL-2.0"], 4: ["LGPL-2.1"], 5: ["CC-BY-SA-4.0"], 6: ["CC-BY-4.0"], 7: ["GPL-3.0-text", "GPL-2.0-text"],
                     8: ["LGPL-3.0"], 9: ["CC-BY-NC-4.0-notice"], 10: ["BSD-2-Clause-text"], 11: ["BSD-3-Clause-text"]}
    assert docs[1].encode()[got[1][0][0] : got[1][0][2]].decode() == mit.rstrip(".\n")


def test_every_link_is_found_in_many_shards(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(900, 24))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.concatenate([base, 0.935 * base + np.sqrt(1 - 0.935**2) * side, base[:30]])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    a, b = np.nonzero(np.triu(cos >= 0.93, 1))
    degree, comp = np.bincount(np.concatenate([a, b]), minlength=len(x)), components(range(len(x)), list(zip(a.tolist(), b.tolist())))
    for block in (1500, 40):
        got = vector_graph.near_vectors(df, per_centre=15, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(degree[i]), comp[i]) for i in range(len(x))}


def test_leaks_with_one_clash(spark):
    item = "a farmer has 5 red apples in the old basket and sells all of them for 5 coins at the big market, then buys 3 small pears"
    short = "when 5 plus 5 makes what number"
    texts = ["x. " + item.replace("for 5 coins", "for 7 coins"), "x. " + item.replace("5", "8").replace("3", "8"), "x. when 5 plus 7 makes what number", "x. when 6 plus 7 makes what number"]
    long = " and ".join(f"the {i} little grey birds of our garden eat {i + 40} seeds every single morning while it rains" for i in range(11, 19))
    texts.append("x. " + " and ".join(f"the {w} little grey birds of our garden eat {w + 40} seeds every single morning while it rains" for w in [91, 92, 93, 94, 91, 92, 93, 94]))
    bench = spark.createDataFrame([(1, item), (2, short), (3, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, list(enumerate(texts))), bench).collect() if r["contaminated"]}
    assert {(0, 1), (1, 1), (2, 2), (4, 3)} <= got and not {d for d, i in got if (d, i) not in {(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)}}
    pair = lambda a, b: [(a, b)]
    assert decontaminate.longest_run([pair(b"1", b"1"), pair(b"2", b"2"), pair(b"1", b"3"), pair(b"4", b"4")]) == 3 and decontaminate.longest_run([]) == 0


def test_leaks_without_literals_and_of_several_tokens(spark):
    items = ["12 + 35 = 47 and 8 * 9 = 72, 14 / 7 = 2, 100 - 1 = 99", "The Quick Brown Fox Jumps Over The Lazy Dog Near The Old River", "name three primes", "yes",
             "a van takes 48 crates from Oslo to the old harbour", "say which river runs through the middle of the small old town"]
    texts = ["x. " + items[0], "x. " + items[1] + ".", "Please name three primes.", "Yes!", "so yes it is", "x. a van takes 1,250.5 crates from New York to the old harbour", items[5].upper(), "name three other primes"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = {}
    for most in (1000, 0):
        got = {(r["doc_id"], r["item_id"]): tuple(r) for r in decontaminate.leaks(frame(spark, list(enumerate(texts))), bench, max_broadcast=most).collect() if r["contaminated"]}
        assert rows in ({}, got)
        rows = got
    assert set(rows) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 4), (6, 5)}
    assert rows[(0, 0)][6] and not rows[(5, 4)][6]
