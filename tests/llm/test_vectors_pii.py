"""Vector codes, whitening and personal data against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import DATA
from opsgraph.llm import ball_codes, pii, whitening
from opsgraph.llm.vectors import integer_vectors
from pyspark.sql import functions as F

BAD = [(9001, None, 1), (9002, [0.5, None, 0.5, 0.5] * 2, 1), (9003, [float("nan")] * 8, 2), (9004, [float("inf")] * 8, None), (9005, [], 1), (9006, [0.25] * 7, 1)]


def vectors(spark, n=700, d=8, seed=3, copies=250):
    """``n`` vectors in clusters, ``copies`` of one, some without label or id, and the bad ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = np.concatenate([centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.05, np.repeat(centres[:1], copies, axis=0)])
    ids = rng.permutation(len(x) * 3)[: len(x)].tolist()
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in zip(ids, x)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows + BAD, "vec_id long, embedding array<double>, label int").repartition(3)
    for c in ("x", "d", "codes", "far", "n", "part", "entry", "c"):
        df = df.withColumn(c, F.lit("clash"))
    return df, rows


def brute_codes(rows, rounds, entries):
    kept = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, _ in rows}
    first = sorted(kept)[:entries]
    d = len(kept[first[0]]) // 4
    x = np.array([np.floor(1024 * np.array(v)).astype(int) for _, v, _ in rows])
    books, codes, error = [], [], 0
    for p in range(4):
        part = x[:, p * d : (p + 1) * d]
        book = np.array([kept[i][p * d : (p + 1) * d] for i in first])
        for r in range(rounds + 1):
            dist = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            own = dist.argmin(axis=1)
            if r < rounds:
                for k in set(own.tolist()):
                    book[k] = np.floor_divide(part[own == k].sum(axis=0), (own == k).sum())
        books.append(book)
        codes.append(own)
        error = error + dist.min(axis=1)
    return np.array(codes).T, error, np.array(books)


@pytest.mark.parametrize("entries, rounds", [(256, 4), (16, 6), (5000, 2), (40, 0)])
def test_codes(spark, entries, rounds):
    df, rows = vectors(spark)
    coded, books = ball_codes.compress(df, entries=entries, rounds=rounds)
    want, error, book = brute_codes(rows, rounds, entries)
    assert (books == book).all()
    got = sorted((r["vec_id"], tuple(r["codes"]), r["error"], r["label"]) for r in coded.collect())
    assert len(got) == len(rows)
    assert [(g[0], g[1]) for g in got] == sorted((r[0], tuple(c)) for r, c in zip(rows, want.tolist()))
    assert [g[2] for g in got] == [e for _, e in sorted((r[0], e) for r, e in zip(rows, error.tolist()))]
    back = {r["vec_id"]: r["vector"] for r in ball_codes.reconstruct(coded, books).collect()}
    worst = {i: np.sqrt(e) for (i, _, _), e in zip(rows, error)}
    assert all(np.linalg.norm(1024 * np.array(v) - np.array(back[i]) * 1024) <= worst[i] + 4 for i, v, _ in rows)


def test_balls_skip_and_agree():
    """The rings' candidates give what a comparison with all entries gives; most parts of tight clusters meet none."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (64, 6))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-30, 30, (3000, 6))
    own = ball_codes.nearest(x, centres)
    moved = centres + rng.integers(-20, 20, centres.shape)
    moved[5] = moved[9]  # equal entries: the lower index wins
    radius = [int(np.sqrt(((x[own == k] - moved[k]) ** 2).sum(axis=1).max(initial=0))) + 2 for k in range(64)]
    balls = ball_codes.Balls(moved, radius)
    again, near = balls.assign(x, own)
    assert (again == ball_codes.nearest(x, moved)).all() and (near == ball_codes.distances(x, moved).min(axis=1)).all()
    assert balls.counts.sum() < 64 * 20
    for wide in (1, 1 << 26):
        y = rng.integers(-wide, wide + 1, (200, 5))
        c = rng.integers(-wide, wide + 1, (30, 5))
        assert (ball_codes.distances(y, c) == ((y[:, None] - c[None]) ** 2).sum(axis=2)).all()


def test_codes_odd_rows(spark):
    none = spark.createDataFrame(BAD[:5], "vec_id long, embedding array<double>, label int")
    assert ball_codes.compress(none)[0].count() == 0
    rows = [(None, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (7, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (7, [0.0, 2.0, 3.0, 4.0, 5.0], 1), (8, [1e300, -1e300, 3.0, 4.0, 5.0], None)]
    coded, books = ball_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rounds=1)
    assert books.shape == (4, 3, 2) and books[0, 0].tolist() == [0, 2048] and books[0, 2].tolist() == [1024, 2048] and books[2, :, 1].tolist() == [0, 0, 0]
    assert sorted(str(r["vec_id"]) for r in coded.collect()) == ["7", "7", "8", "None"]


def test_codes_query(spark, duck, tmp_path):
    got = ball_codes.query(spark, DATA).collect()
    want = duck.execute(ball_codes.SQL).fetchall()
    names = [c[0] for c in duck.description]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    df, rows = vectors(spark)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    code, error, book = brute_codes(rows, 4, 256)
    sums = {}
    for (_, _, label), e in zip(rows, error.tolist()):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for x in book.reshape(-1)).encode()).hexdigest()
    want = sorted((r[0], "".join(f"{c:02x}" for c in cs), e, sums[r[2]], digest) for r, cs, e in zip(rows, code.tolist(), error.tolist()))
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in ball_codes.query(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("kind", ["plain", "graded", "low rank", "equal values", "tiny"])
def test_solver(kind):
    rng = np.random.default_rng(4)
    for _ in range(6):
        n, d = (2, 5) if kind == "tiny" else (int(rng.integers(20, 120)), int(rng.integers(2, 40)))
        a = rng.normal(size=(n, d))
        if kind == "graded":
            a *= 10.0 ** rng.integers(-6, 6, d)
        if kind == "low rank":
            a[:, d // 2 :] = a[:, :1]
        if kind == "equal values":
            a = np.eye(d)[rng.integers(0, d, n)] * 3
        r = whitening._triangle(a, d)
        values, v = whitening.solve(r)
        assert np.abs(values - np.linalg.svd(r, compute_uv=False) ** 2).max() <= 1e-13 * values[0]
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-11
        assert np.abs((r @ v).T @ (r @ v) - np.diag(values)).max() <= 1e-11 * values[0]


def test_small_values_are_accurate():
    """dqds keeps the relative accuracy of the least singular values, which a solver of the product loses."""
    a, b = 10.0 ** -np.arange(8.0), 10.0 ** -np.arange(1.0, 8.0)
    values = whitening.dqds(a, b)
    from fractions import Fraction

    exact = Fraction(1)
    for x in a:
        exact *= Fraction(x) ** 2
    assert abs(float(np.prod(values)) / float(exact) - 1) < 1e-13


def check_whitening(got, rows, components=32):
    x = np.array([np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for _, v, _ in rows])
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, len(e))
    want = {}
    for i, row in zip(range(n), c @ u[:, :k] / np.sqrt(e[:k])):
        want.setdefault(rows[i][0], (int(((x[i] * n - s).astype(object) ** 2).sum()), row))
    sign = {}
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for r in got:
        dev, row = want[r["vec_id"]]
        j = r["component"] - 1
        if abs(row[j]) > 0.1:
            assert sign.setdefault(j, np.sign(row[j] * r["whitened"])) == np.sign(row[j] * r["whitened"])
        assert r["deviation"] == dev and abs(abs(r["whitened"]) - abs(row[j])) < 1e-7 and abs(r["explained"] / (e[j] / np.trace(cov)) - 1) < 1e-9


def test_whitening_query(spark, tmp_path):
    rows = [(r["vec_id"], r["embedding"], None) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitening(whitening.query(spark, DATA).collect(), rows)
    df, rows = vectors(spark)
    df.repartition(70).write.parquet(f"{tmp_path}/embeddings.parquet")  # more tasks than one round of merging takes
    check_whitening(whitening.query(spark, str(tmp_path)).collect(), rows)


def test_whitening_odd_rows(spark):
    def run(rows):
        found, length = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 64, 1_000_000, 1 << 31)
        model = whitening.fit(found, length)
        return model and (model, whitening.whiten(found, model).collect())

    assert run(BAD[:5]) is None
    assert run([(1, [0.5, 0.25], None)]) is None and run([(1, [0.5, 0.25], None), (2, [0.5, 0.25], None)]) is None
    model, got = run([(None, [0.0, 1.0, 7.0], 1), (2, [1.0, 0.0, 7.0], 1), (2, [1.0, 0.0, 7.0], 1)])
    assert len(model.values) == 1 and sorted(str(r["vec_id"]) for r in got) == ["2", "2", "None"]
    assert abs(sum(r["whitened"][0] for r in got)) < 1e-12
    model, got = run([(1, [1e300, 0.0], 1), (2, [0.0, 0.0], 1), (3, [0.0, 1e-3], 1)])
    assert len(got) == 3 and all(np.isfinite(r["whitened"]).all() for r in got)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x.lstrip("0")[:9] or 0) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and check_digit(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(BASE).index(kind), m.end()))
    return [(s, list(BASE)[k], e) for s, k, e in sorted(out)]


def soup(rng, n):
    """Text of pieces that make and break the patterns."""
    pieces = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "256", "4111111111111111", "5500 0000 0000 0004", "a", "b.c", "x@y.z", "é", "İ", "😀", "+1 (017) 555-7713", "10.0.0.1", "_", "%", "..", "@@", "0", "\n", "-.", "a@b"]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_base_spans_against_patterns(spark):
    rng = random.Random(9)
    rows = [(i, soup(rng, rng.randint(1, 60))) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "1 " * 40000), (5003, "a" * 30000 + "@b.c"), (5004, "7." * 9001 + "@" * 500), (None, "x@y.zz"), (0, "x@y.zz"), (0, "x@y.zz"), (6000, "0" * 5000 + "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("spans", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    want = sorted(str((i, brute_base(t))) for i, t in rows)
    assert sorted(str((r["doc_id"], [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]])) for r in got) == want
    for r in got:
        base = [(s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert all(s["base"] or not any(a <= s["start"] and s["end"] <= b for a, b in base) for s in r["spans"])
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, spans", [
    ("IBAN: DE89 3704 0044 0532 0130 00 and more", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("IBAN DE89 3704 0044 0532 0130 01", []),
    ("Account no. 123-456789 closed", [("account", "123-456789")]),
    ("accounts 123456789, discount 123456789", []),
    ("SSN 123-45-6789, ssn 000-45-6789, ssn 123-45-67890", [("ssn", "123-45-6789")]),
    ("Tel: (030) 555-7713 or tel 12", [("phone", "(030) 555-7713")]),
    ("Phone: +1 (017) 555-7713", [("phone", "+1 (017) 555-7713")]),
    ("jane.doe [at] example [dot] org, the man (at) home", [("email", "jane.doe [at] example [dot] org")]),
    ("see ftp://joe:secret@host.example/a and http://host/a@b", [("url", "ftp://joe:secret@host.example"), ("email", "secret@host.example")]),
    ("4111111111111111 4845168114407320", [("card", "4111111111111111")]),
    ("4111111111111111 5500 0000 0000 0004", [("card", "4111111111111111"), ("card", "5500 0000 0000 0004")]),
    ("from 97.51.17.173 4111111111111111.", [("ip", "97.51.17.173"), ("card", "4111111111111111")]),
])
def test_added_spans(text, spans):
    assert [(pii.KINDS[k], text[s:e]) for s, k, e, _ in pii.find(text, pii.automaton())] == spans


def test_redact_and_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "write to a@b.cd, é now", "en"), (2, "clean", "en"), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["text"] or "" for r in pii.redact(df).collect()) == ["", "clean", "write to [email], é now"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = pii.query(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[1] == k for x in base) for k in BASE]
        listed = [f"{k}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))
