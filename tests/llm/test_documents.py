"""Operators on documents against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import corpus, frame, prose, words
from opsgraph.llm import kd_sharding, packing, suffix_dedup, superminhash, training_order
from opsgraph.llm.textops import distinct_shingles, mix

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


def empty(docs):
    return docs.limit(0)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs):
    sets = {i: shingles(t) for i, t in ROWS}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = superminhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert superminhash.near_duplicates(empty(docs)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = mix(rng.integers(1, 1 << 60, 400).astype(np.uint64))
    b = np.concatenate([a[:300], mix(rng.integers(1, 1 << 60, 100).astype(np.uint64))])
    s = superminhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    assert (superminhash.signatures(a[:1], np.zeros(1, int), 1) < np.uint64(128 << 56)).all()  # one element fills all slots
    slots = [superminhash._visit(a[:50], j) for j in range(128)]
    assert all(len({int(x[k]) for x in slots}) == 128 for k in range(50))  # each element visits each slot once


def brute_repeats(rows, key=lambda r: r[0], name=lambda r: r[0]):
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows}, key=key):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if seen.setdefault(w, (i, t, k)) != (i, t, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[name((i, t))] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, per_range", [(1, 100_000), (64, 100_000), (64, 40), (2, 25)])
def test_repeats(docs, hot, per_range):
    got = suffix_dedup.remove_repeats(docs, hot=hot, carry=("lang", "code"), per_range=per_range).collect()
    assert len(got) == len(ROWS) and {r["lang"] for r in got} == {"en"} and {r["code"] for r in got} == {"clash"}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(ROWS)
    untouched = {r["doc_id"]: r["kept_text"] for r in got if not r["n_removed"]}
    assert all(untouched[i] == t for i, t in ROWS if i in untouched)
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_clashing_ids_are_documents_of_their_own(spark):
    """Rows with one doc_id and other texts follow each other in the order of the text's hash."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    passages = [prose(rng, 40) for _ in range(4)]
    rows = [(i % 5, " ".join(rng.sample(passages, 2)) + prose(rng, i)) for i in range(20)] + [(1, None), (1, ""), (2, "short"), (3, passages[0]), (3, passages[0]), (7, passages[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64("text")).distinct().collect()}
    want = brute_repeats(rows, key=lambda r: (r[0], order[r]), name=lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = suffix_dedup.remove_repeats(df.withColumn("raw", F.sha2(F.coalesce("text", F.lit("")), 256)), carry=("raw",)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["raw"]): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert suffix_dedup.remove_repeats(spark.createDataFrame([(1, "long " * 60), (1, "short")], "doc_id long, text string")).count() == 2


def test_rows_without_id(spark):
    """A null doc_id: links with nothing, is kept, sharded, ordered and packed like others."""
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text, None, None), (None, text, "en", "a"), (3, text, "en", None), (4, None, None, "a")], "doc_id long, text string, lang string, source string")
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(None, 36, None, True), (None, 36, None, True), (3, 36, 3, True), (4, 0, 4, True)]))
    assert sorted(str(r["doc_id"]) for r in kd_sharding.kd_shards(df, 2).collect()) == ["3", "4", "None", "None"]
    packed = packing.pack(df, 2, 100).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in packed) == [("3", 40), ("4", 0), ("None", 40), ("None", 40)]


def test_null_id_stays_whole(spark):
    text = "abcdefghij" * 30
    df = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {None: 0, 1: 200 + 90, 2: 300}


def test_loser_tree_merges_in_order():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(5):
        strings = sorted(bytes(rng.integers(97, 99, rng.integers(1, 12)).tolist()) for _ in range(40))
        runs.append([(s, i, 0, 1, b"") for i, s in enumerate(strings)])
    merged = list(suffix_dedup.merge_runs([suffix_dedup.read_run(suffix_dedup.front_code(r)) for r in runs] + [iter(())]))
    strings = [m[0] for m in merged]
    assert strings == sorted(x[0] for r in runs for x in r)
    common = [0] + [len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))]) for a, b in zip(strings, strings[1:])]
    assert [m[1] for m in merged] == common


def test_shards(docs):
    got = kd_sharding.kd_shards(docs, 6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_sharding.kd_shards(empty(docs), 6).count() == 0


def test_shards_are_even_on_many_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 37 * 10).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    sizes = [r["s"] for r in kd_sharding.kd_shards(rows, 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.02 * min(sizes)
    assert kd_sharding.kd_shards(rows, target_bytes=sum(sizes) // 3).select("shard").distinct().count() == 3


def brute_tree(rows, leaves, tolerance):
    """Sets of row numbers per shard: every node is cut where the weight left of the cut is nearest to its goal."""
    if leaves == 1:
        return [frozenset(n for n, _, _ in rows)]
    total = sum(w for _, w, _ in rows)
    goal = total * (leaves // 2) / leaves
    options = []
    for d in range(len(rows[0][2]) if rows else 0):
        values = sorted({k[d] for _, _, k in rows})
        cuts = [(abs(sum(w for _, w, k in rows if k[d] < c) - goal), c) for c in [*values, values[-1] + 1]]
        options.append((-((values[-1] + 1 - values[0]) >> 32), d, min(cuts)))
    options.sort(key=lambda o: o[0])
    good = [o for o in options if o[2][0] <= tolerance]
    if not rows:
        return [frozenset()] * leaves
    _, d, (_, cut) = good[0] if good else min(options, key=lambda o: o[2][0])
    left, right = [r for r in rows if r[2][d] < cut], [r for r in rows if r[2][d] >= cut]
    return brute_tree(left, leaves // 2, tolerance) + brute_tree(right, leaves - leaves // 2, tolerance)


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_shards_are_cut_at_weighted_medians(spark, monkeypatch, shards):
    """The whole tree against brute force over all cuts of all dimensions, nulls included."""
    monkeypatch.setattr(kd_sharding, "TOLERANCE", 0.0)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)] + [(60, None, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    keyed, dims = kd_sharding._keyed_rows(df)
    weighed = [(r["doc_id"], r["size"], tuple(r[d] for d in dims)) for r in keyed.collect()]
    want = brute_tree(weighed, shards, 0.0)
    got = defaultdict(set)
    for r in kd_sharding.kd_shards(df, shards).collect():
        got[r["shard"]].add(r["doc_id"])
    assert [frozenset(got[k]) for k in range(shards)] == want


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 10))
        tops = sorted((rng.choice(60, n, replace=False) + 1).tolist())
        counts = rng.integers(1, 20, n).tolist()
        buckets = int(rng.integers(1, 6))
        cost = lambda edges: sum(c * (next(e for e in edges if e >= t) - t) for c, t in zip(counts, tops))
        best = min(cost(sorted({*x, tops[-1]})) for k in range(min(buckets, n)) for x in itertools.combinations(tops, k))
        got = packing.optimal_boundaries(tops, counts, buckets)
        assert len(got) <= buckets and set(got) <= set(tops) and cost(got) == best
    assert packing.optimal_boundaries([], [], 3) == []


def test_laid_out_sequences(spark, docs):
    """Each row's ids are those of its text and zeros up to its boundary; batches keep the budget."""
    ranks = {bytes([b]): 300 + b for b in range(256)}
    some = docs.filter("doc_id < 20 OR doc_id >= 4000")
    got = packing.lay_out(some, ranks, 3, 4000).collect()
    want = Counter((i, len((t or "").encode())) for i, t in ROWS if i < 20 or i >= 4000)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    texts = {i: (t or "").encode() for i, t in ROWS}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["boundary"] and not ids[r["n_tokens"] :].any() and bytes((ids[: r["n_tokens"]] - 300).astype(np.uint8)) == texts[r["doc_id"]]
    for _, batch in itertools.groupby(sorted(got, key=lambda r: (r["bucket"], r["batch"])), key=lambda r: (r["bucket"], r["batch"])):
        batch = list(batch)
        assert len(batch) == 1 or sum(r["boundary"] for r in batch) <= 4000


def test_packing(docs):
    got = packing.pack(docs, 4, 600).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(words(t))) for i, t in ROWS)
    for (_, _), batch in itertools.groupby(sorted(got, key=lambda r: (r["bucket"], r["batch"])), key=lambda r: (r["bucket"], r["batch"])):
        batch = list(batch)
        assert len(batch) == 1 or sum(r["boundary"] for r in batch) <= 600 or batch[0]["boundary"] == 0
        assert sorted(r["position"] for r in batch) == list(range(len(batch)))
        assert all(r["n_tokens"] + r["padding"] == r["boundary"] and r["padding"] >= 0 for r in batch)
    assert packing.pack(empty(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    p = training_order.feistel(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    if n == 1000:
        assert (p != training_order.feistel(np.arange(n), n, 8)).any() and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.2


def inverse(n, key):
    back = np.empty(n, int)
    back[training_order.feistel(np.arange(n), n, key)] = np.arange(n)
    return back


def test_training_order_round_trip(spark, docs, tmp_path):
    """Every sequence stands where the permutation of its number says, numbers following the rows of the scan."""
    shards = training_order.write_shards(docs.select("doc_id", "text", "id"), f"file://{tmp_path}/shards", length=64, shard_rows=50)
    n = sum(-(-len((t or "").encode()) // 64) for _, t in ROWS)
    assert (shards.n, shards.stride) == (n, 16 + 64 + 1)
    got = training_order.read_shards(spark, shards).collect()
    assert sorted(r["slot"] for r in got) == list(range(n))
    assert all(len(r["payload"]) == 64 and r["shard"] == r["slot"] // 50 and r["row_in_shard"] == r["slot"] % 50 for r in got)
    # in the order of the numbers, the sequences are those of one row after the other
    back = inverse(n, training_order.KEY)
    rows, text = [], b""
    for r in sorted(got, key=lambda r: back[r["slot"]]):
        if r["seq_in_doc"] == 0:
            rows.append((r["doc_id"], []))
        assert rows[-1][0] == r["doc_id"] and len(rows[-1][1]) == r["seq_in_doc"]
        rows[-1][1].append(r["payload"][: r["n_tokens"]])
        assert not any(r["payload"][r["n_tokens"] :])
    assert Counter((i, b"".join(p)) for i, p in rows) == Counter((i, t.encode()) for i, t in ROWS if t)


def test_records_stand_at_their_byte_offsets(spark, docs, tmp_path):
    shards = training_order.write_shards(docs, f"file://{tmp_path}/shards", length=64, shard_rows=50)
    got = {r["slot"]: r for r in training_order.read_shards(spark, shards).collect()}
    for k in (0, 3, shards.n // 50):
        (path,) = (tmp_path / "shards" / f"shard={k}").glob("part-*")
        raw = path.read_bytes()
        assert len(raw) == shards.stride * min(50, shards.n - 50 * k)
        for r in (0, len(raw) // shards.stride - 1):
            record = np.frombuffer(raw, shards.record, count=1, offset=r * shards.stride)[0]
            want = got[50 * k + r]
            assert (record["doc_id"], record["seq"], record["n"], record["ids"].tobytes()) == (want["doc_id"], want["seq_in_doc"], want["n_tokens"], want["payload"])
    rest = training_order.read_shards(spark, shards, 120).collect()  # in the middle of a shard
    assert sorted(rest) == sorted(r for s, r in got.items() if s >= 120)


def test_training_order_odd_tables(spark, docs, tmp_path):
    shards = training_order.write_shards(empty(docs), f"file://{tmp_path}/none")
    assert shards.n == 0 and training_order.read_shards(spark, shards).count() == 0
    odd = spark.createDataFrame([(None, "no id"), (-5, "below zero\n\0"), (3, ""), (4, None), (3, "twice"), (3, "twice")], "doc_id long, text string")
    got = training_order.read_shards(spark, training_order.write_shards(odd, f"file://{tmp_path}/odd", length=4)).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 2, -5: 3, 3: 4}


def test_training_order_with_a_vocabulary(spark, docs, tmp_path):
    """Ids above 65,535 take four bytes."""
    import base64

    for top, width in ((255, 1), (300, 2), (70_000, 4)):
        path = tmp_path / f"ranks{top}"
        path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % (top - b) for b in range(256)))
        ranks = training_order.read_ranks(str(path))
        shards = training_order.write_shards(docs.filter("doc_id IN (1, 2, 4000)"), f"file://{tmp_path}/t{top}", length=32, ranks=ranks)
        got = training_order.read_shards(spark, shards).collect()
        assert shards.width == width and all(len(r["payload"]) == 32 * width for r in got)
        ids = {r["doc_id"]: b"" for r in got}
        for r in sorted(got, key=lambda r: (r["doc_id"], r["seq_in_doc"])):
            ids[r["doc_id"]] += bytes((top - np.frombuffer(r["payload"], f"<u{width}")[: r["n_tokens"]].astype(int)).tolist())
        assert ids == {i: t.encode() for i, t in ROWS if i in (1, 2)}


def test_distinct_shingles_match_python():
    texts = [t or "" for _, t in ROWS]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, d = distinct_shingles(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
