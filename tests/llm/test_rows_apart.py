"""Repeated rows, clashing ids, file settings: what the operators do with rows that share an id or everything."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from fixtures import DATA, frame, prose, words
from opsgraph.llm import kd_sharding, quality, superminhash, training_order
from test_documents import components, shingles


@pytest.mark.parametrize("twin", [(7, "copy"), (None, "copy")])
def test_shards_stay_even_when_a_row_is_repeated(spark, twin):
    """The tie of each row is its own: half of all rows are one row, and no shard is far from its share."""
    rows = [(i, f"text {i} of many") for i in range(1000, 1480)] + [twin] * 480
    got = kd_sharding.kd_shards(frame(spark, rows), 24).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 8) for i, t in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    share = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - share) <= 26 for s in sizes.values())  # a row at most
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_widest_dimension_is_cut_first(spark):
    """Sizes that double many times outweigh two languages; equal sizes leave the cut to another dimension."""
    rows = frame(spark, [(i, "x" * (1 << i % 14)) for i in range(200)])
    keyed, dims = kd_sharding._keyed_rows(rows)
    edges = {d: (lambda r: (r[1] - r[0]) >> 32)(keyed.selectExpr(f"min({d})", f"max({d})").first()) for d in dims}
    assert max(edges, key=edges.get) == "k_bytes" and len(set(edges.values())) > 1
    keyed, dims = kd_sharding._keyed_rows(frame(spark, [(i << 24, "same") for i in range(200)]))
    edges = {d: (lambda r: (r[1] - r[0]) >> 32)(keyed.selectExpr(f"min({d})", f"max({d})").first()) for d in dims}
    assert max(edges, key=edges.get) == "k_id"


def test_many_shards_with_few_sums(spark, monkeypatch):
    monkeypatch.setattr(kd_sharding, "MAX_SUMS", 64)
    rows = [(i, "t" * (i % 50)) for i in range(3000)]
    got = kd_sharding.kd_shards(frame(spark, rows), None, 2500).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == round(sum(len(t) + 8 for _, t in rows) / 2500) and max(sizes.values()) - min(sizes.values()) <= 3 * 58


def test_one_file_a_shard_whatever_the_settings(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 90))) for i in range(300)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        shards = training_order.write_shards(frame(spark, rows), f"file://{tmp_path}/out", length=64, shard_rows=200)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = list(Path(tmp_path, "out").glob("shard=*/part-*"))
    assert len(files) == -(-shards.n // 200)
    loaded = training_order.Shards.load(spark, shards.path)
    assert loaded == shards
    pieces = Counter((i, k) for i, t in rows for k in range(-(-len(t.encode()) // 64)))
    got = training_order.read_shards(spark, loaded).collect()
    assert sorted(r["slot"] for r in got) == list(range(shards.n)) and Counter((r["doc_id"], r["seq_in_doc"]) for r in got) == pieces
    middle = shards.n // 2
    assert sorted(r["slot"] for r in training_order.read_shards(spark, loaded, middle).collect()) == list(range(middle, shards.n))
    whole = files[0].read_bytes()
    files[0].write_bytes(whole[: shards.stride * 5])
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not 200 records|has .* bytes"):
        training_order.read_shards(spark, loaded).collect()
    files[0].unlink()
    with pytest.raises(RuntimeError, match="shards from slot 0 on"):
        training_order.read_shards(spark, loaded)


def clash_rows(rng):
    """Rows of one id with other texts, near copies of either, repeated rows, rows without words or id."""
    near = lambda t: " ".join(w if k else "other" for k, w in enumerate(t.split()))
    a, b, c = (prose(rng, 60) for _ in range(3))
    return [(1, a), (1, a), (1, b), (2, near(a)), (3, near(b)), (9, near(b) + " end"), (9, c), (4, ""), (4, ""), (5, None), (None, a), (None, a), (6, b.upper())]


def brute_groups(rows):
    """Component of each ``(id, text)``: smallest id, and its rows."""
    nodes = sorted({(i, t) for i, t in rows if i is not None and shingles(t)}, key=str)
    sets = [shingles(t) for _, t in nodes]
    links = [(x, y) for x in range(len(nodes)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    comp = components(range(len(nodes)), links)
    low = defaultdict(list)
    for k, node in enumerate(nodes):
        low[comp[k]].append(node)
    return {node: (min(n[0] for n in low[comp[k]]), sorted(low[comp[k]], key=str)) for k, node in enumerate(nodes)}


def test_near_copies_of_clashing_ids(spark):
    rows = clash_rows(random.Random(4))
    groups = brute_groups(rows)
    keyed = frame(spark, rows)
    from opsgraph.llm.common import row_key

    text_of = {r[0]: r["text"] for r in keyed.select(row_key(), "text").collect()}
    got = superminhash.near_duplicates(keyed).collect()
    assert len(got) == len(rows)
    for r in got:
        node = (r["doc_id"], text_of[r["row_key"]])
        assert r["component_id"] == (groups[node][0] if node in groups else r["doc_id"])
    assert {r["component_id"] for r in got if r["doc_id"] == 3} == {1} and {r["component_id"] for r in got if r["doc_id"] == 2} == {1}
    assert sorted(r["component_id"] for r in got if r["doc_id"] == 9) == [1, 9]


def test_one_row_of_each_group_stays(spark):
    rows = clash_rows(random.Random(4))
    groups = brute_groups(rows)
    kept = [(r["doc_id"], r["text"]) for r in superminhash.keep_one(frame(spark, rows)).collect()]
    free = [(i, t) for i, t in rows if (i, t) not in groups]
    assert Counter(x for x in kept if x not in groups) == Counter(free)
    of = Counter(tuple(groups[x][1]) for x in kept if x in groups)
    assert set(of) == {tuple(g) for _, g in groups.values()} and set(of.values()) == {1}
    assert all(x[0] == groups[x][0] for x in kept if x in groups)
    assert (9, rows[6][1]) in kept  # an unrelated text of an id whose other text is a copy


def test_intersections_are_whole_numbers():
    h = np.arange(1, 40_001, dtype=np.uint64)
    d = np.zeros(len(h), int)
    inter = superminhash.intersections(h, d, 1, h[:30_000], d[:30_000], 1)
    assert inter.dtype.kind == "i" and inter[0, 0] == 30_000
    big = np.int64(777_777)
    assert 100 * big >= 75 * (big + big // 3)


def test_quality_of_clashing_ids(spark):
    """A poor text goes alone: another text of its id stays."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = {r["row_key"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    from opsgraph.llm.common import row_key

    texts = [(r["k"], r["text"]) for r in docs.select(row_key().alias("k"), "text").collect()]
    good, poor = next(t for k, t in texts if judged[k]), next(t for k, t in texts if not judged[k])
    both = docs.unionByName(frame(spark, [(77_001, good), (77_001, poor)]).select(*docs.columns))
    kept = [r["text"] for r in quality.keep_good(both, labels).filter("doc_id = 77001").collect()]
    assert kept == [good]


def test_pipeline_against_plain_python(spark):
    """Each stage's rows on a small table with odd rows, against its rule in plain Python."""
    import corpus_pipeline
    from opsgraph.llm import decontaminate
    from test_documents import brute_repeats

    rng = random.Random(6)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS).filter("doc_id < 60")
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leak = prose(rng, 20) + " " + next(t for t in items if len(words(t)) >= 12) + " " + prose(rng, 20)
    odd = clash_rows(rng) + [(9, leak), (3, leak), (300, prose(rng, 50)), (300, prose(rng, 50))]
    docs = docs.unionByName(frame(spark, odd).select(*corpus_pipeline.COLUMNS)).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    rows = pairs(docs)

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from opsgraph.llm.common import row_key

    good = {r["row_key"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    want = [(r["doc_id"], r["text"]) for r in docs.withColumn("k", row_key()).collect() if r["k"] in good]
    assert Counter(pairs(stages["quality"](spark, docs, DATA))) == Counter(want)

    groups = brute_groups(rows)
    out = pairs(stages["minhash"](spark, docs, DATA))
    assert Counter(tuple(groups[x][1]) for x in out if x in groups) == Counter({tuple(g): 1 for _, g in groups.values()})
    assert Counter(x for x in out if x not in groups) == Counter(x for x in rows if x not in groups)

    single = [x for x in rows if x[0] is not None and sum(y[0] == x[0] for y in rows) == 1]
    alone = spark.createDataFrame([(i, t, "en", "s", None) for i, t in single], docs.schema)
    brute = brute_repeats(single)
    out = {r["doc_id"]: r["text"] for r in stages["suffix"](spark, alone, DATA).collect()}
    assert set(out) == {i for i, (n, gone, _, _) in brute.items() if not gone or gone < n}
    assert all(len((out[i] or "").encode()) == brute[i][0] - brute[i][1] for i in out if not brute[i][1] or out[i].isascii())

    plain = lambda t: " " + " ".join(w.strip(".,;:!?\"'()") for w in words(t)) + " "
    out = pairs(stages["decontaminate"](spark, docs, DATA))
    assert (9, leak) not in out and (3, leak) not in out and {x for x in odd if x[1] != leak} <= set(out)
    long = [plain(t) for t in items if len(words(t)) >= decontaminate.WINDOW]
    assert all(not any(x in plain(t) for x in long) for _, t in out)

    packed = stages["packing"](spark, docs, DATA).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in packed) == Counter((i, len(words(t))) for i, t in rows)
    assert len({(r["bucket"], r["batch"], r["position"]) for r in packed}) == len(rows) and all(r["n_tokens"] + r["padding"] == r["boundary"] for r in packed)


def test_more_pieces_than_tasks(spark, monkeypatch):
    """Contexts come piece by piece where there are more pieces than tasks."""
    from opsgraph.llm import suffix_dedup
    from test_documents import brute_repeats

    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "MAX_TASKS", 3)
    rng = random.Random(12)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(i, prose(rng, 10) + rng.choice(shared) + prose(rng, 5) + rng.choice(shared)) for i in range(60)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), per_range=60).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)
