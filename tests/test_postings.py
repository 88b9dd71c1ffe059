"""The maintained index against full scoring."""

import random

import pytest
from opsgraph.operators import postings, search
from pyspark.sql import functions as F


def chunks_of(spark, rng, n, start=0):
    words = [f"w{i}" for i in range(40)] + ["rare-1", "x", "y.z"]
    weights = [1 / (i + 1) for i in range(40)] + [0.01, 0.5, 0.02]
    rows = [(f"t{i % 2}", f"c{i}", i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(start, start + n)]
    df = spark.createDataFrame(rows, "tenant_id string, id string, seq long, content string")
    none = F.array().cast("array<string>")
    return df.select("tenant_id", "id", F.struct("seq").alias("chunk_seq"), "content", F.lit(None).cast("string").alias("section_header"), none.alias("error_codes"))


def rows_of(df):
    return sorted((r["tenant_id"], r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 2)) for r in df.collect())


@pytest.mark.parametrize("k, block", [(3, 8), (10, 4)])
def test_index_equals_full_scoring(spark, tmp_path, k, block):
    rng = random.Random(k)
    a, b = chunks_of(spark, rng, 300).cache(), chunks_of(spark, rng, 200, 300).cache()
    asked = spark.createDataFrame([(f"t{i % 2}", f"q{i}", q) for i, q in enumerate(["w0 rare-1", "w3 w17 w30 w39", "x x y.z", "w1 w2", "nothing here", "rare-1 w39 w0", ""])], "tenant_id string, query_id string, query string")
    path = f"{tmp_path}/index"
    postings.add_chunks(a, path, block)
    postings.add_chunks(b, path, block)
    both = a.unionByName(b)
    hits, read = postings.search_index(spark, asked, path, k)
    assert rows_of(hits) == rows_of(search.bm25_search(asked, both, top=k))
    read = {r["query_id"]: (r["blocks"], r["skipped"]) for r in read.collect()}
    assert sum(s for _, s in read.values()) > 0 and all(0 <= s <= b for b, s in read.values())
    gone = both.filter("chunk_seq.seq % 3 = 0")
    postings.remove_chunks(gone.select("tenant_id", F.col("id").alias("chunk_id")), path)
    want = rows_of(search.bm25_search(asked, both.filter("chunk_seq.seq % 3 <> 0"), top=k))
    assert rows_of(postings.search_index(spark, asked, path, k)[0]) == want
    postings.compact(spark, path, f"{path}-new", block)
    assert rows_of(postings.search_index(spark, asked, f"{path}-new", k)[0]) == want
    assert spark.read.parquet(f"{path}-new/lengths").count() == 500 - gone.count()
