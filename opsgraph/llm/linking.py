"""Connected components over links, and candidate links inside hash buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id of ``links(a, b)``: the smallest id reachable.

    Each round sends every vertex the least label of its neighbours, hooks that
    label also under the vertex' own root, and halves the path to the root, so
    the rounds are logarithmic in the longest chain.  Labels are written to the
    shared folder after each round; neighbours of a hot vertex are never
    gathered, only their minimum.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved"))
    labels = materialize(labels, "labels")
    while labels.filter("moved").limit(1).count():
        known = labels.select("id", "comp")
        heard = both.join(known, both.b == known.id).groupBy("a").agg(F.min("comp").alias("m"))
        told = known.join(heard, known.id == heard.a).select("id", "comp", F.least("comp", "m").alias("m"))
        hooked = told.select("id", "comp", "m").unionByName(told.filter("m < comp").select(F.col("comp").alias("id"), F.lit(None).cast("long").alias("comp"), "m"))
        hooked = hooked.groupBy("id").agg(F.max("comp").alias("old"), F.min("m").alias("comp"))
        up = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        labels = materialize(hooked.join(up, "comp", "left").select("id", F.least("comp", "root").alias("comp"), (F.least("comp", "root") < F.col("old")).alias("moved")), "labels")
    return labels.select("id", "comp")


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``comp`` to rows with an ``id``; an id without links is its own component."""
    return rows.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def link_buckets(members: DataFrame, verify, verify_blocks, whole: int = 512) -> tuple[DataFrame, DataFrame]:
    """Link what shares a bucket: returns ``(links, components)``; every pair in a bucket is covered.

    ``members(key, id)`` tells which ids stand in which bucket.
    ``verify(pairs(a, b))`` returns the pairs that truly link.  Pairs inside a
    component add nothing, so only pairs across components are tried:

    1. Each member meets its bucket's hub, the member with the most company over
       all its buckets.  In a group of copies this settles nearly all.
    2. Of buckets that still hold several components, let r members stand outside
       the largest.  If r times the bucket's size is at most ``whole``, these pairs
       are tried one by one.
    3. Larger buckets with the same hub are one group.  ``verify_blocks(groups(hub,
       id, comp, outside))`` compares the outsiders of each group with all its members in blocks
       of bounded size and returns links ``(a, b)``, at most one per id and block, that
       join what is linked; no pair becomes a row.
    """
    # what is summed per bucket is written first: beside a plain table, Spark can split a hot bucket in a join
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "sizes")
    crowded = materialize(members.join(sizes, "key"), "members")
    degree = crowded.groupBy("id").agg(F.sum("c").alias("deg"))
    ranked = crowded.join(degree, "id")
    hubs = materialize(ranked.groupBy("key").agg(F.min(F.struct((-F.col("deg")).alias("d"), F.col("id"))).alias("h")).select("key", F.col("h.id").alias("hub")), "hubs")
    pairs = crowded.join(hubs, "key").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    tried = materialize(pairs, "pairs")
    links = materialize(verify(tried), "verified")
    placed = with_component(crowded.select("key", "id"), components(links))
    heads = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = heads.groupBy("key").agg(F.sum("n").alias("s"), F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    mixed = materialize(mixed.select("key", (F.col("s") * (F.col("s") - F.col("top.n"))).alias("cost"), F.col("top.comp").alias("main")), "mixed")
    open_ = materialize(placed.join(mixed, "key"), "open")
    rest = open_.filter(f"cost <= {whole} AND comp <> main").select("key", F.col("id").alias("x"), F.col("comp").alias("xc"))
    few = open_.filter(f"cost <= {whole}").join(rest, "key").filter("comp <> xc").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
    fresh = materialize(few.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(materialize(verify(fresh), "verified"))
    wide = open_.filter(f"cost > {whole}")
    if wide.limit(1).count():
        # an id of one component may be an outsider in one bucket of a group only: it is one for the group
        groups = wide.join(hubs, "key").groupBy("hub", "id", "comp").agg(F.max((F.col("comp") != F.col("main")).cast("int")).alias("outside"))
        links = links.unionByName(materialize(verify_blocks(materialize(groups, "groups")), "blocks"))
    return links, components(links)
