"""Entity resolution: candidate joins, confidence, merge, review, decisions.

Nodes: ``tenant_id, id, canonical_id, entity_type, category, name, description,
attributes, source_refs, version, seq``.  Incoming rows have no id or version but an
``in_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import js_round
from ..functions.text import first_truthy, name_similarity, truthy
from .graph import materialize
from .ingest import number_rows
from .names import first_candidates, gram_postings, normal, pairs_above, similarity

MERGE, REVIEW = 0.80, 0.50
TAGS = ("asset_tag", "serial_number", "order_number")
MODELS = ("model", "product_id")


def _prepared(df: DataFrame, prefix: str) -> DataFrame:
    extra = {"canon": F.lower(truthy(F.col("canonical_id"))), "tag": F.lower(first_truthy(F.col("attributes"), *TAGS)), "model": first_truthy(F.col("attributes"), *MODELS)}
    df = df.withColumns(extra)
    keep = ["canonical_id", "entity_type", "name", "attributes", "canon", "tag", "model", *(["id", "seq"] if prefix == "e_" else ["in_id"])]
    return df.select("tenant_id", *[F.col(c).alias(prefix + c) for c in keep])


def fuzzy_confidence(name_sim: Column, model_sim: Column) -> Column:
    """Type .3, name .5, model .2, over the weights in use (null: not in use), rounded to two digits."""
    total = F.lit(0.3) + F.coalesce(name_sim * 0.5, F.lit(0.0)) + F.coalesce(model_sim * 0.2, F.lit(0.0))
    weight = F.lit(0.3) + F.when(name_sim.isNotNull(), 0.5).otherwise(0.0) + F.when(model_sim.isNotNull(), 0.2).otherwise(0.0)
    return js_round(total / weight, 2)


def _similarity(a: Column, b: Column) -> Column:
    return F.when(truthy(a).isNotNull() & truthy(b).isNotNull(), name_similarity(a, b))


def _best_by_name(pairs: DataFrame, asked: DataFrame, kinds: DataFrame) -> DataFrame:
    """``tenant_id, kind, x, m, confidence, e_seq, e_id`` of each asked name and model over the ``pairs`` of names given.

    Models only meet where names do.  Of one asked name and one model, only names whose similarity is within
    a rounding step of the best can give the best confidence, so all others fall away before.
    """
    at = ["tenant_id", "kind"]
    named = pairs.join(kinds.filter("y IS NOT NULL"), [*at, "y"]).groupBy(*at, "x", "l", "sim").agg(F.min("e").alias("e"))
    top = F.max("sim").over(W.partitionBy(*at, "x", "l"))
    named = named.withColumn("top", top).filter("sim >= top - 0.021").drop("top")
    # without a name on either side only the type and the models count
    bare = kinds.groupBy(*at, "l").agg(F.min("e").alias("e"), F.min(F.when(F.col("y").isNull(), F.col("e"))).alias("e0"))
    met = asked.filter("x IS NOT NULL").join(named, [*at, "x"]).select(*at, "x", "m", "l", "sim", "e")
    bare_met = asked.join(bare, at).select(*at, "x", "m", "l", F.lit(None).cast("double").alias("sim"), F.when(F.col("x").isNull(), F.col("e")).otherwise(F.col("e0")).alias("e")).filter("e IS NOT NULL")
    scored = met.unionByName(bare_met).withColumn("confidence", fuzzy_confidence(F.col("sim"), similarity(F.col("m"), F.col("l"))))
    best = scored.groupBy(*at, "x", "m").agg(F.max(F.struct("confidence", (-F.col("e.e_seq")).alias("s"), "e.e_id")).alias("b"))
    return best.select(*at, "x", "m", "b.confidence", (-F.col("b.s")).alias("e_seq"), "b.e_id")


def best_names(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``tenant_id, kind, x, m, confidence, e_seq, e_id``: the best node of each distinct name and model that reaches ``REVIEW``.

    ``existing(tenant_id, kind, y, l, e_seq, e_id)`` and ``incoming(tenant_id, kind, x, m)`` hold normal names and models.
    A first look at the rarest grams gives each name a confidence that it surely reaches; a name whose similarity
    is too low to reach that with an equal model can't be the best.  The second search therefore
    meets only what is as similar as that, by the gram index, and is exact.
    """
    at = ["tenant_id", "kind"]
    kinds = materialize(existing.groupBy(*at, "y", "l").agg(F.min(F.struct("e_seq", "e_id")).alias("e")))
    asked = materialize(incoming.distinct())
    names = kinds.filter("y IS NOT NULL").select(*at, "y").distinct()
    postings = materialize(gram_postings(names, at, "y"))
    sizes = postings.groupBy(*at, "gram").agg(F.count(F.lit(1)).alias("df"))
    first = first_candidates(asked.filter("x IS NOT NULL").select(*at, "x").distinct(), postings, sizes, at)
    seen = _best_by_name(first, asked, kinds).select(*at, "x", "m", F.col("confidence").alias("c"))
    sure = asked.filter("x IS NOT NULL").join(seen.withColumnsRenamed({"x": "__x", "m": "__m", "tenant_id": "__t", "kind": "__k"}),
        (F.col("tenant_id") == F.col("__t")) & (F.col("kind") == F.col("__k")) & (F.col("x") == F.col("__x")) & F.col("m").eqNullSafe(F.col("__m")), "left")
    c = F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(REVIEW)) - 0.0051
    least = F.when(F.col("m").isNotNull(), (c - 0.5) / 0.5).otherwise((c * 0.8 - 0.3) / 0.5)
    wanted = materialize(sure.groupBy(*at, "x").agg(F.min(F.least(least, F.lit(1.0))).alias("least")))
    pairs = materialize(pairs_above(wanted, names, postings, sizes, at))
    return _best_by_name(pairs, asked, kinds)


def match_candidates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming row's best existing node: ``tenant_id, in_id, e_id, confidence, rule``.

    Exact keys are equi joins.  A row without one gets the best of the names of its tenant and type by
    ``best_names``; rows whose best is below the review threshold may be absent or come with less than that.
    """
    return _match(materialize(_prepared(existing, "e_")), materialize(_prepared(incoming, "i_")))


def _match(e: DataFrame, i: DataFrame) -> DataFrame:
    exact = i.join(e.select("tenant_id", F.col("e_canon").alias("i_canon"), "e_id", "e_seq"), ["tenant_id", "i_canon"])
    exact = exact.select("tenant_id", "i_in_id", "e_id", "e_seq", F.lit(1.0).alias("confidence"), F.lit(1).alias("rule"))
    open_ = i.join(exact.select("tenant_id", "i_in_id").distinct(), ["tenant_id", "i_in_id"], "left_anti")
    tagged = open_.join(e.select("tenant_id", F.col("e_tag").alias("i_tag"), "e_id", "e_seq"), ["tenant_id", "i_tag"])
    tagged = tagged.select("tenant_id", "i_in_id", "e_id", "e_seq", F.lit(0.98).alias("confidence"), F.lit(2).alias("rule"))
    # a tagged row still meets the names: only a full match beats 0.98
    open_ = (open_.select("tenant_id", "i_in_id", F.col("i_entity_type").alias("kind"), normal(F.col("i_name")).alias("x"), normal(F.col("i_model")).alias("m")))
    nodes = e.select("tenant_id", F.col("e_entity_type").alias("kind"), normal(F.col("e_name")).alias("y"), normal(F.col("e_model")).alias("l"), "e_seq", "e_id")
    best = best_names(nodes, open_.select("tenant_id", "kind", "x", "m"))
    o, b = open_.alias("o"), best.alias("b")
    fuzzy = o.join(b, (F.col("o.tenant_id") == F.col("b.tenant_id")) & (F.col("o.kind") == F.col("b.kind")) & F.col("o.x").eqNullSafe(F.col("b.x")) & F.col("o.m").eqNullSafe(F.col("b.m")))
    fuzzy = fuzzy.select("o.tenant_id", "i_in_id", "b.e_id", "b.e_seq", "b.confidence", F.lit(3).alias("rule"))
    # a node counts by the first rule that it meets
    every = exact.unionByName(tagged).unionByName(fuzzy).groupBy("tenant_id", "i_in_id", "e_id").agg(F.min_by(F.struct("e_seq", "confidence", "rule"), "rule").alias("r"))
    every = every.select("tenant_id", "i_in_id", "e_id", "r.*")
    out = every.groupBy("tenant_id", "i_in_id").agg(F.max_by(F.struct("e_id", "confidence", "rule"), F.struct("confidence", -F.col("e_seq"))).alias("b"))
    return out.select("tenant_id", F.col("i_in_id").alias("in_id"), "b.e_id", "b.confidence", "b.rule")


def match_reasons(best: DataFrame, existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add ``match_reasons`` to ``best(tenant_id, in_id, e_id, rule, ...)``: what spoke for the chosen node, in the order of the rules."""
    return _reasons(best, _prepared(existing, "e_"), _prepared(incoming, "i_"))


def _reasons(best: DataFrame, e: DataFrame, i: DataFrame) -> DataFrame:
    pair = best.join(e.withColumnRenamed("e_id", "__e"), (best["tenant_id"] == e["tenant_id"]) & (best["e_id"] == F.col("__e"))).drop(e["tenant_id"])
    pair = pair.join(i.withColumnRenamed("tenant_id", "__t"), (F.col("tenant_id") == F.col("__t")) & (F.col("in_id") == F.col("i_in_id")))
    name, model = _similarity(F.col("i_name"), F.col("e_name")), _similarity(F.col("i_model"), F.col("e_model"))
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    # The wording of the reasons and the similarities from which they are given.
    fuzzy = F.array_compact(F.array(
        F.concat(F.lit("Same entity type: "), "e_entity_type"),
        F.when(name > 0.6, F.concat(F.lit("Name similarity: "), percent(name), F.lit(' ("'), "e_name", F.lit('" vs "'), "i_name", F.lit('")'))),
        F.when(model > 0.7, F.concat(F.lit("Model/Product similarity: "), percent(model)))))
    tag = first_truthy(F.col("e_attributes"), *TAGS)
    reasons = (F.when(F.col("rule") == 1, F.array(F.concat(F.lit('Exact canonical ID match: "'), "e_canonical_id", F.lit('"'))))
               .when(F.col("rule") == 2, F.array(F.concat(F.lit('Exact asset tag/serial match: "'), tag, F.lit('"')))).otherwise(fuzzy))
    return pair.select(*[best[c] for c in best.columns], reasons.alias("match_reasons"))


def resolve_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add to each incoming row ``action`` (MERGED_AUTOMATIC, QUEUED_FOR_REVIEW, CREATED_NEW), ``matched_id``, ``confidence`` and ``match_reasons``."""
    e, i = materialize(_prepared(existing, "e_")), materialize(_prepared(incoming, "i_"))
    best = materialize(_reasons(materialize(_match(e, i)), e, i))
    c = F.coalesce("confidence", F.lit(0.0))
    action = F.when(c >= MERGE, "MERGED_AUTOMATIC").when(c >= REVIEW, "QUEUED_FOR_REVIEW").otherwise("CREATED_NEW")
    out = incoming.join(best, ["tenant_id", "in_id"], "left").withColumn("action", action)
    sure = c >= REVIEW
    return out.withColumns({"matched_id": F.when(sure, F.col("e_id")), "confidence": F.when(sure, F.col("confidence")).otherwise(1.0),
                            "match_reasons": F.when(sure, F.col("match_reasons")).otherwise(F.array().cast("array<string>"))}).drop("e_id", "rule")


def merged_name(primary: Column, incoming: Column) -> Column:
    return F.when((incoming != "") & (F.length(incoming) > F.length(primary)), incoming).otherwise(primary)


def overlay(base: Column, top: Column) -> Column:
    """Maps merged, the second's values winning."""
    top = F.coalesce(top, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def merge_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes merged with incoming rows (``tenant_id, matched_id, ...``): longer name, later description and attributes, all references."""
    i = incoming.select("tenant_id", F.col("matched_id").alias("id"), F.col("name").alias("__n"), F.col("description").alias("__d"), F.col("attributes").alias("__a"), F.col("source_refs").alias("__s"))
    both = nodes.join(i, ["tenant_id", "id"])
    return both.withColumns({
        "name": merged_name(F.col("name"), F.col("__n")), "description": F.coalesce(truthy(F.col("__d")), F.col("description")), "attributes": overlay(F.col("attributes"), F.col("__a")),
        "source_refs": F.concat("source_refs", F.coalesce("__s", F.array().cast(dict(nodes.dtypes)["source_refs"]))), "version": F.col("version") + 1}).drop("__n", "__d", "__a", "__s")


def review_items(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pending review items of the queued rows, with the proposed attributes."""
    n = nodes.select("tenant_id", F.col("id").alias("matched_id"), F.col("attributes").alias("__a"))
    q = resolved.filter("action = 'QUEUED_FOR_REVIEW'").join(n, ["tenant_id", "matched_id"])
    return q.select(F.sha2(F.concat_ws("|", "tenant_id", F.col("in_id").cast("string")), 256).alias("id"), "tenant_id", F.col("matched_id").alias("primary_node_id"), F.col("in_id").alias("candidate_id"),
                    "confidence", "match_reasons", F.lit("PENDING").alias("status"), "name", "description", overlay(F.col("__a"), F.col("attributes")).alias("attributes"), "source_refs")


def pending_reviews(queue: DataFrame, tenant: str) -> DataFrame:
    return queue.filter((F.col("tenant_id") == tenant) & (F.col("status") == "PENDING")).orderBy(F.desc("created_at"), "id")


def decide_reviews(queue: DataFrame, decisions: DataFrame, nodes: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Apply ``decisions(tenant_id, id, decision, reviewer_email, notes)`` to pending items of the same tenant.

    Returns the queue after them, the merged nodes of approvals, an audit row per decision that applied, and the
    decisions that did not (``reason`` NOT_FOUND or ALREADY_DECIDED).
    """
    key = ["tenant_id", "id"]
    for c in ("reviewed_by", "reviewed_at", "decision_notes"):
        queue = queue if c in queue.columns else queue.withColumn(c, F.lit(None).cast("string"))
    d = decisions.select(*key, F.col("decision").alias("__d"), F.col("reviewer_email").alias("__r"), F.col("notes").alias("__n"))
    seen = queue.join(d, key, "left")
    applies = (F.col("status") == "PENDING") & F.col("__d").isNotNull()
    to = {"status": "__d", "reviewed_by": "__r", "decision_notes": "__n"}
    changed = {c: F.when(applies, F.col(x)).otherwise(F.col(c)) for c, x in to.items()} | {"reviewed_at": F.when(applies, F.lit(now)).otherwise(F.col("reviewed_at"))}
    after = seen.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])
    applied = seen.filter(applies)
    merged = merge_nodes(nodes, applied.filter("__d = 'APPROVED'").withColumn("matched_id", F.col("primary_node_id")))
    details = F.to_json(F.struct(F.col("id").alias("reviewItemId"), "confidence", F.col("__d").alias("decision"), F.col("__n").alias("notes")))
    audit = applied.select("tenant_id", F.col("__r").alias("actor_id"), F.col("__r").alias("actor_email"), F.lit("PROCESS_ENGINEER").alias("actor_role"), F.concat(F.lit("ENTITY_MERGE_"), "__d").alias("action"),
                           F.lit("KNOWLEDGE_GRAPH").alias("resource_type"), F.col("primary_node_id").alias("resource_id"), details.alias("details"), F.lit("SUCCESS").alias("status"), F.lit(now).alias("timestamp"))
    known = queue.select(*key, F.col("status").alias("__s"))
    refused = decisions.join(known, key, "left").filter("__s IS NULL OR __s <> 'PENDING'").withColumn("reason", F.when(F.col("__s").isNull(), "NOT_FOUND").otherwise("ALREADY_DECIDED")).drop("__s")
    return after, merged, audit, refused


def apply_resolution(existing: DataFrame, incoming: DataFrame, queue: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve incoming rows and apply the outcome: nodes after it, the review queue with new items, and the outcome rows.

    Sure matches are merged into their node, all others become nodes of their own (those under review too, until
    they are decided), with derived ids, version 1 and the next places in the order of ``in_id``.
    """
    outcome = materialize(resolve_entities(existing, incoming))
    sure = outcome.filter("action = 'MERGED_AUTOMATIC'")
    one = sure.groupBy("tenant_id", "matched_id").agg(F.min_by(F.struct(*[c for c in sure.columns if c not in ("tenant_id", "matched_id")]), "in_id").alias("x")).select("tenant_id", "matched_id", "x.*")
    merged = merge_nodes(existing, one)
    kept = existing.join(merged.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti").unionByName(merged)
    node_id = F.concat(F.lit("node_"), F.substring(F.sha2(F.concat_ws("|", "tenant_id", "canonical_id", F.col("in_id").cast("string")), 256), 1, 16))
    fresh = outcome.filter("action <> 'MERGED_AUTOMATIC'").withColumns({"id": node_id, "version": F.lit(1).cast(dict(existing.dtypes)["version"])})
    top = existing.groupBy("tenant_id").agg(F.max("seq").alias("__top"))
    fresh = number_rows(fresh, ["tenant_id"], ["in_id"], "__k").join(top, "tenant_id", "left").withColumn("seq", (F.coalesce("__top", F.lit(-1)) + F.col("__k")).cast(dict(existing.dtypes)["seq"]))
    nodes = kept.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(dict(existing.dtypes)[c]).alias(c) for c in existing.columns]))
    items = review_items(outcome, existing).withColumn("created_at", F.lit(now))
    return nodes, queue.unionByName(items.join(queue.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti"), allowMissingColumns=True), outcome.select("tenant_id", "in_id", "action", "matched_id", "confidence", "match_reasons")
