"""Temporal property graph: endpoint checks, traversal, statistics, dossiers.

Nodes: ``tenant_id, id, entity_type, category, name, canonical_id, seq``.
Edges: ``tenant_id, id, source_id, target_id, relation_type, valid_from, valid_to, seq``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dossier's place of each entity type.
BUCKETS = {
    "Component": "components", "Sensor": "sensors", "Tool": "tools", "WorkOrder": "work_orders", "SKU": "products", "Batch": "products", "Serial": "products", "Material": "products",
    "MaintenanceOrder": "maintenance_orders", "FailureMode": "failure_modes", "SparePart": "spare_parts", "Defect": "defects", "Inspection": "inspections",
}
SLOTS = ("Plant", "Line", "Cell", "Station")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local temporary folder serves a ``local`` master; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="opsgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Written once to the folder that all executors share."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_SIDE = 100_000


def join_tenant(big: DataFrame, small: DataFrame, key: str, most: int = SMALL_SIDE) -> DataFrame:
    """Each row of ``big`` with every row of its tenant in ``small``.

    The small side is written and counted: up to ``most`` rows are broadcast.  Beyond, it is
    repeated for as many slices as there are shuffle partitions and each tenant's rows of ``big``
    are dealt to these by ``key``, so that no task gets a whole tenant.
    """
    small = materialize(small)
    if small.count() <= most:
        return big.join(F.broadcast(small), "tenant_id")
    slices = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = big.withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    return dealt.join(small.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["tenant_id", "__slice"]).drop("__slice")


def active_asof(edges: DataFrame, as_of) -> DataFrame:
    """Edges that hold at a time, both ends included."""
    t = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    return edges.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t)))


def check_endpoints(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends exist in their tenant, and the others."""
    known = nodes.select("tenant_id", "id")
    s, t = known.withColumnRenamed("id", "source_id"), known.withColumnRenamed("id", "target_id")
    good = edges.join(s, ["tenant_id", "source_id"], "left_semi").join(t, ["tenant_id", "target_id"], "left_semi")
    bad = edges.join(s, ["tenant_id", "source_id"], "left_anti").unionByName(edges.join(s, ["tenant_id", "source_id"], "left_semi").join(t, ["tenant_id", "target_id"], "left_anti"))
    return good, bad


def with_edge_defaults(edges: DataFrame, now) -> DataFrame:
    """Confidence 1.0 and validity from now where not given."""
    return edges.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("valid_from", F.coalesce("valid_from", F.lit(now).cast("timestamp")))


def append_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The edges with those of ``new`` whose ends exist, defaults filled in, and the rejected ones."""
    good, bad = check_endpoints(with_edge_defaults(new, now), nodes)
    return edges.unionByName(good, allowMissingColumns=True), bad


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """``tenant_id, at, next, edge_id, dir`` of the walkable edges; outgoing ones come first."""
    down = edges.select("tenant_id", F.col("source_id").alias("at"), F.col("target_id").alias("next"), F.col("id").alias("edge_id"), F.col("seq").alias("edge_seq"), F.lit("DOWNSTREAM").alias("dir"), F.lit(0).alias("dir_no"))
    up = edges.select("tenant_id", F.col("target_id").alias("at"), F.col("source_id").alias("next"), F.col("id").alias("edge_id"), F.col("seq").alias("edge_seq"), F.lit("UPSTREAM").alias("dir"), F.lit(1).alias("dir_no"))
    return {"DOWNSTREAM": down, "UPSTREAM": up, "BOTH": down.unionByName(up)}[direction]


def _exist(asked: DataFrame, exists: DataFrame, most: int = SMALL_SIDE) -> DataFrame:
    """What stands of ``asked`` in ``exists``: up to ``most`` rows travel to it, so that it is read and not shuffled; beyond that all of it."""
    if asked.count() > most:
        return exists
    return F.broadcast(exists.join(F.broadcast(asked.distinct()), asked.columns, "left_semi"))


def traverse(roots: DataFrame, nodes: DataFrame, edges: DataFrame, direction: str = "DOWNSTREAM", max_depth: int = 3, as_of=None, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk from ``roots(tenant_id, root_id)``: reached nodes and walked edges.

    Nodes carry ``depth`` and the edge and direction that found them first; a hop
    is one join of the frontier with the edges, a reduction to the first finder of
    each node, and an anti join with what is known.  ``path`` (edge order along the
    way) gives the order of discovery.  Edges are those that hold and touch a node
    which was expanded.
    """
    if as_of is not None:
        edges = active_asof(edges, as_of)
    if relations:
        edges = edges.filter(F.col("relation_type").isin(relations))
    steps = _steps(edges, direction)
    own = nodes.select("tenant_id", F.col("id").alias("root_id"))
    none = F.lit(None).cast("string")
    frontier = roots.select("tenant_id", "root_id").distinct().join(own, ["tenant_id", "root_id"], "left_semi")
    # written, so that its size is known where it meets the edges
    frontier = materialize(frontier.select("tenant_id", "root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth"), none.alias("edge_id"), F.lit("DOWNSTREAM").alias("dir"),
                                           F.array().cast("array<bigint>").alias("path")))
    seen = frontier
    walked = None
    exists = nodes.select("tenant_id", F.col("id").alias("node_id"))
    for depth in range(1, max_depth + 1):
        hop = frontier.select("tenant_id", "root_id", F.col("node_id").alias("at"), "path").join(steps, ["tenant_id", "at"])
        used = hop.select("tenant_id", "root_id", "edge_id").distinct()
        walked = used if walked is None else walked.unionByName(used)
        order = F.concat("path", F.array(F.col("dir_no").cast("bigint"), F.col("edge_seq").cast("bigint")))
        found = hop.withColumn("order", order).groupBy("tenant_id", "root_id", F.col("next").alias("node_id")).agg(F.min(F.struct("order", "edge_id", "dir")).alias("f"))
        found = materialize(found.join(seen.select("tenant_id", "root_id", "node_id"), ["tenant_id", "root_id", "node_id"], "left_anti"))
        found = found.join(_exist(found.select("tenant_id", "node_id"), exists), ["tenant_id", "node_id"], "left_semi")
        frontier = materialize(found.select("tenant_id", "root_id", "node_id", F.lit(depth).alias("depth"), "f.edge_id", "f.dir", F.col("f.order").alias("path")))
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    edges_seen = walked.distinct() if walked is not None else seen.select("tenant_id", "root_id", "edge_id").limit(0)
    return seen, edges_seen


def neighborhood(roots: DataFrame, nodes: DataFrame, edges: DataFrame, as_of=None) -> DataFrame:
    """Node ids within two hops either way; a root that is no node has itself only."""
    reached, _ = traverse(roots, nodes, edges, "BOTH", 2, as_of)
    return reached.select("tenant_id", "root_id", "node_id").unionByName(roots.select("tenant_id", "root_id", F.col("root_id").alias("node_id"))).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tenant_id, kind, value, n``: nodes in all, by category and by type, and edges."""
    sets = nodes.groupingSets([("tenant_id", "category"), ("tenant_id", "entity_type"), ("tenant_id",)], "tenant_id", "category", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("category").alias("gc"), F.grouping("entity_type").alias("gt"))
    kind = F.when(F.col("gc") == 0, "category").when(F.col("gt") == 0, "entity_type").otherwise("nodes")
    rows = sets.select("tenant_id", kind.alias("kind"), F.when(F.col("gc") == 0, F.col("category")).when(F.col("gt") == 0, F.col("entity_type")).alias("value"), "n")
    count = edges.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select("tenant_id", F.lit("edges").alias("kind"), F.lit(None).cast("string").alias("value"), "n")
    return rows.unionByName(count)


def dossier_members(roots: DataFrame, nodes: DataFrame, edges: DataFrame, as_of=None) -> DataFrame:
    """``tenant_id, root_id, node_id, name, entity_type, canonical_id, depth, bucket, at``: what surrounds each root, one row a node.

    ``bucket`` names the dossier's list (null for none) and ``at`` orders it by discovery.  However many
    nodes a hub leads to, they stay rows; ``dossier`` makes lists of them.
    """
    reached, _ = traverse(roots, nodes, edges, "BOTH", 3, as_of)
    known = nodes.select("tenant_id", F.col("id").alias("node_id"), "entity_type", "name", "canonical_id")
    around = reached.filter("node_id <> root_id").join(known, ["tenant_id", "node_id"])
    place = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return around.select("tenant_id", "root_id", "node_id", "name", "entity_type", "canonical_id", "depth", F.try_element_at(place, F.col("entity_type")).alias("bucket"), F.struct("depth", "path", "node_id").alias("at"))


def dossier(roots: DataFrame, nodes: DataFrame, edges: DataFrame, as_of=None) -> DataFrame:
    """The surroundings of each root within three hops either way: name lists by kind, the last plant, line, cell and station found, and a sentence."""
    known = nodes.select("tenant_id", F.col("id").alias("node_id"), "entity_type", "name", "canonical_id")
    around = dossier_members(roots, nodes, edges, as_of)
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.struct("at", "name")))), lambda x: x["name"]).alias(b) for b in dict.fromkeys(BUCKETS.values())]
    slots = [F.max_by(F.when(F.col("entity_type") == s, F.col("name")), F.when(F.col("entity_type") == s, F.col("at"))).alias(s.lower()) for s in SLOTS]
    found = around.groupBy("tenant_id", "root_id").agg(*lists, *slots)
    own = roots.select("tenant_id", "root_id").distinct().join(known.withColumnRenamed("node_id", "root_id"), ["tenant_id", "root_id"])
    out = own.join(found, ["tenant_id", "root_id"], "left")
    for b in dict.fromkeys(BUCKETS.values()):
        out = out.withColumn(b, F.coalesce(b, F.array().cast("array<string>")))
    # The wording of the sentence.
    sentence = F.format_string("%s (%s) located at %s // %s. Configured with %d active sensors, executing %d work orders, with %d logged maintenance events.",
                               "name", "entity_type", F.coalesce("plant", F.lit("Main Facility")), F.coalesce("line", F.lit("Unassigned Line")), F.size("sensors"), F.size("work_orders"), F.size("maintenance_orders"))
    return out.withColumn("summary", sentence)


def connected_names(dossiers: DataFrame) -> DataFrame:
    """A root's own name with its sensors, work orders and maintenance orders as one list."""
    return dossiers.select("tenant_id", "root_id", F.concat(F.array("name"), "sensors", "work_orders", "maintenance_orders").alias("connected"))


def dossier_counts(roots: DataFrame, nodes: DataFrame, edges: DataFrame, as_of=None) -> DataFrame:
    """``tenant_id, root_id``, the last plant found and ``n_<list>`` for each of the dossier's lists, summed from rows; no list is built."""
    around = dossier_members(roots, nodes, edges, as_of)
    plant = F.col("entity_type") == "Plant"
    counts = [F.count(F.when(F.col("bucket") == b, 1)).alias(f"n_{b}") for b in dict.fromkeys(BUCKETS.values())]
    found = around.groupBy("tenant_id", "root_id").agg(*counts, F.max_by(F.when(plant, F.col("name")), F.when(plant, F.col("at"))).alias("plant"))
    own = roots.select("tenant_id", "root_id").distinct().join(nodes.select("tenant_id", F.col("id").alias("root_id")), ["tenant_id", "root_id"], "left_semi")
    return own.join(found, ["tenant_id", "root_id"], "left").na.fill(0, [f"n_{b}" for b in dict.fromkeys(BUCKETS.values())])


CONNECTED = ("sensors", "work_orders", "maintenance_orders")


def connected_counts(roots: DataFrame, nodes: DataFrame, edges: DataFrame, as_of=None) -> DataFrame:
    """``tenant_id, root_id, name, n``: the size of each root's list of ``connected_names`` without the list.

    What lies within three hops of a root is what lies within two hops of its neighbours.  Many roots share a
    neighbour, so that one's members are found once for all of them.  A root takes the count of
    its neighbour with most members, and meets only the members of its others one by one, to add those that the
    first one lacks.
    """
    live = edges if as_of is None else active_asof(edges, as_of)
    known = nodes.select("tenant_id", F.col("id").alias("root_id"), "name", "entity_type")
    asked = materialize(roots.select("tenant_id", "root_id").distinct().join(known, ["tenant_id", "root_id"]))
    steps = _steps(live, "BOTH").select("tenant_id", F.col("at").alias("root_id"), F.col("next").alias("hub")).distinct()
    near = steps.join(asked.select("tenant_id", "root_id"), ["tenant_id", "root_id"], "left_semi").join(nodes.select("tenant_id", F.col("id").alias("hub")), ["tenant_id", "hub"], "left_semi")
    near = materialize(near)
    reached, _ = traverse(near.select("tenant_id", F.col("hub").alias("root_id")), nodes, live, "BOTH", 2)
    kinds = [k for k, b in BUCKETS.items() if b in CONNECTED]
    counted = nodes.filter(F.col("entity_type").isin(kinds)).select("tenant_id", F.col("id").alias("node_id"))
    members = materialize(reached.select("tenant_id", F.col("root_id").alias("hub"), "node_id").join(counted, ["tenant_id", "node_id"], "left_semi"))
    sizes = members.groupBy("tenant_id", "hub").agg(F.count(F.lit(1)).alias("size"))
    sized = near.join(sizes, ["tenant_id", "hub"])  # hubs without members add nothing
    base = materialize(sized.groupBy("tenant_id", "root_id").agg(F.max_by(F.struct("hub", "size"), F.struct("size", "hub")).alias("b")).select("tenant_id", "root_id", F.col("b.hub").alias("base"), "b.size"))
    others = sized.join(base.select("tenant_id", "root_id", "base"), ["tenant_id", "root_id"]).filter("hub <> base").join(members, ["tenant_id", "hub"]).filter("node_id <> root_id")
    others = others.select("tenant_id", "root_id", "base", "node_id").distinct()
    extra = others.join(members.withColumnRenamed("hub", "base"), ["tenant_id", "base", "node_id"], "left_anti").groupBy("tenant_id", "root_id").agg(F.count(F.lit(1)).alias("extra"))
    # a root is a member of each of its neighbours, if its kind counts
    own = F.when(F.col("entity_type").isin(kinds), 1).otherwise(0)
    out = asked.join(base, ["tenant_id", "root_id"], "left").join(extra, ["tenant_id", "root_id"], "left")
    n = F.coalesce(F.col("size") - own, F.lit(0)) + F.coalesce("extra", F.lit(0)) + 1
    return out.select("tenant_id", "root_id", "name", n.cast("long").alias("n"))
