"""Graphs: integrity, dedup, merge, reachability, containment and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.functions.text import tokens
from gneiss.operators.relational import duplicates, first_per_key
from gneiss.plans.lineage import Lineage

#: Enumerations in the order that sorts them.
RESOLUTION = ["Exact", "Semantic", "Syntactic", "Unresolved"]
RELATION = ["Contains", "References", "ReferencesProject", "Inherits", "Implements", "Calls"]
COMPONENT = ["Class", "Interface", "Record", "Enum"]


def ordinal(column: Column, names: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), column).cast("int"), F.lit(len(names) + 1))


def dedup_edges(edges: DataFrame, by_resolution: bool = True) -> DataFrame:
    """One row per (source, target, type): the best resolved, then least path and line.

    With ``by_resolution`` false the order is path and line alone, as an extractor has it.
    """
    order = [F.col("path"), F.col("start_line")]
    if by_resolution:
        order.insert(0, ordinal(F.col("resolution"), RESOLUTION))
    return first_per_key(edges, ["source_id", "target_id", "relation_type"], order)


def dangling(edges: DataFrame, nodes: DataFrame, ident: str = "id") -> DataFrame:
    """Edges with a missing end, each once."""
    known = nodes.select(F.col(ident).alias("_id"))
    lost = [edges.join(known, edges[c] == known._id, "left_anti") for c in ("source_id", "target_id")]
    return lost[0].unionByName(lost[1]).distinct()


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of repeated ids, repeated edges and dangling edges, and whether all are zero."""
    n = duplicates(nodes, ["id"]).agg(F.count("*").alias("duplicate_ids"))
    e = duplicates(edges, ["source_id", "target_id", "relation_type"]).agg(F.count("*").alias("duplicate_relations"))
    d = dangling(edges.select("source_id", "target_id", "relation_type"), nodes).agg(F.count("*").alias("dangling"))
    return n.crossJoin(e).crossJoin(d).withColumn("is_valid", (F.col("duplicate_ids") + F.col("duplicate_relations") + F.col("dangling")) == 0)


def checked(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise unless the graph is sound."""
    row = integrity(nodes, edges).first()
    if not row.is_valid:
        raise ValueError(f"graph is not sound: {row.asDict()}")


def merge(previous: DataFrame, regenerated: DataFrame, invalidated: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Previous rows outside of the invalidated partitions, overwritten by regenerated ones of the same key."""
    kept = previous.join(invalidated.select(partition).distinct(), partition, "left_anti").select(*previous.columns)
    kept = kept.join(regenerated.select(*keys).distinct(), keys, "left_anti").select(*previous.columns)
    return kept.unionByName(regenerated.select(*previous.columns))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, node)``: every node reachable along ``edges(source_id, target_id)`` from ``seeds(seed)``, seeds included.

    Breadth first with the visited pairs taken out of each frontier, so cycles end.
    Each round's frontier is a table in the shared folder; the loop ends when one is empty.
    """
    keep = Lineage(edges.sparkSession, "reach")
    step = keep.cut(edges.select("source_id", "target_id").distinct())
    frontier = keep.cut(seeds.select("seed", F.col("seed").alias("node")).distinct())
    visited = frontier
    while True:
        new = frontier.join(step, frontier.node == step.source_id).select("seed", F.col("target_id").alias("node")).distinct()
        frontier = keep.cut(new.join(visited, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What depends on the seeds, directly or not: :func:`reachable` against the arrows."""
    return reachable(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), seeds)


def parents(contains: DataFrame) -> DataFrame:
    """``(child, parent)``: the least containing source of each child."""
    return contains.groupBy(F.col("target_id").alias("child")).agg(F.min("source_id").alias("parent"))


def children(contains: DataFrame) -> DataFrame:
    return contains.groupBy(F.col("source_id").alias("parent")).agg(F.array_sort(F.collect_list("target_id")).alias("children"))


def top_level(nodes: DataFrame, contains: DataFrame, types: list[str]) -> DataFrame:
    """Nodes of the given types whose parent is of none of them."""
    inside = parents(contains).join(nodes.where(F.col("entity_type").isin(types)).select(F.col("id").alias("parent")), "parent", "left_semi")
    return nodes.where(F.col("entity_type").isin(types)).join(inside, nodes.id == inside.child, "left_anti")


def nearest_ancestor(nodes: DataFrame, contains: DataFrame, kind: str) -> DataFrame:
    """``(id, ancestor)``: walking up the parents, the first of type ``kind``; null if there is none.

    Pointers double, so a tree of any depth takes rounds by its logarithm: each node either knows its answer, has nothing
    above, or jumps to where its pointer's pointer leads. A node that a cycle of parents holds has no ancestor of its own kind.
    """
    keep = Lineage(nodes.sparkSession, "ancestors")
    kinds = nodes.select(F.col("id").alias("at"), F.col("entity_type").alias("_kind"))
    walk = parents(contains).select(F.col("child").alias("id"), F.col("parent").alias("at")).join(kinds, "at", "left")
    walk = keep.cut(walk.select("id", F.when(F.coalesce(F.col("_kind") == kind, F.lit(False)), F.col("at")).alias("ancestor"), F.when(F.coalesce(F.col("_kind") != kind, F.lit(True)), F.col("at")).alias("at")))
    n, limit = walk.count(), 1
    while limit < 2 * n:  # in so many steps every path is at its end, unless it goes round
        above = walk.select(F.col("id").alias("at"), F.col("ancestor").alias("_a"), F.col("at").alias("_next"))
        if walk.where("ancestor is null and at is not null").isEmpty():
            break
        walk = keep.cut(walk.join(above, "at", "left").select("id", F.coalesce("ancestor", "_a").alias("ancestor"), F.when(F.col("ancestor").isNull() & F.col("_a").isNull(), F.col("_next")).alias("at")))
        limit *= 2
    return nodes.select("id").join(walk.select("id", "ancestor"), "id", "left")


def expand(selected: DataFrame, edges: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """Neighbours of each query's selection over one edge, in either direction.

    ``selected(query_id, id)``; a neighbour must be a candidate and not selected. It is not
    de-duplicated: one that two edges reach takes two of the ``most`` places.
    """
    fan = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), "relation_type").unionByName(
        edges.select(F.col("target_id").alias("from"), F.col("source_id").alias("to"), "relation_type")
    )
    near = selected.join(fan, selected.id == fan["from"]).select("query_id", F.col("to").alias("id"), F.col("from").alias("neighbour"), "relation_type")
    near = near.join(selected, ["query_id", "id"], "left_anti").join(candidates.select("id").distinct(), "id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("id", "neighbour", "relation_type"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "id", "neighbour", "relation_type", "rank")


def inside(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends selected."""
    ids = selected.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def type_relation(source_type: Column, target_type: Column) -> Column:
    """Kind of a base-type edge."""
    return F.when((source_type == "Interface") | (target_type != "Interface"), "Inherits").otherwise("Implements")


def longest_prefix_owner(paths: DataFrame, owners: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """``(path, owner)``: the owner whose folder is the longest prefix of a path, whatever case; null if none.

    Every path is spread over its folders, which makes the prefix join an equi-join.
    """
    spread = paths.select(F.col(path).alias("path")).distinct().select("path", F.explode(_folders("path")).alias("f"))
    known = owners.select(F.lower(F.col(prefix)).alias("folder"), F.col("owner"))
    found = spread.select("path", "f.depth", "f.folder").join(known, "folder").groupBy("path").agg(F.max_by("owner", F.struct("depth", "owner")).alias("owner"))
    return paths.select(F.col(path).alias("path")).distinct().join(found, "path", "left")


def _folders(path: str) -> Column:
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.lower(F.array_join(F.slice(parts, 1, i), "/")).alias("folder")))


def evidence_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Text lines that state the selected part of a graph."""
    n = nodes.select(F.format_string("entity %s %s %s:%d-%d", "id", "entity_type", "path", "start_line", "end_line").alias("line"))
    e = edges.select(F.format_string("relation %s %s %s", "source_id", "relation_type", "target_id").alias("line"))
    return n.unionByName(e)


def name_tokens(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", tokens(F.col("name")).alias("tokens"))


def ordered_relations(edges: DataFrame) -> DataFrame:
    """Edges by source, ordinal of their type, and target."""
    return edges.orderBy("source_id", ordinal(F.col("relation_type"), RELATION), "target_id")
