"""Projects and entities: references, membership, containment, base types and the fields that retrieval indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import graph
from gneiss.operators.relational import first_per_key
from gneiss.sources.files import stem

EDGE = ["source_id", "target_id", "relation_type", "path", "start_line", "end_line", "resolution"]


def dependency_graph(files: DataFrame, read: DataFrame, previous: DataFrame) -> DataFrame:
    """``(path, name, references)`` of each project file of ``files(relative_path)``.

    References are those that were ``read(path, references)``, else the previous ones, else none; distinct and sorted.
    The name is the ``previous(path, name, references)`` one, else the file's stem.
    """
    p = previous.select("path", F.col("name").alias("_name"), F.col("references").alias("_before"))
    rows = files.select(F.col("relative_path").alias("path")).distinct().join(read.select("path", F.col("references").alias("_now")), "path", "left").join(p, "path", "left")
    none = F.array().cast("array<string>")
    return rows.select("path", F.coalesce("_name", stem(F.col("path"))).alias("name"), F.array_sort(F.array_distinct(F.coalesce("_now", "_before", none))).alias("references"))


def reference_edges(references: DataFrame, projects: DataFrame) -> DataFrame:
    """Edges of ``references(path, target_path, line, evaluated)`` between ``projects(id, path)``; unknown targets are skipped.

    Exact if the project was evaluated, else syntactic; paths of targets match whatever their case, each pair gives one edge.
    """
    source = projects.select(F.col("id").alias("source_id"), F.col("path"))
    target = projects.select(F.col("id").alias("target_id"), F.lower("path").alias("_t"))
    rows = references.join(source, "path").join(target, F.lower("target_path") == F.col("_t"))
    edges = rows.select(
        "source_id", "target_id", F.lit("ReferencesProject").alias("relation_type"), "path", F.coalesce("line", F.lit(1)).alias("start_line"), F.coalesce("line", F.lit(1)).alias("end_line"),
        F.when(F.col("evaluated"), "Exact").otherwise("Syntactic").alias("resolution"),
    )
    return graph.dedup_edges(edges)


def solution_edges(membership: DataFrame, solutions: DataFrame, projects: DataFrame) -> DataFrame:
    """Edges from ``solutions(id, path)`` to the ``projects(id, path)`` that ``membership(solution_path, project_path)`` names."""
    s, p = solutions.select(F.col("id").alias("source_id"), F.col("path").alias("solution_path")), projects.select(F.col("id").alias("target_id"), F.col("path").alias("project_path"))
    one = F.lit(1)
    return membership.join(s, "solution_path").join(p, "project_path").select(
        "source_id", "target_id", F.lit("Contains").alias("relation_type"), F.col("solution_path").alias("path"), one.alias("start_line"), one.alias("end_line"), F.lit("Exact").alias("resolution")
    )


def containment_edges(declared: DataFrame, projects: DataFrame) -> DataFrame:
    """``Contains`` edges of ``declared(id, full_name, project_id, path, start_line, end_line, resolution)``: from the nearest declared ancestor, else the project.

    An ancestor is the longest proper beginning of the full name that is declared in the same project; beginnings
    are spread, which makes it an equi-join. What is its own source, or has none, has no edge.
    """
    parts = F.split("full_name", r"\.")
    near = declared.withColumn("_n", F.explode_outer(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)))).withColumn("_begin", F.array_join(F.slice(parts, 1, F.coalesce("_n", F.lit(0))), "."))
    known = declared.groupBy("project_id", F.col("full_name").alias("_begin")).agg(F.min("id").alias("_parent"))
    up = near.join(known, ["project_id", "_begin"]).where("_parent <> id").groupBy("id", "path", "start_line").agg(F.max_by("_parent", "_n").alias("_parent"))
    p = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_known"))
    rows = declared.join(up, ["id", "path", "start_line"], "left").join(p, "project_id", "left")
    source = F.coalesce("_parent", F.when(F.col("_known"), F.col("project_id")))
    edges = rows.select(source.alias("source_id"), F.col("id").alias("target_id"), F.lit("Contains").alias("relation_type"), "path", "start_line", "end_line", "resolution")
    return graph.dedup_edges(edges.where("source_id is not null and source_id <> target_id"), by_resolution=False)


def base_targets(bases: DataFrame, entities: DataFrame, assemblies: DataFrame, reusable: DataFrame) -> DataFrame:
    """``bases(source_id, project_id, symbol, assembly)`` with ``target_id``: same project, else the one project of the assembly, else a reusable entity; null if none.

    ``entities(id, project_id, symbol)``, ``assemblies(assembly, project_id)``, ``reusable(id, project_id, symbol)``.
    """
    own = entities.groupBy("project_id", "symbol").agg(F.min("id").alias("_own"))
    owner = assemblies.groupBy("assembly").agg(F.count_distinct("project_id").alias("_n"), F.min("project_id").alias("_home")).where("_n = 1").drop("_n")
    there = own.withColumnsRenamed({"project_id": "_home", "_own": "_there"})
    again = reusable.groupBy(F.col("project_id").alias("_home"), "symbol").agg(F.min("id").alias("_again"))
    rows = bases.join(own, ["project_id", "symbol"], "left").join(owner, "assembly", "left").join(there, ["_home", "symbol"], "left").join(again, ["_home", "symbol"], "left")
    return rows.select("source_id", "project_id", "symbol", "assembly", F.coalesce("_own", "_there", "_again").alias("target_id"))


def retrieval_fields(components: DataFrame, entities: DataFrame, projects: DataFrame, contains: DataFrame, relations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``(id, field, text)`` that :func:`retrieval.postings` indexes, of every component.

    Name, path, the project's name and file stem, the names of members, the full names at the other end of type relations,
    and the nearest namespace of ``namespaces(id, ancestor)``. What is missing gives no row.
    """
    row = lambda df, field, text: df.select("id", F.lit(field).alias("field"), text.alias("text"))
    named = entities.select(F.col("id").alias("_other"), F.col("name").alias("_name"), F.col("full_name").alias("_full"))
    project = projects.select(F.col("id").alias("project_id"), F.concat_ws(" ", "name", stem(F.col("relative_path"))).alias("_project"))
    mine = components.select("id")
    members = contains.select(F.col("source_id").alias("id"), F.col("target_id").alias("_other")).join(mine, "id", "left_semi").join(named, "_other")
    typed = relations.where(F.col("relation_type").isin("Implements", "Inherits"))
    ends = typed.select(F.col("source_id").alias("id"), F.col("target_id").alias("_other")).unionByName(typed.select(F.col("target_id").alias("id"), F.col("source_id").alias("_other")))
    related = ends.join(mine, "id", "left_semi").join(named, "_other")
    spaces = namespaces.where("ancestor is not null").select("id", F.col("ancestor").alias("_other")).join(mine, "id", "left_semi").join(named, "_other")
    parts = [
        row(components, "name", F.col("name")), row(components, "path", F.col("path")), row(components.join(project, "project_id"), "project", F.col("_project")),
        row(members, "member", F.col("_name")), row(related, "related", F.col("_full")), row(spaces, "namespace", F.col("_full")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidate_notes(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """``(query_id, rank, path, content)``: the first note, in the manifest's order, of each candidate's source; candidates without one go."""
    first = first_per_key(notes.where("source_id is not null"), ["source_id"], [F.col("ordinal")])
    return candidates.join(first, candidates.id == first.source_id).select("query_id", "rank", "path", "content")
