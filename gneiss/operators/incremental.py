"""Changes between two scans, and what they affect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import graph
from gneiss.sources.files import extension, file_name

#: Files whose change affects every project.
GLOBAL = ["directory.build.props", "directory.build.targets", "directory.build.rsp", "directory.packages.props", "global.json", "nuget.config"]
KINDS = ["Added", "Modified", "Deleted", "Renamed"]


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(kind, current_path, previous_path, method)`` of files that differ.

    Hashes decide where both sides have one, else size and time of change.
    """
    p = previous.select(F.col("relative_path").alias("path"), *[F.col(c).alias("p_" + c) for c in ("content_hash", "size_bytes", "last_write_utc")], F.lit(True).alias("in_p"))
    c = current.select(F.col("relative_path").alias("path"), *[F.col(c).alias("c_" + c) for c in ("content_hash", "size_bytes", "last_write_utc")], F.lit(True).alias("in_c"))
    both = p.join(c, "path", "full")
    hashed = F.col("p_content_hash").isNotNull() & F.col("c_content_hash").isNotNull()
    same = F.when(hashed, F.col("p_content_hash") == F.col("c_content_hash")).otherwise(
        F.col("p_size_bytes").eqNullSafe(F.col("c_size_bytes")) & F.col("p_last_write_utc").eqNullSafe(F.col("c_last_write_utc"))
    )
    kind = F.when(F.col("in_p").isNull(), "Added").when(F.col("in_c").isNull(), "Deleted").when(~same, "Modified")
    method = F.when(kind == "Modified", F.when(hashed, "ContentHash").otherwise("FileMetadata")).otherwise("Presence")
    return both.select(
        kind.alias("kind"), F.when(F.col("in_c"), F.col("path")).alias("current_path"), F.when(F.col("in_p"), F.col("path")).alias("previous_path"), method.alias("method")
    ).where("kind is not null")


def with_renames(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """Deletions and additions that a reported rename joins become one change; others stay."""
    gone = changes.where("kind = 'Deleted'").select("previous_path")
    new = changes.where("kind = 'Added'").select("current_path")
    proven = renames.select("previous_path", "current_path").distinct().join(gone, "previous_path", "left_semi").join(new, "current_path", "left_semi").select("previous_path", "current_path")
    rest = changes.join(proven.select("previous_path"), (changes.previous_path == proven.previous_path) & (changes.kind == "Deleted"), "left_anti")
    rest = rest.join(proven.select("current_path"), (rest.current_path == proven.current_path) & (rest.kind == "Added"), "left_anti")
    return rest.unionByName(proven.select(F.lit("Renamed").alias("kind"), "current_path", "previous_path", F.lit("Reported").alias("method")))


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.coalesce("current_path", "previous_path"), graph.ordinal(F.col("kind"), KINDS))


def full_reason(changes: DataFrame, owners: DataFrame) -> DataFrame:
    """The first change, in path order, that forces all projects to be analysed: ``(path, reason)`` or no row."""
    path = F.coalesce("current_path", "previous_path")
    mapped = changes.withColumn("path", path)
    owned = graph.longest_prefix_owner(mapped, owners)
    mapped = mapped.join(owned, "path", "left")
    reason = (
        F.when(F.lower(file_name(F.col("path"))).isin(GLOBAL), "global configuration")
        .when(extension(F.col("path")) == ".sln", "solution")
        .when((extension(F.col("path")) == ".cs") & F.col("owner").isNull(), "unmapped source")
    )
    return mapped.withColumn("reason", reason).where("reason is not null").select("path", "reason").orderBy("path", graph.ordinal(F.col("reason"), ["global configuration"])).limit(1)


def affected(direct: DataFrame, current_edges: DataFrame, previous_edges: DataFrame, current: DataFrame) -> DataFrame:
    """``(project, is_direct, analyze)``: projects touched and all that depend on them, now or before.

    ``direct(project)``; edges point from a project to what it references. ``analyze`` says
    that the project still exists.
    """
    seeds = direct.select(F.lit(0).alias("all"), F.col("project").alias("seed")).drop("all").distinct()
    reached = [graph.dependents(e, seeds).select(F.col("node").alias("project")) for e in (current_edges, previous_edges)]
    every = reached[0].unionByName(reached[1]).distinct()
    d = direct.select("project").distinct().withColumn("is_direct", F.lit(True))
    now = current.select("project").distinct().withColumn("analyze", F.lit(True))
    out = every.join(d, "project", "left").join(now, "project", "left")
    return out.select("project", F.coalesce("is_direct", F.lit(False)).alias("is_direct"), F.coalesce("analyze", F.lit(False)).alias("analyze"))


def reused(current: DataFrame, plan: DataFrame) -> DataFrame:
    """Projects whose previous results stay as they are."""
    return current.select("project").distinct().join(plan.where("analyze").select("project"), "project", "left_anti")


def mode(detected: int, semantic: int, warning: bool = False) -> str:
    """Full, Partial or Fallback from how many projects have a semantic model."""
    if detected and semantic == 0:
        return "Fallback"
    return "Partial" if warning or semantic < detected else "Full"


def rescan_reason(status: str, repository: tuple, branch: tuple, analyzer: tuple) -> str | None:
    """Why a snapshot cannot be built on: pairs are (previous, current). None if it can."""
    if status != "Loaded":
        return f"no usable snapshot: {status}"
    for name, (old, new) in (("repository", repository), ("branch", branch), ("analyzer version", analyzer)):
        if old != new:
            return f"{name} changed"
    return None
