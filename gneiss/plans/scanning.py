"""A scan of a repository from its files to a checked, saved snapshot."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import graph, incremental
from gneiss.plans.lineage import Lineage
from gneiss.sources import files, snapshots


def scan(spark: SparkSession, root: str, store: str, analyse, analyzer: str = "1") -> dict:
    """Scan ``root``, analyse what changed, merge it into the last snapshot of ``store``, check the graph and save.

    ``analyse(files, projects)`` gives ``(projects, entities, relations)`` of the projects named, or of all for None. The
    result says how: mode, counts, seconds and the reason of a full scan. An unsound graph is not saved.
    """
    began, keep = time.perf_counter(), Lineage(spark, "scan")
    at = snapshots.latest(store)
    status, before = snapshots.load(spark, at) if at else ("NotFound", {})
    now = keep.cut(files.scan(spark, root))
    info = files.git_info(root)
    reason = None if status == "Loaded" else f"no usable snapshot: {status}"
    if reason is None:
        changes = keep.cut(incremental.diff(before["files"], now))
        owners = before["projects"].select(files.directory(F.col("relative_path")).alias("prefix"), F.col("id").alias("owner"))
        full = incremental.full_reason(changes, owners).first()
        reason = full and f"{full.reason}: {full.path}"
    if reason is not None:
        tables = dict(zip(("projects", "entities", "relations"), analyse(now, None)))
        n_changes = None
    else:
        n_changes = changes.count()
        path = F.coalesce("current_path", "previous_path")
        touched = graph.longest_prefix_owner(changes.withColumn("path", path), owners).where("owner is not null").select(F.col("owner").alias("project")).distinct()
        edges = before["relations"].where("relation_type = 'ReferencesProject'").select("source_id", "target_id")
        plan = keep.cut(incremental.affected(touched, edges, edges, before["projects"].select(F.col("id").alias("project"))))
        made = dict(zip(("projects", "entities", "relations"), analyse(now, plan.where("analyze").select("project"))))
        stale = plan.select(F.col("project").alias("project_id"))
        tables = {
            "projects": _replace(before["projects"], made["projects"], stale.select(F.col("project_id").alias("id")), "id"),
            "entities": _replace(before["entities"], made["entities"], stale, "project_id"),
        }
        known = tables["entities"].select("id").unionByName(tables["projects"].select("id"))
        old = before["relations"].join(before["entities"].join(stale, "project_id", "left_semi").select(F.col("id").alias("source_id")), "source_id", "left_anti")
        old = old.join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*before["relations"].columns)
        tables["relations"] = graph.dedup_edges(old.unionByName(made["relations"].select(*old.columns)))
    tables = {n: keep.cut(df) for n, df in tables.items()}
    graph.checked(tables["entities"].select("id").unionByName(tables["projects"].select("id")), tables["relations"])
    path = snapshots.save(store, {"files": now, **tables}, {"branch": info["branch"], "commit": info["head_commit"], "analyzerVersion": analyzer})
    return {"path": path, "full": reason is not None, "reason": reason, "changes": n_changes, "files": now.count(), "entities": tables["entities"].count(), "seconds": time.perf_counter() - began}


def _replace(old: DataFrame, new: DataFrame, stale: DataFrame, column: str) -> DataFrame:
    """Old rows outside of the stale projects, and the new ones."""
    return old.join(stale.distinct(), column, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
