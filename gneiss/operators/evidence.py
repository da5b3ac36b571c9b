"""Evidence references against a snapshot, and what recommendations need of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = ["Class", "Interface", "Record", "Enum"]


def _optional(expected: Column, actual: Column) -> Column:
    return expected.isNull() | F.coalesce(expected == actual, F.lit(False))


def _same_path(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def _located(path: Column | None, start: Column, end: Column) -> Column:
    """Whether the entity's own or an additional location fits; a null path means any location of the entity."""

    def fits(p, s, e):
        place = F.lit(True) if path is None else _same_path(p, path)
        return place & _optional(start, s) & _optional(end, e)

    more = F.coalesce("n_locations", F.array().cast("array<struct<path:string,start_line:int,end_line:int>>"))
    return fits(F.col("n_path"), F.col("n_start_line"), F.col("n_end_line")) | F.exists(more, lambda x: fits(x.path, x.start_line, x.end_line))


def validate(evidence: DataFrame, entities: DataFrame, projects: DataFrame, relations: DataFrame, repository_id: str, branch: str) -> DataFrame:
    """``evidence`` with ``is_valid``: whether each reference matches the snapshot.

    Keys are equi-joined and optional fields that are null match anything; paths are compared whatever
    their case, and an additional location counts like the first. A wrong repository or branch is
    never valid. ``evidence`` needs a unique ``evidence_id``.
    """
    n = entities.select(
        F.col("id").alias("entity_id"), F.col("project_id").alias("n_project"), F.col("entity_type").alias("n_type"), F.col("path").alias("n_path"), F.col("start_line").alias("n_start_line"),
        F.col("end_line").alias("n_end_line"), F.col("resolution").alias("n_resolution"), F.col("additional_locations").alias("n_locations"), F.lit(True).alias("n_found"),
    )
    p = projects.select(F.col("id").alias("project_id"), F.col("relative_path").alias("p_path"), F.lit(True).alias("p_found"))
    e = evidence.join(n, "entity_id", "left").join(p, "project_id", "left")
    keys = ["source_entity_id", "target_entity_id", "relation_type"]
    r = relations.select(F.col("source_id").alias(keys[0]), F.col("target_id").alias(keys[1]), "relation_type", F.col("path").alias("r_path"), F.col("start_line").alias("r_s"), F.col("end_line").alias("r_e"), F.col("resolution").alias("r_resolution"))
    ok = (F.col("relative_path").isNull() | _same_path(F.col("r_path"), F.col("relative_path"))) & _optional(F.col("start_line"), F.col("r_s"))
    ok &= _optional(F.col("end_line"), F.col("r_e")) & _optional(F.col("resolution"), F.col("r_resolution"))
    hits = evidence.where("kind = 'Relation'").join(r, keys).where(ok).select("evidence_id").distinct().withColumn("r_found", F.lit(True))
    e = e.join(hits, "evidence_id", "left")
    has_path = F.col("relative_path").isNotNull()
    lines = (F.col("start_line").isNull() & F.col("end_line").isNull()) | _located(None, F.col("start_line"), F.col("end_line"))
    any_path = _located(F.col("relative_path"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    entity = F.col("n_found") & _optional(F.col("project_id"), F.col("n_project")) & (~has_path | any_path) & lines & _optional(F.col("resolution"), F.col("n_resolution"))
    project = F.col("p_found") & (~has_path | _same_path(F.col("p_path"), F.col("relative_path")))
    source = F.col("n_found") & has_path & _located(F.col("relative_path"), F.col("start_line"), F.col("end_line"))
    valid = F.when(F.col("kind") == "Entity", entity).when(F.col("kind") == "Project", project).when(F.col("kind") == "Relation", F.col("r_found")).when(F.col("kind") == "SourceLocation", source)
    here = (F.col("repository_id") == repository_id) & (F.col("branch") == branch)
    out = e.withColumn("is_valid", F.coalesce(here & valid, F.lit(False)))
    out = out.withColumn("entity_found", F.coalesce("n_found", F.lit(False))).withColumn("project_found", F.coalesce("p_found", F.lit(False)))
    out = out.withColumn("path_matches", F.coalesce(F.col("n_found") & has_path & any_path, F.lit(False))).withColumn("is_component", F.coalesce(F.col("n_type").isin(COMPONENTS), F.lit(False)))
    return out.select(*evidence.columns, "is_valid", "entity_found", "project_found", "path_matches", "is_component")


def recommendation_status(recommendations: DataFrame, validated: DataFrame) -> DataFrame:
    """``recommendations(recommendation_id, decision, epistemic_status)`` with ``status``.

    Reuse needs a valid entity and project; Extend also a matching path; AvoidModifying a valid component;
    Create must be a proposal. Any invalid reference keeps a recommendation from being validated.
    """
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    v = F.col("is_valid")
    facts = validated.groupBy("recommendation_id").agg(
        F.count_if(v).alias("n_valid"), F.count_if(~v).alias("n_invalid"), yes(v & F.col("entity_found")).alias("entity"), yes(v & F.col("project_found")).alias("project"),
        yes(v & F.col("path_matches")).alias("path"), yes(v & F.col("is_component")).alias("component"),
    )
    r = recommendations.join(facts, "recommendation_id", "left").fillna(0, ["n_valid", "n_invalid"]).fillna(False, ["entity", "project", "path", "component"])
    d = F.col("decision")
    proposal = F.col("epistemic_status") == "Proposal"
    needed = F.when(d == "Create", proposal).when(d == "Reuse", F.col("entity") & F.col("project")).when(d == "Extend", F.col("path") & F.col("project")).when(d == "AvoidModifying", F.col("component"))
    sound = F.coalesce(needed, F.lit(False)) & (F.col("n_invalid") == 0)
    status = F.when(sound & (d == "Create"), "Proposal").when(sound, "Validated").when(F.col("n_valid") > 0, "PartiallyValidated").otherwise("Invalid")
    return r.select(*recommendations.columns, "n_valid", "n_invalid", status.alias("status"))
