"""Reviewed concepts: validation, resolution, qualification and reranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import tokens
from gneiss.operators.relational import bounded_points, first_per_key

POINTS_PER_TOKEN, MOST = 2, 6
CONCEPT_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"


def is_source_reference(value: Column) -> Column:
    """Relative, with ``/`` between segments that are neither empty nor dots, and perhaps a line above 0."""
    path = F.regexp_replace(value, ":[0-9]+$", "")
    line = F.regexp_extract(value, ":([0-9]+)$", 1)
    parts = F.split(path, "/")
    sound = F.forall(parts, lambda p: ~p.isin("", ".", "..")) & ~F.contains(value, F.lit("\\")) & ~path.rlike("^[A-Za-z]:")
    return F.coalesce(sound & ((line == "") | ~line.rlike("^0*$")), F.lit(False))


def is_relative(value: Column) -> Column:
    """Not blank, not rooted, no absolute URI and no way up."""
    rooted = value.rlike(r"^([/\\]|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*:)")
    up = F.exists(F.split(F.replace(value, F.lit("\\"), F.lit("/")), "/"), lambda p: p == "..")
    return F.coalesce((F.trim(value) != "") & ~rooted & ~up, F.lit(False))


def violations(declarations: DataFrame, known: DataFrame) -> DataFrame:
    """``(concept_id, entity_id, code)``: what is wrong with declarations and their assignments.

    RC200 malformed id, RC201 no definition, RC202 repeated id, RC203 an anchor or qualification token that is
    no token of the id, RC204 a clear anchor policy without anchor or qualification, RC205 no assignment;
    RC300 malformed source reference, RC301 repeated assignment, RC302 blank fingerprint;
    RC400 entity unknown, RC401 other reference, RC402 other fingerprint.
    """
    own = tokens(F.col("concept_id"))
    anchors = F.flatten("anchor_tokens")
    alien = F.size(F.array_except(F.array_union(F.coalesce(anchors, F.array().cast("array<string>")), F.coalesce("qualification_tokens", F.array().cast("array<string>"))), own)) > 0
    clear = F.col("anchor_policy") == "Clear"
    rules = [
        ("RC200", ~F.coalesce(F.col("concept_id").rlike(CONCEPT_ID), F.lit(False))),
        ("RC201", F.coalesce(F.trim("definition"), F.lit("")) == ""),
        ("RC203", alien),
        ("RC204", clear & ((F.coalesce(F.size("anchor_tokens"), F.lit(0)) < 1) | (F.coalesce(F.size("qualification_tokens"), F.lit(0)) < 1))),
        ("RC205", F.coalesce(F.size("assignments"), F.lit(0)) < 1),
    ]
    codes = F.array_compact(F.array(*[F.when(test, code) for code, test in rules]))
    found = declarations.select("concept_id", F.lit(None).cast("string").alias("entity_id"), F.explode(codes).alias("code"))
    again = declarations.groupBy("concept_id").count().where("count > 1").select("concept_id", F.lit(None).cast("string").alias("entity_id"), F.lit("RC202").alias("code"))
    rows = declarations.select("concept_id", F.explode("assignments").alias("a")).select("concept_id", "a.*")
    per_row = F.array_compact(F.array(F.when(~is_source_reference(F.col("source_reference")), "RC300"), F.when(F.coalesce(F.trim("source_fingerprint"), F.lit("")) == "", "RC302")))
    assigned = rows.select("concept_id", "entity_id", F.explode(per_row).alias("code"))
    twice = rows.groupBy("concept_id", "entity_id").count().where("count > 1").select("concept_id", "entity_id", F.lit("RC301").alias("code"))
    bound = resolve(rows, known).where("code is not null").select("concept_id", "entity_id", "code")
    return found.unionByName(again).unionByName(assigned).unionByName(twice).unionByName(bound)


def resolve(assignments: DataFrame, known: DataFrame) -> DataFrame:
    """Each assignment with its ``code``: null if the entity is known with the same reference and fingerprint."""
    k = known.select(F.col("entity_id"), F.col("source_reference").alias("_ref"), F.col("source_fingerprint").alias("_hash"), F.lit(True).alias("_known"))
    code = F.when(F.col("_known").isNull(), "RC400").when(~F.col("source_reference").eqNullSafe(F.col("_ref")), "RC401").when(~F.col("source_fingerprint").eqNullSafe(F.col("_hash")), "RC402")
    return assignments.join(k, "entity_id", "left").withColumn("code", code).drop("_ref", "_hash", "_known")


def qualification(concept: Column, anchor_policy: Column, anchors: Column, support: Column, terms: Column) -> tuple[Column, Column]:
    """Matched tokens of a concept, and whether they and the anchors suffice."""
    own = tokens(concept)
    matched = F.array_intersect(own, terms)
    n, m = F.size(own), F.size(matched)
    covered = F.when(n == 0, False).when(n <= 2, m == n).when(n == 3, m >= 2).otherwise(m >= 3)
    anchored = F.exists(anchors, lambda g: (F.size(g) > 0) & (F.size(F.array_except(g, terms)) == 0))
    clear = anchored & F.arrays_overlap(support, terms)
    return matched, covered & F.when(anchor_policy == "Clear", F.coalesce(clear, F.lit(False))).otherwise(True)


def concept_points(lexical: DataFrame, profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, id, concept_id, points)`` granted to candidates by their concepts.

    ``profiles(id, concept_id, fingerprint, anchor_policy, anchor_tokens, qualification_tokens)``; of a concept
    that a component has twice, the least fingerprint counts. In the order of concepts,
    two points a matched token, six in all.
    """
    own = first_per_key(profiles, ["id", "concept_id"], [F.col("fingerprint")])
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pairs = lexical.select("query_id", "id").join(own, "id").join(asked, "query_id")
    matched, good = qualification(F.col("concept_id"), F.col("anchor_policy"), F.col("anchor_tokens"), F.col("qualification_tokens"), F.col("terms"))
    pairs = pairs.withColumn("p", F.size(matched) * POINTS_PER_TOKEN).where(good)
    granted = bounded_points(pairs, ["query_id", "id"], [F.col("concept_id")], "p", MOST)
    return granted.where("granted > 0").select("query_id", "id", "concept_id", F.col("granted").cast("int").alias("points"))


def restore_exact(pool: list[tuple[int, int]]) -> list[int]:
    """Order of a pool of (exact tier, lexical rank), best first, after exact identities get their places back.

    An item of a higher tier, or of the same tier above zero, that was lexically before
    another one must not stand behind it; it moves directly in front.
    """
    order = list(range(len(pool)))

    def first_wrong():
        for i, weak in enumerate(order):
            for j in range(i + 1, len(order)):
                (tier, rank), (low, late) = pool[order[j]], pool[weak]
                if rank < late and (tier > low or tier == low > 0):
                    return i, j
        return None

    while wrong := first_wrong():
        order.insert(wrong[0], order.pop(wrong[1]))
    return order


def rerank(lexical: DataFrame, points: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """``(query_id, id, score, rank)``: the pool with concept points, exact identities restored.

    ``lexical(query_id, id, score, exact_tier)``. The restoring is sequential, so each query's pool, which
    retrieval has bounded, is ordered by pandas; all else is joins.
    """
    from pyspark.sql import Window as W

    extra = points.groupBy("query_id", "id").agg(F.sum("points").cast("int").alias("extra"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "full_name", "id"))
    pool = lexical.join(names.select("id", "full_name"), "id").withColumn("lexical_rank", rank).join(extra, ["query_id", "id"], "left")
    pool = pool.withColumn("score", F.col("score") + F.coalesce("extra", F.lit(0))).select("query_id", "id", "full_name", "score", "exact_tier", "lexical_rank")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "full_name", "id"], ascending=[False, True, True]).reset_index(drop=True)
        pdf = pdf.iloc[restore_exact(list(zip(pdf.exact_tier, pdf.lexical_rank)))]
        pdf["rank"] = range(1, len(pdf) + 1)
        return pdf[["query_id", "id", "score", "rank"]].head(most)

    kinds = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(order, f"query_id {kinds['query_id']}, id {kinds['id']}, score int, rank int")


def rebind(assignments: DataFrame, current: DataFrame) -> DataFrame:
    """Assignments with the current reference and fingerprint of the same entity; ``code`` RC400 where it is gone."""
    now = current.select("entity_id", F.col("source_reference").alias("new_reference"), F.col("source_fingerprint").alias("new_fingerprint"))
    out = assignments.join(now, "entity_id", "left")
    return out.withColumn("code", F.when(F.col("new_fingerprint").isNull(), "RC400"))


def remap(assignments: DataFrame, mappings: DataFrame, current: DataFrame) -> DataFrame:
    """Assignments moved to new entities; the mappings must cover just what is missing.

    Raises if the mapped ids are not exactly the missing ones, or if a mapping leads to
    an id that is itself mapped.
    """
    missing = assignments.select("entity_id").distinct().join(current.select("entity_id"), "entity_id", "left_anti")
    old = mappings.select(F.col("old_entity_id").alias("entity_id"))
    uneven = missing.join(old, "entity_id", "left_anti").unionByName(old.join(missing, "entity_id", "left_anti"))
    chained = mappings.join(old, mappings.new_entity_id == old.entity_id, "left_semi")
    if not uneven.isEmpty() or not chained.isEmpty():
        raise ValueError("mappings must cover exactly the missing entities, without chains")
    moved = assignments.join(mappings, assignments.entity_id == mappings.old_entity_id, "left")
    moved = moved.withColumn("entity_id", F.coalesce("new_entity_id", "entity_id")).select(*assignments.columns)
    return rebind(moved, current)


def status(n_declarations: int, n_valid: int, n_diagnostics: int) -> str:
    if n_declarations == 0:
        return "Absent"
    if n_valid == 0:
        return "Invalid"
    return "ValidWithDiagnostics" if n_diagnostics else "Valid"


def evidence_context(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_id, source_reference, source_fingerprint)`` of the component notes whose source is an entity: what assignments are checked against."""
    place = F.concat(F.col("path"), F.when(F.col("start_line") > 0, F.concat(F.lit(":"), F.col("start_line").cast("string"))).otherwise(""))
    n = notes.where("kind = 'Component' and source_id is not null").select(F.col("source_id").alias("entity_id"), "source_fingerprint")
    return n.join(entities.select(F.col("id").alias("entity_id"), place.alias("source_reference")), "entity_id").select("entity_id", "source_reference", "source_fingerprint")


def ordered_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """By scope, concept, entity and code; nulls first."""
    return diagnostics.orderBy(*[F.asc_nulls_first(c) for c in ("scope", "concept_id", "entity_id", "code")])


def promote(assignments: DataFrame, destination: DataFrame) -> DataFrame:
    """Assignments bound to another branch's references and fingerprints; all or nothing.

    Raises if one has no entity there, or if the destination names an entity twice.
    """
    if not destination.groupBy("entity_id").count().where("count > 1").isEmpty():
        raise ValueError("the destination names an entity twice")
    bound = rebind(assignments, destination)
    lost = bound.where("code is not null").count()
    if lost:
        raise ValueError(f"{lost} assignments have no entity on the destination branch")
    return bound.select(*[c for c in assignments.columns if c not in ("source_reference", "source_fingerprint")], F.col("new_reference").alias("source_reference"), F.col("new_fingerprint").alias("source_fingerprint"))
