"""The evaluation harness and the metrics of live runs, for all cases of a suite in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import token_estimate
from gneiss.operators import evaluation, graph, retrieval
from gneiss.operators.context import HARD_LIMIT
from gneiss.operators.relational import first_per_key, ratio

COMPONENT_COLUMNS = ["query_id", "id", "score", "rank"]


def retrieve(queries: DataFrame, components: DataFrame, fields: DataFrame, edges: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """Ranked ``components``, ``projects``, ``expanded`` neighbours and ``relations`` of every query.

    ``queries(query_id, text)``, ``components(id, name, full_name, project_id)``, ``fields(id, field, text)``,
    ``edges(source_id, target_id, relation_type)``, ``projects(id, name, relative_path)``.
    """
    terms = retrieval.query_terms(queries)
    index = retrieval.postings(fields)
    exact = retrieval.exact_matches(queries, components)
    intent = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    plain = intent.where(~retrieval.has_test_intent(F.col("terms"))).select("query_id")
    tests = components.join(projects.where(retrieval.is_test_project(F.col("name"), F.col("relative_path"))).select(F.col("id").alias("project_id"), F.col("name").alias("matched_value")), "project_id").select("id", "matched_value")
    # Only what a query touches can lose points: the pairs are those of the postings, not all of them.
    touched = index.join(terms, "term").select("query_id", "id").unionByName(exact.select("query_id", "id")).distinct()
    penalised = touched.join(plain, "query_id", "left_semi").join(tests, "id")
    scored = retrieval.candidates(retrieval.score(index, terms, components.count(), exact, penalised))
    top = retrieval.top(scored, components)
    best = top.join(components.select("id", "project_id"), "id").groupBy("query_id", "project_id").agg(F.max("score").alias("score"))
    aliases = projects.select(F.col("id").alias("project_id"), F.explode(F.array("name", F.regexp_replace(F.substring_index("relative_path", "/", -1), r"\.[^.]*$", ""))).alias("alias"))
    ranked = retrieval.top_projects(retrieval.score_projects(terms, aliases, best))
    selected = top.select("query_id", "id")
    expanded = graph.expand(selected, edges, components)
    every = selected.unionByName(expanded.select("query_id", "id")).distinct()
    ends = [every.select("query_id", F.col("id").alias(c)) for c in ("source_id", "target_id")]
    relations = edges.join(ends[0], "source_id").join(ends[1], ["query_id", "target_id"]).select("query_id", *[c for c in edges.columns])
    return {"components": top, "projects": ranked, "expanded": expanded, "relations": relations}


def context_metrics(segments: DataFrame, prompts: int, pruned: DataFrame | None = None, limit: int = HARD_LIMIT) -> DataFrame:
    """``(query_id, call2, project_notes, component_notes, pruned, utilisation, violation)`` of ``segments(query_id, kind, tokens)``.

    ``prompts`` are the tokens that the request adds; ``pruned(query_id, path)`` notes that did not fit.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    rows = segments.groupBy("query_id").agg((F.sum("tokens") + prompts).alias("call2"), of("ProjectNote").alias("project_notes"), of("ComponentNote").alias("component_notes"))
    if pruned is not None:
        rows = rows.join(pruned.groupBy("query_id").agg(F.count_distinct("path").alias("pruned")), "query_id", "left").fillna(0, ["pruned"])
    else:
        rows = rows.withColumn("pruned", F.lit(0).cast("long"))
    return rows.select("query_id", "call2", "project_notes", "component_notes", "pruned", (F.col("call2") * 100.0 / limit).alias("utilisation"), (F.col("call2") > limit).alias("violation"))


def golden_analysis(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """``(case_id, decision, epistemic_status, entity_id)``: a recommendation per expected type.

    ``cases(case_id, recommendation_types, evidence_entities)``. All but Create refer to the first entity, in the order of
    the case's list and then of ids, that an expected identity names by id, name or full name, whatever case.
    """
    wanted = cases.select("case_id", F.posexplode("evidence_entities").alias("at", "value")).select("case_id", "at", F.lower("value").alias("key"))
    keys = entities.select("id", F.explode(F.array_distinct(F.array(*[F.lower(F.col(c).cast("string")) for c in ("id", "name", "full_name")]))).alias("key"))
    first = first_per_key(wanted.join(keys, "key"), ["case_id"], [F.col("at"), F.col("id")]).select("case_id", F.col("id").alias("entity_id"))
    rows = cases.select("case_id", F.explode("recommendation_types").alias("decision")).join(first, "case_id", "left")
    create = F.col("decision") == "Create"
    return rows.select("case_id", "decision", F.when(create, "Proposal").otherwise("Fact").alias("epistemic_status"), F.when(~create, F.col("entity_id")).alias("entity_id"))


def evaluate(cases: DataFrame, ranked: DataFrame, expected: DataFrame, projects: DataFrame, expected_projects: DataFrame, recommendations: DataFrame, context: DataFrame) -> DataFrame:
    """One row per case: retrieval, project, recommendation and context metrics, and whether the case ``passed``.

    ``ranked``, ``projects``: (case_id, rank, role, value, is_test) with ``value`` the identity that was met;
    ``expected``, ``expected_projects``: (case_id, value, role); ``recommendations(case_id, decision, status, expected)``
    with one row per recommendation and per expected type without one (null status); ``context`` of :func:`context_metrics`
    by case_id; ``cases(case_id, clarification_expected, clarification_actual)``.
    """

    def missing(ranked, expected, k, name):
        met = ranked.where(F.col("rank") <= k).select("case_id", F.lower("value").alias("v")).distinct()
        want = expected.where("role = 'required'").select("case_id", F.lower("value").alias("v")).distinct()
        return want.join(met, ["case_id", "v"], "left_anti").groupBy("case_id").agg(F.count("*").alias(name))

    entity = evaluation.metrics(cases, ranked, expected)
    project = evaluation.metrics(cases, projects.withColumn("is_test", F.lit(False)), expected_projects, (3,)).select(
        "case_id", F.col("recall_at_3").alias("project_recall_at_3"), F.col("reciprocal_rank").alias("project_reciprocal_rank"), F.col("negative_dominates").alias("_project_dominates")
    )
    is_ = lambda s: F.count_if(F.col("status") == s)
    per = recommendations.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("expected"), F.col("decision"))).alias("types_total"), F.count_distinct(F.when(F.col("expected") & F.col("status").isNotNull(), F.col("decision"))).alias("types_found"),
        is_("Invalid").alias("invalid_evidence"), F.count_if(F.col("status").isNotNull() & ~F.col("expected")).alias("unsupported"),
        ratio(is_("Validated"), F.count_if(F.col("status").isNotNull() & (F.col("decision") != "Create")), 1.0).alias("evidence_rate"),
    )
    rows = cases.join(entity, "case_id").join(project, "case_id")
    for part in (per, missing(ranked, expected, 10, "missing_entities"), missing(projects, expected_projects, 3, "missing_projects")):
        rows = rows.join(part, "case_id", "left")
    rows = rows.fillna(0, ["types_total", "types_found", "invalid_evidence", "unsupported", "missing_entities", "missing_projects"]).fillna(1.0, ["evidence_rate"])
    rows = rows.join(context.select("case_id", "call2", F.col("violation").alias("budget_violation")), "case_id", "left").fillna(False, ["budget_violation"])
    rows = rows.withColumn("negative_dominates", F.col("negative_dominates") | F.col("_project_dominates")).drop("_project_dominates").withColumn("fabricated_accepted", F.lit(0))
    return rows.withColumn("passed", evaluation.passed())


def first_ranks(expected: DataFrame, ranked: DataFrame, names: DataFrame) -> DataFrame:
    """``(case_id, value, rank)`` of every ``expected(case_id, value)``: the first rank of what it names; null if missing."""
    keys = names.select("id", F.explode(F.array_distinct(F.array(*[F.lower(F.col(c).cast("string")) for c in names.columns]))).alias("key"))
    met = ranked.join(keys, "id").groupBy("case_id", "key").agg(F.min("rank").alias("rank"))
    return expected.withColumn("key", F.lower("value")).join(met, ["case_id", "key"], "left").select("case_id", "value", "rank")


def live_retrieval(cases: DataFrame, entities: DataFrame, projects: DataFrame) -> DataFrame:
    """Recall, reciprocal rank, best rank and missing values per case from :func:`first_ranks` of entities and projects; 1 without expectations."""

    def one(ranks, k):
        r = F.col("rank")
        got = ranks.groupBy("case_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"), *[F.count_if(r <= x).alias(f"h{x}") for x in k], F.array_sort(F.collect_list(F.when(r.isNull(), F.col("value")))).alias("missing"))
        rows = cases.select("case_id").join(got, "case_id", "left")
        none = F.col("n").isNull()
        recall = [F.when(none, 1.0).otherwise(F.col(f"h{x}") / F.col("n")).alias(f"recall_at_{x}") for x in k]
        rr = F.when(none, 1.0).when(F.col("best").isNull(), 0.0).otherwise(1.0 / F.col("best")).alias("reciprocal_rank")
        return rows.select("case_id", *recall, rr, F.col("best").alias("best_rank"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))

    p = one(projects, (3,)).select("case_id", F.col("recall_at_3").alias("project_recall_at_3"), F.col("reciprocal_rank").alias("project_reciprocal_rank"), F.col("missing").alias("missing_projects"))
    return one(entities, (5, 10)).withColumnRenamed("missing", "missing_entities").join(p, "case_id")


def compare_retrieval(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """``(case_id, d_recall_at_5, d_recall_at_10, d_reciprocal_rank)``: what the actual understanding gains over the golden one."""
    names = ("recall_at_5", "recall_at_10", "reciprocal_rank")
    a, g = actual.select("case_id", *names), golden.select("case_id", *[F.col(n).alias("_" + n) for n in names])
    return a.join(g, "case_id").select("case_id", *[(F.col(n) - F.col("_" + n)).alias("d_" + n) for n in names])


def call2(cases: DataFrame, recommendations: DataFrame, hits: DataFrame) -> DataFrame:
    """Metrics of the second call: ``cases(case_id, acceptable_decisions, acceptable_statuses, status)``.

    ``recommendations(case_id, decision, validation, n_evidence, n_valid)``; ``hits(case_id, value, required, referenced)`` says
    of expected entities whether the analysis refers to them. An empty list of decisions accepts any; the
    evidence rate leaves proposals out and is 1 without evidence.
    """
    is_ = lambda s: F.count_if(F.col("validation") == s)
    checked = F.col("validation") != "Proposal"
    r = recommendations.groupBy("case_id").agg(
        F.collect_set("decision").alias("decisions"), is_("Validated").alias("validated"), is_("Invalid").alias("invalid"), is_("PartiallyValidated").alias("partial"), is_("Proposal").alias("proposals"),
        F.sum(F.when(checked, F.col("n_evidence"))).alias("_all"), F.sum(F.when(checked, F.col("n_valid"))).alias("_valid"),
    )
    h = hits.groupBy("case_id").agg(F.count_if("referenced").alias("entity_hits"), F.count_if(F.col("required") & ~F.col("referenced")).alias("missing_required"))
    rows = cases.join(r, "case_id", "left").join(h, "case_id", "left").fillna(0, ["validated", "invalid", "partial", "proposals", "_all", "_valid", "entity_hits", "missing_required"])
    accepted = (F.size("acceptable_decisions") == 0) | F.coalesce(F.arrays_overlap("acceptable_decisions", "decisions"), F.lit(False))
    return rows.select(
        "case_id", accepted.alias("decision_hit"), "validated", "invalid", "partial", "proposals", ratio(F.col("_valid"), F.col("_all"), 1.0).alias("evidence_rate"),
        F.array_contains("acceptable_statuses", F.col("status")).alias("status_correct"), "entity_hits", "missing_required",
    )


def policy_metrics(expected: DataFrame, results: DataFrame, dispositions: DataFrame) -> DataFrame:
    """``(case_id, activation_accuracy, escapes)``: ``expected(case_id, policy_id, expected_active)`` against ``results(case_id, recommendation_id, policy_id, severity, status)``.

    A policy is active if some result of it is applicable. An escape is a recommendation with a violated blocking policy
    that is not rejected by ``dispositions(case_id, recommendation_id, disposition)``. Without expectations the accuracy is 1.
    """
    active = results.groupBy("case_id", "policy_id").agg(F.bool_or(F.col("status") != "NotApplicable").alias("active"))
    right = expected.join(active, ["case_id", "policy_id"], "left").groupBy("case_id").agg(F.avg((F.coalesce("active", F.lit(False)) == F.col("expected_active")).cast("int")).alias("activation_accuracy"))
    blocked = results.where("severity = 'Block' and status = 'Violated'").select("case_id", "recommendation_id").distinct()
    out = blocked.join(dispositions.where("disposition <> 'Rejected'"), ["case_id", "recommendation_id"]).groupBy("case_id").agg(F.count("*").alias("escapes"))
    every = expected.select("case_id").unionByName(results.select("case_id")).distinct()
    return every.join(right, "case_id", "left").join(out, "case_id", "left").select("case_id", F.coalesce("activation_accuracy", F.lit(1.0)).alias("activation_accuracy"), F.coalesce("escapes", F.lit(0)).alias("escapes"))


def call1_tokens(initiatives: DataFrame, prompt: str) -> DataFrame:
    return initiatives.select("case_id", (token_estimate(F.col("text")) + token_estimate(F.lit(prompt))).alias("call1"))
