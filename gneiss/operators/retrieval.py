"""Explainable lexical retrieval over components and projects, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.functions.text import mentions, rarity_points, tokens
from gneiss.operators.relational import bounded_points

#: Signal by field and points of a matching token.
TOKEN_SIGNALS = {
    "name": ("component name", 8), "related": ("base/interface", 5), "project": ("project identity", 4), "namespace": ("namespace", 3),
    "path": ("path", 2), "member": ("member name", 2),
}
#: Points and bounds of the other signals.
FULL_NAME, EXACT_NAME, MEMBER_MOST, RARITY_MOST, TEST_PENALTY = 48, 32, 6, 8, 10
PROJECT_EXACT, PROJECT_TOKEN, PROJECT_COMPONENT_MOST, EXPANSION = 10, 3, 12, 1
TOP_COMPONENTS, TOP_PROJECTS, TOP_EXPANDED = 12, 4, 5

#: Query terms that make an initiative one about tests.
TEST_TERMS = ["coverage", "integration", "prueba", "pruebas", "qa", "test", "testing", "tests", "unit"]

REASON = "struct<signal:string,matched_value:string,points:int>"


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``(query_id, term)`` of every query."""
    return queries.select("query_id", F.explode(tokens(F.col(text))).alias("term"))


def is_test_project(name: Column, path: Column) -> Column:
    return F.lower(name).endswith(".tests") | F.lower(F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""))).contains("/tests/")


def has_test_intent(terms: Column) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, TEST_TERMS)))


def postings(fields: DataFrame) -> DataFrame:
    """``(id, field, term)`` from ``(id, field, text)``: the inverted index, each term once per field."""
    return fields.select("id", "field", F.explode(tokens(F.col("text"))).alias("term")).distinct()


def document_frequency(index: DataFrame) -> DataFrame:
    """``(term, df)``: in how many components a term occurs, whatever the field."""
    return index.select("id", "term").distinct().groupBy("term").agg(F.count("*").cast("int").alias("df"))


def score(index: DataFrame, terms: DataFrame, n: int, exact: DataFrame | None = None, penalised: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, signal, matched_value, points)``: every reason of every match.

    ``index`` is :func:`postings`, ``terms`` :func:`query_terms`, ``n`` the number of components.
    ``exact(query_id, id, signal, matched_value, points)`` are identities named in the query;
    they replace name tokens and rarity. ``penalised(query_id, id, matched_value)`` lose points.
    Rarity counts all fields' terms but is given for names only.
    """
    hits = index.join(terms, "term")
    if exact is not None:
        named = exact.select("query_id", "id").distinct().withColumn("exact", F.lit(True))
        hits = hits.join(named, ["query_id", "id"], "left").where((F.col("field") != "name") | F.col("exact").isNull()).drop("exact")
    signal, points = F.lit(None).cast("string"), F.lit(None).cast("int")
    for field, (name, p) in TOKEN_SIGNALS.items():
        signal, points = F.when(F.col("field") == field, name).otherwise(signal), F.when(F.col("field") == field, p).otherwise(points)
    reasons = hits.select("query_id", "id", "field", "term", signal.alias("signal"), points.alias("points"))
    plain = reasons.where("field <> 'member'").select("query_id", "id", "signal", F.col("term").alias("matched_value"), "points")
    members = bounded_points(reasons.where("field = 'member'"), ["query_id", "id"], [F.col("term")], "points", MEMBER_MOST)
    members = members.where("granted > 0").select("query_id", "id", "signal", F.col("term").alias("matched_value"), F.col("granted").cast("int").alias("points"))
    rare = document_frequency(index).withColumn("rare", rarity_points(F.col("df"), F.lit(n))).where("rare > 0")
    rare = hits.where("field = 'name'").join(rare.select("term", "rare"), "term")
    rare = bounded_points(rare, ["query_id", "id"], [F.col("term")], "rare", RARITY_MOST).where("granted > 0")
    rare = rare.select("query_id", "id", F.lit("component name rarity").alias("signal"), F.col("term").alias("matched_value"), F.col("granted").cast("int").alias("points"))
    out = plain.unionByName(members).unionByName(rare)
    if exact is not None:
        out = out.unionByName(exact.select("query_id", "id", "signal", "matched_value", F.col("points").cast("int").alias("points")))
    if penalised is not None:
        # A penalty alone is no match: it is given to what has another reason.
        touched = out.select("query_id", "id").distinct()
        out = out.unionByName(
            penalised.join(touched, ["query_id", "id"], "left_semi").select("query_id", "id", F.lit("non-test initiative penalty").alias("signal"), "matched_value", F.lit(-TEST_PENALTY).alias("points"))
        )
    return out


def exact_matches(queries: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Components whose full name, or else name, a query mentions.

    Candidates come from an equi-join on a token of the identity, so a query meets
    only components that share one with it.
    """
    terms = queries.select("query_id", F.col(text).alias("text"), F.explode(tokens(F.col(text))).alias("term"))
    ids = names.select("id", "name", "full_name", F.explode(F.array_union(tokens(F.col("full_name")), tokens(F.col("name")))).alias("term"))
    pairs = ids.join(terms, "term").select("query_id", "id", "name", "full_name", "text").distinct()
    full, short = mentions(F.col("text"), F.col("full_name")), mentions(F.col("text"), F.col("name"))
    kind = F.when(full, F.struct(F.lit("exact full name").alias("signal"), F.col("full_name").alias("matched_value"), F.lit(FULL_NAME).alias("points"))).when(
        short, F.struct(F.lit("exact component name").alias("signal"), F.col("name").alias("matched_value"), F.lit(EXACT_NAME).alias("points"))
    )
    return pairs.withColumn("kind", kind).where("kind is not null").select("query_id", "id", "kind.*")


def candidates(reasons: DataFrame) -> DataFrame:
    """``(query_id, id, score, reasons)`` of components with a positive reason; the score itself may not be positive."""
    row = F.struct((-F.col("points")).alias("_down"), "signal", "matched_value", "points")
    grouped = reasons.groupBy("query_id", "id").agg(F.sum("points").cast("int").alias("score"), F.max("points").alias("_best"), F.array_sort(F.collect_list(row)).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(r.signal.alias("signal"), r.matched_value.alias("matched_value"), r.points.alias("points")))
    return grouped.where("_best > 0").select("query_id", "id", "score", plain.alias("reasons"))


def scores(reasons: DataFrame) -> DataFrame:
    """:func:`candidates` without the reasons: sums that combine before the shuffle."""
    grouped = reasons.groupBy("query_id", "id").agg(F.sum("points").cast("int").alias("score"), F.max("points").alias("_best"))
    return grouped.where("_best > 0").drop("_best")


def total_scores(index: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """``(query_id, id, score)`` of :func:`score` without exact names and penalties, in one aggregation.

    Both bounded signals saturate, so their sums are the least of the bound and the plain sum, and
    no window is needed. ``index`` may hold just the terms that queries ask for: a term's document
    frequency does not depend on the others.
    """
    rare = document_frequency(index).withColumn("rare", rarity_points(F.col("df"), F.lit(n))).select("term", "rare")
    hits = index.join(terms, "term").join(rare, "term")
    field = F.col("field")
    total = F.least(F.lit(MEMBER_MOST), F.count_if(field == "member") * TOKEN_SIGNALS["member"][1])
    for name, (_, points) in TOKEN_SIGNALS.items():
        if name != "member":
            total += F.count_if(field == name) * points
    total += F.least(F.lit(RARITY_MOST), F.sum(F.when(field == "name", F.col("rare")).otherwise(0)))
    return hits.groupBy("query_id", "id").agg(total.cast("int").alias("score"))


def top(candidates: DataFrame, names: DataFrame, most: int = TOP_COMPONENTS) -> DataFrame:
    """The ``most`` best of each query by score, full name and id, with ``rank``."""
    named = candidates.join(names.select("id", "full_name"), "id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "full_name", "id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= most)


def project_bonus(score: Column) -> Column:
    """Half of the best component's score, cut towards zero, from 1 to 12."""
    half = F.when(score < 0, -F.floor(-score / 2)).otherwise(F.floor(score / 2)).cast("int")
    return F.least(F.lit(PROJECT_COMPONENT_MOST), F.greatest(F.lit(1), half))


def score_projects(terms: DataFrame, aliases: DataFrame, best: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """``(query_id, project_id, score)`` from alias tokens, named aliases and the best component selected.

    ``aliases(project_id, alias)``; ``best(query_id, project_id, score)`` is the best
    score per project; ``exact(query_id, project_id)`` names projects outright.
    """
    tokens_of = aliases.select("project_id", F.explode(tokens(F.col("alias"))).alias("term")).distinct()
    parts = tokens_of.join(terms, "term").select("query_id", "project_id", F.lit(PROJECT_TOKEN).alias("points"))
    parts = parts.unionByName(best.select("query_id", "project_id", project_bonus(F.col("score")).alias("points")))
    if exact is not None:
        parts = parts.unionByName(exact.select("query_id", "project_id").distinct().withColumn("points", F.lit(PROJECT_EXACT)))
    return parts.groupBy("query_id", "project_id").agg(F.sum("points").cast("int").alias("score")).where("score > 0")


def top_projects(scored: DataFrame, most: int = TOP_PROJECTS) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "project_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)
