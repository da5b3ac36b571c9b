"""Contexts of bounded size for reasoning requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.functions.hashing import render_segments
from gneiss.functions.text import token_estimate
from gneiss.operators.relational import greedy_pack

#: Token budgets by class of note, of graph evidence, and of the whole input.
BUDGETS = {"RootAndArchitecture": 3_500, "ProjectNote": 10_000, "ComponentNote": 18_000, "GraphEvidence": 6_000}
HARD_LIMIT = 50_000


def repository_facts(row: DataFrame) -> DataFrame:
    """One text of ten ``key: value`` lines per repository row."""
    clean = F.when(F.col("clean"), "clean").when(~F.col("clean"), "dirty").otherwise("unknown")
    facts = [
        ("repositoryId", F.col("repository_id")), ("repositoryName", F.col("name")), ("branch", F.coalesce("branch", F.lit("(no branch)"))), ("commit", F.coalesce("commit", F.lit("n/a"))),
        ("workingTree", clean), ("snapshotSchema", F.col("schema_version")), ("analysisMode", F.col("mode")), ("projects", F.col("projects")), ("entities", F.col("entities")), ("relations", F.col("relations")),
    ]
    return row.select("repository_id", F.concat_ws("\n", *[F.concat(F.lit(k + ": "), v.cast("string")) for k, v in facts]).alias("content"))


def note_segments(notes: DataFrame, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """``(query_id, class, rank, note_id, content, tokens)`` of notes that a greedy first fit takes per class.

    ``notes(query_id, class, rank, note_id, path, content, required)``. A note above what is left of its class's
    budget is skipped and later ones may fit; a required one raises instead.
    """
    text = F.concat(F.lit("NOTE: "), F.col("path"), F.lit("\n"), F.col("content"))
    rows = notes.withColumn("content", text).withColumn("tokens", token_estimate(F.col("content")))
    out = None
    for name, budget in budgets.items():
        part = rows.where(F.col("class") == name)
        taken = greedy_pack(part.select("query_id", "rank", "note_id", "tokens"), ["query_id"], ["rank"], "note_id", "tokens", budget).withColumnRenamed("id", "note_id")
        kept = part.join(taken.withColumn("_in", F.lit(True)), ["query_id", "note_id"], "left")
        lost = F.col("_in").isNull() & F.col("required")
        content = F.when(lost, F.raise_error(F.concat(F.lit("required note exceeds its token budget: "), F.col("path"))).cast("string")).otherwise(F.col("content"))
        kept = kept.withColumn("content", content).where(F.col("_in") | (F.col("required") & F.col("content").isNotNull()))
        kept = kept.select("query_id", "class", "rank", "note_id", "content", "tokens")
        out = kept if out is None else out.unionByName(kept)
    return out


def fit(segments: DataFrame, limit: int = HARD_LIMIT) -> DataFrame:
    """``segments`` that stay: all mandatory ones, and optional ones from the front until the total would pass the limit.

    ``segments(query_id, ordinal, kind, content, tokens, mandatory)``. If the mandatory segments alone
    are above the limit, no optional one stays.
    """
    must = segments.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("mandatory"), F.col("tokens"))), F.lit(0)).alias("_must"))
    run = F.sum(F.when(F.col("mandatory"), 0).otherwise(F.col("tokens"))).over(W.partitionBy("query_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    return segments.join(must, "query_id").withColumn("_run", run).where(F.col("mandatory") | (F.col("_must") + F.col("_run") <= limit)).drop("_must", "_run")


def render(segments: DataFrame) -> DataFrame:
    """``(query_id, content, tokens, over)``: each query's segments in order as one text."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "kind", "content")))
    text = segments.groupBy("query_id").agg(rows.alias("s"), F.sum("tokens").alias("tokens"))
    return text.select("query_id", render_segments(F.col("s")).alias("content"), "tokens", (F.col("tokens") > HARD_LIMIT).alias("over"))


def graph_evidence(lines: Column, budget: int = BUDGETS["GraphEvidence"]) -> Column:
    """Lines of graph evidence as one text; null, silently, if they are above their budget."""
    text = F.array_join(lines, "\n")
    return F.when(token_estimate(text) <= budget, text)


def ensure_compatible(manifest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The one row of ``manifest`` if it fits the one of ``snapshot``, both (repository_id, branch, schema, analyzer_version); else its use raises."""
    names = ("repository_id", "branch", "schema", "analyzer_version")
    both = manifest.crossJoin(snapshot.select(*[F.col(n).alias("_" + n) for n in names]))
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col("_" + n))
    # A filter on the error cannot be pruned away, as a column could.
    return both.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("notes are stale or belong to another repository or branch")).cast("boolean"))).select(*manifest.columns)


def build(understandings: DataFrame, facts: DataFrame, notes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(query_id, content, tokens, over)``: each query's whole context, within the hard limit.

    Mandatory are ``understandings(query_id, content)``, ``facts(query_id, content)``, root and architecture notes, and graph
    evidence ``evidence(query_id, line)`` that fits its budget. Notes are those of :func:`note_segments`; the last
    optional ones go until the rest fits. Raises if the mandatory part alone is above the limit.
    """
    tokens = token_estimate(F.col("content"))
    segment = lambda df, ordinal, kind, must: df.select("query_id", ordinal.alias("ordinal"), F.lit(kind).alias("kind"), "content", tokens.alias("tokens"), F.lit(must).alias("mandatory"))
    at = lambda place: F.struct(F.lit(place).alias("part"), F.lit(0).cast("long").alias("rank"))
    out = segment(understandings, at(0), "InitiativeUnderstanding", True).unionByName(segment(facts, at(1), "RepositoryIdentity", True))
    kinds = [("RootAndArchitecture", "RootNote", 2, True), ("ProjectNote", "ProjectNote", 3, False), ("ComponentNote", "ComponentNote", 4, False)]
    taken = note_segments(notes, {name: BUDGETS[name] for name, *_ in kinds})
    for name, kind, place, must in kinds:
        some = taken.where(F.col("class") == name)
        out = out.unionByName(segment(some, F.struct(F.lit(place).alias("part"), F.col("rank").cast("long").alias("rank")), kind, must))
    lines = evidence.groupBy("query_id").agg(graph_evidence(F.array_sort(F.collect_list("line"))).alias("content")).where("content is not null")
    out = fit(out.unionByName(segment(lines, at(5), "GraphEvidence", True)))
    done = render(out)
    return done.where(F.when(F.col("over"), F.raise_error(F.lit("the mandatory context is above the hard limit")).cast("boolean")).otherwise(True))
