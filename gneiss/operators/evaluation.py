"""Ranking metrics per case, their aggregates, and regressions against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.relational import ratio

#: How much a metric may fall, noise may rise, and contexts may grow (percent).
DECREASE, NOISE, GROWTH = 0.10, 0.10, 50.0


def match(ranked: DataFrame, expected: DataFrame, names: DataFrame) -> DataFrame:
    """``ranked(case_id, rank, id)`` with the ``role`` (required, acceptable, negative) of the expectation it meets.

    An expectation is an id, a name or a full name, whatever case; the first role wins.
    """
    keys = names.select("id", F.explode(F.array_distinct(F.array(*[F.lower(F.col(c).cast("string")) for c in ("id", "name", "full_name")]))).alias("key"))
    wanted = expected.select("case_id", F.lower("value").alias("key"), "role")
    place = F.when(F.col("role") == "required", 0).when(F.col("role") == "acceptable", 1).otherwise(2)
    hits = ranked.join(keys, "id").join(wanted, ["case_id", "key"]).groupBy("case_id", "rank", "id").agg(F.min_by("role", place).alias("role"))
    return ranked.join(hits, ["case_id", "rank", "id"], "left")


def metrics(cases: DataFrame, ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row per case of ``cases(case_id)``: recall, precision, reciprocal rank, noise and negatives.

    ``ranked(case_id, rank, role, is_test)``. Recall divides ranked hits by distinct expectations, so repeated
    rows can lift it above 1; without expectations it and the reciprocal rank are 1, precision is 0.
    Precision always divides by k.
    """
    need = expected.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("role") == "required", F.lower("value"))).alias("n_required"),
        F.count_distinct(F.when(F.col("role").isin("required", "acceptable"), F.lower("value"))).alias("n_relevant"),
    )
    r, role = F.col("rank"), F.col("role")
    required, relevant, negative, test = role == "required", role.isin("required", "acceptable"), role == "negative", F.col("is_test")
    aggs = [F.count("*").alias("n"), F.min(F.when(required, r)).alias("first"), F.count_if((r == 1) & negative).alias("neg1"), F.count_if((r <= 3) & negative).alias("neg3")]
    for k in ks:
        aggs += [F.count_if((r <= k) & required).alias(f"hit{k}"), F.count_if((r <= k) & relevant).alias(f"rel{k}"), F.count_if((r <= k) & test).alias(f"test{k}")]
    got = ranked.groupBy("case_id").agg(*aggs)
    rows = cases.select("case_id").join(need, "case_id", "left").join(got, "case_id", "left").fillna(0)
    out = ["case_id", F.col("n_required"), F.col("n_relevant")]
    for k in ks:
        out += [
            ratio(F.col(f"hit{k}"), F.col("n_required"), 1.0).alias(f"recall_at_{k}"),
            F.when(F.col("n_relevant") == 0, 0.0).otherwise(F.col(f"rel{k}") / F.lit(k)).alias(f"precision_at_{k}"),
            F.when(F.col("n") == 0, 0.0).otherwise(F.col(f"test{k}") / F.least(F.lit(k), F.nullif(F.col("n"), F.lit(0)))).alias(f"test_ratio_at_{k}"),
        ]
    first = F.when(F.col("n_required") == 0, 1.0).when(F.col("first") > 0, 1.0 / F.nullif(F.col("first"), F.lit(0))).otherwise(0.0)
    dominates = (F.col("neg1") > 0) | (F.col("neg3") > F.floor(F.least(F.lit(3), F.col("n")) / 2))
    return rows.select(*out, first.alias("reciprocal_rank"), dominates.alias("negative_dominates"))


def passed() -> Column:
    """The ten conditions of a passed case, over columns of its metrics."""
    c = F.col
    return (
        (c("missing_entities") == 0) & (c("missing_projects") == 0) & ~c("negative_dominates") & (c("types_found") == c("types_total")) & (c("invalid_evidence") == 0) & (c("unsupported") == 0)
        & (c("evidence_rate") == 1) & (c("fabricated_accepted") == 0) & (c("clarification_expected") == c("clarification_actual")) & ~c("budget_violation")
    )


def aggregate(rows: DataFrame, averages: list[str], tokens: str | None = None) -> list[Column]:
    """Averages (0 without rows), and the average, median and maximum of a token count."""
    out = [F.coalesce(F.avg(a), F.lit(0.0)).alias(a) for a in averages]
    if tokens:
        out += [F.coalesce(F.avg(tokens), F.lit(0.0)).alias("average_tokens"), F.coalesce(F.median(tokens), F.lit(0.0)).alias("median_tokens"), F.coalesce(F.max(tokens), F.lit(0)).alias("maximum_tokens")]
    return out


def grouped(rows: DataFrame, split: str, averages: list[str], tokens: str | None = None, groups: tuple[str, ...] = ("tuning", "holdout")) -> DataFrame:
    """Aggregates of each split and of all; the fixed groups have a row even without cases."""
    spark = rows.sparkSession
    both = rows.select(F.col(split).alias("grp"), *averages, *([tokens] if tokens else [])).where(F.col("grp").isin(*groups))
    every = rows.select(F.lit("all").alias("grp"), *averages, *([tokens] if tokens else []))
    got = both.unionByName(every).groupBy("grp").agg(F.count("*").alias("cases"), *aggregate(rows, averages, tokens))
    fixed = spark.createDataFrame([(g,) for g in (*groups, "all")], "grp string")
    return fixed.join(got, "grp", "left").fillna(0)


def categories(rows: DataFrame, tags: str, averages: list[str]) -> DataFrame:
    return rows.withColumn("tag", F.explode(tags)).groupBy("tag").agg(F.count("*").alias("cases"), *aggregate(rows, averages))


def unpivot(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return rows.unpivot(keys, names, "metric", "value")


def regressions(baseline: DataFrame, current: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """``(keys, metric, previous, value, kind)`` of metrics beyond their threshold.

    Both are ``(keys, metric, value)``; ``kinds`` says of each metric whether it must not decrease, or is
    noise or growth. What only one side has is skipped.
    """
    both = baseline.withColumnRenamed("value", "previous").join(current, [*keys, "metric"])
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("metric"))
    worse = (
        F.when(kind == "decrease", F.col("previous") - F.col("value") > DECREASE).when(kind == "noise", F.col("value") - F.col("previous") > NOISE)
        .when(kind == "growth", (F.col("previous") > 0) & ((F.col("value") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0)) * 100 > GROWTH))
    )
    return both.where(worse).select(*keys, "metric", "previous", "value", kind.alias("kind"))


def exit_code(all_passed: bool, n_regressions: int) -> int:
    return 3 if n_regressions else 0 if all_passed else 1
