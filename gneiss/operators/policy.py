"""Outbound policies over declared actions: compliance, disposition and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocking system policies and the content each forbids, in catalogue order.
POLICIES = [
    ("SYS_REMOTE_COMPLETE_REPOSITORY", "CompleteRepository"),
    ("SYS_REMOTE_RAW_SNAPSHOT", "RawSnapshot"),
    ("SYS_REMOTE_SOURCE_BODIES", "SourceBodies"),
    ("SYS_REMOTE_SECRETS", "Secrets"),
    ("SYS_REMOTE_ABSOLUTE_PATHS", "AbsoluteLocalPaths"),
]


def catalogue(spark: SparkSession, severity: str = "Block") -> DataFrame:
    return spark.createDataFrame([(i, p, c, severity) for i, (p, c) in enumerate(POLICIES)], "ordinal int, policy_id string, category string, severity string")


def compliance(recommendations: DataFrame, actions: DataFrame, policies: DataFrame) -> DataFrame:
    """``(recommendation_id, policy_id, severity, status)`` for every recommendation and policy.

    Only remote transmissions count. Sending the forbidden content to a remote boundary is a violation; an
    unknown boundary, or unknown content to a remote one, leaves it unknown. Actions are first summed per
    recommendation and content, then meet the few policies.
    """
    sent = actions.where("operation = 'RemoteTransmission'")
    remote = F.col("boundary") == "Remote"
    unsure = (F.col("boundary") == "Unknown") | (remote & (F.col("content_scope") == "Unknown"))
    facts = sent.groupBy("recommendation_id").agg(
        F.bool_or(F.coalesce(unsure, F.lit(False))).alias("unsure"), F.bool_or(F.coalesce(remote, F.lit(False))).alias("remote"), F.collect_set(F.when(remote, F.col("content_scope"))).alias("scopes")
    )
    rows = recommendations.select("recommendation_id").distinct().join(facts, "recommendation_id", "left").crossJoin(F.broadcast(policies))
    status = (
        F.when(F.col("remote").isNull(), "NotApplicable").when(F.array_contains("scopes", F.col("category")), "Violated").when(F.col("unsure"), "Unknown").when(F.col("remote"), "Compliant").otherwise("NotApplicable")
    )
    return rows.select("recommendation_id", "policy_id", "severity", status.alias("status"))


def disposition(results: DataFrame, validation: DataFrame) -> DataFrame:
    """``(recommendation_id, disposition)``: Rejected, NeedsReview or Accepted."""
    facts = results.groupBy("recommendation_id").agg(
        F.bool_or((F.col("status") == "Violated") & (F.col("severity") == "Block")).alias("blocked"), F.bool_or(F.col("status") == "Unknown").alias("unknown")
    )
    rows = facts.join(validation.select("recommendation_id", F.col("status").alias("validation")), "recommendation_id", "left")
    review = F.col("unknown") | (F.coalesce("validation", F.lit("")) != "Validated")
    return rows.select("recommendation_id", F.when(F.col("blocked"), "Rejected").when(review, "NeedsReview").otherwise("Accepted").alias("disposition"))


def outcome(results: DataFrame) -> DataFrame:
    """One row: Blocked before Unknown before Warning before Allowed."""
    violated = F.col("status") == "Violated"
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return results.agg(
        F.when(has(violated & (F.col("severity") == "Block")), "Blocked").when(has(F.col("status") == "Unknown"), "Unknown").when(has(violated & (F.col("severity") == "Warn")), "Warning").otherwise("Allowed").alias("outcome")
    )
