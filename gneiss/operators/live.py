"""Live runs: coverage of expectations, usage, cost, consistency and limits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import tokens
from gneiss.operators.relational import all_or_null

#: Limits of a live run.
MAX_CASES, MAX_RUNS, MAX_CALLS = 5, 3, 10


def covered(expected: Column, actual: Column) -> Column:
    """Whether all tokens of an expected text occur somewhere in a list of texts."""
    return F.size(F.array_except(tokens(expected), F.flatten(F.transform(actual, tokens)))) == 0


def field_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(case_id, n_expected, n_covered, coverage)`` of ``expected(case_id, value)`` in ``actual(case_id, value)``; 1 without expectations.

    The actual tokens of a case are gathered as a set, so its texts may be many.
    """
    have = actual.select("case_id", F.explode(tokens(F.col("value"))).alias("t")).distinct()
    want = expected.select("case_id", "value", F.explode_outer(tokens(F.col("value"))).alias("t"))
    per = want.join(have.withColumn("hit", F.lit(True)), ["case_id", "t"], "left").groupBy("case_id", "value").agg(F.bool_and(F.col("t").isNull() | F.col("hit").isNotNull()).alias("ok"))
    return per.groupBy("case_id").agg(F.count("*").alias("n_expected"), F.count_if("ok").alias("n_covered")).withColumn("coverage", F.col("n_covered") / F.col("n_expected"))


def expectation_hits(alternatives: DataFrame, observed: DataFrame) -> DataFrame:
    """``(case_id, expectation, alternative, item)``: the first alternative, then item, of which one item has all tokens.

    ``alternatives(case_id, expectation, alternative, tokens)``, ``observed(case_id, item, tokens)``. The
    join is by a token, an alternative without tokens meets nothing.
    """
    need = alternatives.withColumn("n", F.size("tokens")).select("case_id", "expectation", "alternative", "n", F.explode("tokens").alias("t"))
    have = observed.select("case_id", "item", F.explode(F.array_distinct("tokens")).alias("t"))
    full = need.join(have, ["case_id", "t"]).groupBy("case_id", "expectation", "alternative", "item", "n").agg(F.count("*").alias("m")).where("m = n")
    best = full.groupBy("case_id", "expectation").agg(F.min(F.struct("alternative", "item")).alias("b"))
    return best.select("case_id", "expectation", "b.alternative", "b.item")


def extra_terms(actual: DataFrame, golden: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(case_id, term, harmful)``: terms beyond the golden ones; harmful if the repository has no such word."""
    extra = actual.join(golden, ["case_id", "term"], "left_anti").select("case_id", "term").distinct()
    known = vocabulary.select("term").distinct().withColumn("_v", F.lit(True))
    return extra.join(known, "term", "left").select("case_id", "term", F.col("_v").isNull().alias("harmful"))


def cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """``usage`` with ``cost`` in exact decimals; null without one matching price or with more cached than input tokens.

    Providers match whatever their case, models exactly. The price list is a small reference table;
    AQE broadcasts it where its measured size allows.
    """
    once = pricing.groupBy(F.lower("provider").alias("_p"), F.col("model").alias("_m")).agg(
        F.count("*").alias("_n"), *[F.first(c).cast("decimal(12,6)").alias(c) for c in ("input_per_m", "cached_per_m", "output_per_m")]
    ).where("_n = 1")
    u = usage.join(once, (F.lower("provider") == F.col("_p")) & (F.col("model") == F.col("_m")), "left")
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(12,0)")
    total = (d("actual_input") - d("cached_input")) * F.col("input_per_m") + d("cached_input") * F.col("cached_per_m") + d("actual_output") * F.col("output_per_m")
    sound = F.coalesce("cached_input", F.lit(0)) <= F.coalesce("actual_input", F.lit(0))
    return u.withColumn("cost", F.when(sound, (total * F.lit(Decimal("0.000001"))).cast("decimal(38,12)"))).select(*usage.columns, "cost")


def usage_summary(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of tokens, time and retries with nulls as 0; the cost is null unless every call has one."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c)
    aggs = [F.count("*").alias("calls"), *[total(c) for c in ("actual_input", "cached_input", "actual_output", "retries", "duration_ms")], F.max("duration_ms").alias("longest_ms"), all_or_null(F.col("cost")).alias("cost")]
    return priced.groupBy(*keys).agg(*aggs)


def mode_agreement(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the most frequent value per key; 1 without rows is the caller's default."""
    n = runs.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("agreement"))


def pairwise_jaccard(runs: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """Mean Jaccard similarity of all pairs of a key's sets of ``value``; 1 with one set or between empty sets.

    Pairs of runs are few per case by the limits of a live run.
    """
    sets = runs.groupBy(*keys, run).agg(F.collect_set(value).alias("s"))
    a, b = sets.withColumnsRenamed({run: "_i", "s": "_a"}), sets.withColumnsRenamed({run: "_j", "s": "_b"})
    both, either = F.size(F.array_intersect("_a", "_b")), F.size(F.array_union("_a", "_b"))
    pairs = a.join(b, keys).where("_i < _j").select(*keys, F.when(either == 0, 1.0).otherwise(both / either).alias("_x"))
    means = pairs.groupBy(*keys).agg(F.avg("_x").alias("jaccard"))
    return sets.select(*keys).distinct().join(means, keys, "left").select(*keys, F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def plan(n_cases: int, n_runs: int, calls_per_run: int = 2) -> int:
    """Number of calls of a live run; raises beyond the limits."""
    calls = n_cases * n_runs * calls_per_run
    if not 1 <= n_cases <= MAX_CASES or not 1 <= n_runs <= MAX_RUNS or calls > MAX_CALLS:
        raise ValueError(f"{n_cases} cases, {n_runs} runs and {calls} calls are beyond {MAX_CASES}, {MAX_RUNS} and {MAX_CALLS}")
    return calls


def authorize(fake: bool, remote: bool, allowed: bool) -> str:
    """Which provider a live run may use."""
    if fake == remote:
        raise ValueError("exactly one of the fake and the remote provider must be chosen")
    if remote and not allowed:
        raise PermissionError("a remote provider needs explicit permission")
    return "remote" if remote else "fake"
