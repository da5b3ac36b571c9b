"""Joins, aggregates, ranks and set operations that the scans and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that should have no ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key with ``rank`` and ``additional``, the number left out.

    The limit is pushed into the window (a group limit before the shuffle); totals
    come from a separate pre-aggregated count.
    """
    totals = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(totals, keys).withColumn("additional", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def bounded_points(df: DataFrame, keys: list[str], order: list[Column], points: str, most: int, to: str = "granted") -> DataFrame:
    """Points granted in order until their sum reaches ``most``; the last grant may be partial.

    A running sum suffices: once the bound is met, later rows get nothing.
    """
    before = F.coalesce(F.sum(points).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(to, F.greatest(F.least(F.col(points), F.lit(most) - before), F.lit(0)))


def drop_last_until_fit(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The longest prefix of each key's rows whose sizes fit the budget together."""
    total = F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("total", total).where(F.col("total") <= budget)


def greedy_fit(items: Column, budget: int) -> Column:
    """Of an ordered array of (id, size), the ids that a greedy first fit takes.

    An item too large for what is left is skipped, and later smaller ones may still
    fit, so this is a fold and no running sum. One array is one packing problem; its
    length is what a single context may hold, not a table's.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))
    fits = lambda acc, x: acc.used + x.size <= budget
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc.used + x.size).alias("used"), F.concat(acc.ids, F.array(x.id)).alias("ids"))).otherwise(acc)
    return F.aggregate(items, start, step)


def greedy_pack(df: DataFrame, keys: list[str], order: list[str], ident: str, size: str, budget: int) -> DataFrame:
    """``(keys, id)`` taken by :func:`greedy_fit` in the order of ``order`` and the id."""
    row = F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.col(ident).cast("long").alias("id"), F.col(size).cast("long").alias("size"))
    # Items above the budget never fit and need not be gathered.
    items = df.where(F.col(size) <= budget).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("items"))
    taken = greedy_fit(F.col("items"), budget)
    return items.select(*keys, F.explode(taken.ids).alias("id"))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same distinct rows."""
    left = a.distinct().withColumn("_l", F.lit(1))
    both = left.join(b.distinct().withColumn("_r", F.lit(1)), a.columns, "full")
    return both.agg(F.coalesce(F.bool_and(F.col("_l").isNotNull() & F.col("_r").isNotNull()), F.lit(True)).alias("is_equal"))


def ratio(hits: Column, of: Column, empty: float) -> Column:
    return F.when(of == 0, F.lit(float(empty))).otherwise(hits / of)


def all_or_null(value: Column) -> Column:
    """The sum, or null unless every row has a value; 0 without rows."""
    return F.when(F.count("*") == 0, F.lit(0)).when(F.count(value) == F.count("*"), F.sum(value))


def saturated(value: Column, most: int = 99) -> tuple[Column, Column]:
    """A sum held at ``most``, and whether it was above."""
    total = F.coalesce(F.sum(value), F.lit(0))
    return F.least(total, F.lit(most)), total > most
