"""Registration of queries with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.functions.text import STOP_WORDS, SYNONYMS
from gneiss.plans.lineage import Lineage, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute, read lazily with the columns a query asks for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._kept = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that one query uses several times, written once to the shared folder."""
        if name not in self._kept:
            self._kept[name] = Lineage(self._spark, name).cut(make())
        return self._kept[name]

    def wide(self, name: str) -> DataFrame:
        """A table whose rows are costly to work on, over all cores."""
        return spread(getattr(self, name))


def query(sql: str | None = None):
    """Register a function of (spark, tables) under its name."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(spark, Tables(spark, folder))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def raw_sql(text: str) -> str:
    """Tokens of a text in order, in SQL."""
    seams = f"regexp_replace(regexp_replace(coalesce({text}, ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower(strip_accents({seams})), '[^a-zA-Z0-9]+'), lambda t: length(t) > 1)"


def tokens_sql(text: str) -> str:
    """Distinct sorted tokens without stop words, synonyms read, in SQL."""
    stop = sql_list(STOP_WORDS)
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items())
    known = f"list_filter({raw_sql(text)}, lambda t: NOT list_contains({stop}, t))"
    return f"list_sort(list_distinct(list_filter(list_transform({known}, lambda t: CASE t {cases} ELSE t END), lambda t: NOT list_contains({stop}, t))))"
