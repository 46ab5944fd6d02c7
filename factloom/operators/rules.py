"""Rules that give rows: each finds violations (level, rule_id, ordinal, path, locus, message) in a set of tables.

All rules run in one plan. `accumulate` gives all findings, `first` the one that a fail-first check
would raise. A rule's guard says which scopes an earlier rule has stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import membership

COLUMNS = ["level", "rule_id", "ordinal", "path", "locus", "message"]
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    find: Callable[[Tables], DataFrame]
    level: str = "ERROR"


def violation(rows: DataFrame, path: Column | str, locus: Column | str, message: Column | str) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(as_col(path).cast("string").alias("path"), as_col(locus).cast("string").alias("locus"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def accumulate(rules: list[Rule], tables: Tables) -> DataFrame:
    found = [r.find(tables).select(F.lit(r.level).alias("level"), F.lit(r.rule_id).alias("rule_id"), F.lit(k).alias("ordinal"), "path", "locus", "message") for k, r in enumerate(rules)]
    return reduce(DataFrame.unionByName, found)


def first(rules: list[Rule], tables: Tables) -> DataFrame:
    """At most one row: the first violation in the order of rules, then path, locus and message."""
    return accumulate(rules, tables).orderBy("ordinal", "path", "locus", "message").limit(1)


def require(rules: list[Rule], tables: Tables) -> None:
    if row := first(rules, tables).collect():
        raise ValueError(f"{row[0].rule_id} {row[0].path}: {row[0].message}")


def report(findings: DataFrame) -> tuple[list[str], int]:
    """Lines for people and the exit code: 0 without errors, 1 with."""
    rows = findings.orderBy("path", "ordinal", "locus", "message").collect()
    return [f"{r.level}: {r.path}: {r.message}" for r in rows], int(any(r.level == "ERROR" for r in rows))


def not_in(rows: DataFrame, keys: dict[str, str], known: DataFrame, vocabulary: bool = False, sparse: bool = False) -> DataFrame:
    """Rows without a partner in known; null keys are without one. keys: column of rows to column of known.

    vocabulary: known is a controlled vocabulary, small by nature, and is broadcast.
    sparse: most rows have no partner; a bitmap says so of nearly all of them, and only the others are shuffled.
    """
    if sparse:
        return membership.not_in(rows, keys, known)
    right = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys.values())])
    right = F.broadcast(right) if vocabulary else right
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return rows.join(right, reduce(lambda a, b: a & b, on), "left_anti")


def expect_counts(rows: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """(key, want, have) where group counts differ from the expected (key, want), groups nobody expects too."""
    have = rows.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("have"))
    both = expected.join(have, "key", "full_outer").select("key", F.coalesce("want", F.lit(0)).cast("bigint").alias("want"), F.coalesce("have", F.lit(0)).alias("have"))
    return both.where("want <> have")


def expect_values(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, want, have) where named values differ from the frozen ones; both are (key, value)."""
    both = expected.withColumnRenamed("value", "want").join(actual.withColumnRenamed("value", "have"), "key", "left")
    return both.where(~F.col("want").eqNullSafe(F.col("have")))


def missing_and_extra(want: DataFrame, have: DataFrame, key: str, sparse: bool = False) -> DataFrame:
    """(key, side): what only one of two lists has. sparse: as in not_in, for lists that have little in common."""
    a, b = want.select(key).distinct(), have.select(key).distinct()
    missing, extra = (not_in(x, {key: key}, y, sparse=sparse) for x, y in ((a, b), (b, a)))
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with its side. Columns are matched by position; each table is read once."""
    n, most = F.col("_n"), 1_000_000
    both = a.select("*", F.lit(1).cast("bigint").alias("_n")).union(b.select("*", F.lit(-1).cast("bigint").alias("_n")))
    more = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_n").alias("_n")).where(n != 0)
    sided = more.withColumn("side", F.when(n > 0, "left").otherwise("right")).withColumn("_n", F.abs(n))
    blocks = sided.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {most}"))))  # a row for each difference, by arrays of bounded length
    each = F.array_repeat(F.lit(0), F.least(n - F.col("_k") * most, F.lit(most)).cast("int"))
    return blocks.select("*", F.explode(each).alias("_e")).drop("_n", "_k", "_e")
