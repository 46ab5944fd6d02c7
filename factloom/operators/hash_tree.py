"""Comparing two versions of a table by hash trees, so that only ranges of keys that differ are joined.

A key's hash places its row in one of 2 ** depth ranges; a range's node has the number of its rows and four sums over the halves of two
64-bit hashes of each row, so the order of rows doesn't matter and repeated rows count. Nodes of upper levels add up those below, 256
at a time. Two trees are compared from the root down and only below nodes that differ. The ranges found become a bitmap of bounded size
(`membership`), with which each side's rows are told apart where they stand: rows in ranges that agree are equal and aren't
shuffled, the others meet in the plain comparison.

Building a tree is an aggregation of one narrow row for each task and range. A tree that is kept beside its table (`path`, `load`) spares
that side the next time. Two different ranges are taken for equal only if all four sums agree by chance.

Columns are matched by name; where their types differ nothing agrees and everything is joined, with the same result. Map and VARIANT
columns have no hash. Columns named _range, _place, _word, _bits or _open are this module's own. Empty tables have no nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from factloom.operators import artifacts, rules
from factloom.operators.membership import BITS, bitmap, marked
from factloom.session import discard, materialize, scratch_path

#: Levels of bits from one stored level to the next.
STEP = 8
SUMS = ["n", "s0", "s1", "s2", "s3"]
NODES = "range bigint, n bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, level int"


@dataclass(frozen=True)
class HashTree:
    nodes: DataFrame
    depth: int

    def at(self, level: int) -> DataFrame:
        """(range, n, s0 to s3) of a level; one that isn't stored is added up from the leaves."""
        if level == self.depth or (level < self.depth and level % STEP == 0):
            return self.nodes.where(F.col("level") == level).drop("level")
        return summed(self.nodes.where(F.col("level") == self.depth), self.depth - level)


def depth_for(rows: int, per_range: int = 16) -> int:
    """The depth at which ranges hold at most per_range rows on average."""
    return min(40, max(0, ceil(log2(max(1, rows) / per_range))))


def hashed(rows: DataFrame, columns: list[str], seed: int) -> Column:
    """A hash in which nulls count; Spark's own passes over them, so they have a flag and nested values are taken as JSON."""
    nested = {f.name for f in rows.schema if isinstance(f.dataType, (StructType, ArrayType))}
    value = lambda c: F.to_json(F.col(f"`{c}`"), {"ignoreNullFields": "false"}) if c in nested else F.col(f"`{c}`")
    return F.xxhash64(F.lit(seed), *[x for c in sorted(columns) for x in (F.col(f"`{c}`").isNull(), value(c))])


def range_of(rows: DataFrame, keys: list[str], depth: int) -> Column:
    return F.shiftrightunsigned(hashed(rows, keys, 1), 64 - depth) if depth else F.lit(0).cast("bigint")


def summed(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.groupBy(F.shiftright("range", bits).alias("range")).agg(*[F.sum(s).alias(s) for s in SUMS])


def build(rows: DataFrame, keys: list[str], depth: int, path: str | None = None) -> HashTree:
    """The tree over all columns of rows, written to path, a new folder, or to the shared one."""
    spark, columns = rows.sparkSession, rows.columns
    path = path or scratch_path(spark, "hash-tree")
    low = F.lit(0xFFFFFFFF).cast("bigint")
    halves = rows.select(range_of(rows, keys, depth).alias("range"), hashed(rows, columns, 2).alias("h0"), hashed(rows, columns, 3).alias("h1"))
    leaves = halves.groupBy("range").agg(
        F.count("*").alias("n"), F.sum(F.col("h0").bitwiseAND(low)).alias("s0"), F.sum(F.shiftrightunsigned("h0", 32)).alias("s1"),
        F.sum(F.col("h1").bitwiseAND(low)).alias("s2"), F.sum(F.shiftrightunsigned("h1", 32)).alias("s3"),
    )
    levels = [depth, *[k for k in range(depth - 1, -1, -1) if k % STEP == 0]]
    nodes, above = leaves, depth
    for level in levels:
        (nodes if level == above else summed(nodes, above - level)).write.parquet(f"{path}/level={level}")
        nodes, above = spark.read.schema(NODES.rsplit(",", 1)[0]).parquet(f"{path}/level={level}"), level
    return HashTree(spark.read.schema(NODES).parquet(path), depth)


def load(spark: SparkSession, path: str) -> HashTree:
    """The tree that build() wrote to path."""
    nodes = spark.read.schema(NODES).parquet(path)
    return HashTree(nodes, nodes.agg(F.max("level")).first()[0] or 0)


def differing(a: HashTree, b: HashTree) -> tuple[DataFrame, int]:
    """((range), depth): ranges whose nodes differ, at the depth of the shallower tree. Nodes below nodes that agree aren't compared."""
    depth = min(a.depth, b.depth)
    found, above = None, 0
    for level in [*range(0, depth, STEP), depth]:
        sides = [t.at(level) for t in (a, b)]
        if found is not None:
            parents = found.withColumnRenamed("range", "_parent")
            sides = [s.join(parents, F.shiftright("range", level - above) == F.col("_parent"), "left_semi") for s in sides]
        left, right = (s.select("range", F.struct(*SUMS).alias(name)) for s, name in zip(sides, ("a", "b"), strict=True))
        before, found, above = found, materialize(left.join(right, "range", "full_outer").where("NOT (a <=> b)").select("range"), "differing"), level
        if before is not None:
            discard(before)
    return found, depth


def divide(rows: DataFrame, keys: list[str], ranges: DataFrame, depth: int, nulls: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows in ranges that agree, rows to be compared); neither is shuffled. Beyond 2 ** BITS ranges, neighbours share a place of the bitmap.

    nulls: columns whose nulls the comparison takes for unequal; such rows are always compared.
    """
    fold = max(0, depth - BITS)
    bits = bitmap(ranges.select(F.shiftright("range", fold)))
    flagged = marked(rows, F.shiftright(range_of(rows, keys, depth), fold), bits, "_open")
    compared = reduce(lambda x, c: x | F.col(f"`{c}`").isNull(), nulls, F.col("_open"))
    return flagged.where(~compared).drop("_open"), flagged.where(compared).drop("_open")


def trees(a: DataFrame, b: DataFrame, keys: list[str], per_range: int = 16) -> tuple[HashTree, HashTree]:
    """Trees for one comparison. Ranges beyond 2 ** BITS would share places of the bitmap, so such trees are no deeper."""
    depth = min(BITS, depth_for(max(a.count(), b.count()), per_range))
    return build(a, keys, depth), build(b, keys, depth)


def drift(expected: DataFrame, actual: DataFrame, kept: tuple[HashTree, HashTree] | None = None, changes_only: bool = False) -> DataFrame:
    """(name, status) as `artifacts.drift` gives it for names that are unique on each side; null names match nothing.

    kept: trees of both over the key `name`, where they are at hand. changes_only leaves out OK.
    """
    expected, actual = expected.select("name", "sha256"), actual.select("name", "sha256")
    ranges, depth = differing(*(kept or trees(expected, actual, ["name"])))
    same, want = divide(expected, ["name"], ranges, depth, ("name", "sha256"))
    _, have = divide(actual, ["name"], ranges, depth, ("name", "sha256"))
    found = artifacts.drift(want, have)
    if changes_only:
        return found.where("status <> 'OK'")
    return found.unionByName(same.select("name", F.lit("OK").alias("status")))


def multiset_difference(a: DataFrame, b: DataFrame, kept: tuple[HashTree, HashTree] | None = None) -> DataFrame:
    """The rows of `rules.multiset_difference`; nulls are equal to nulls there. b's columns are taken by position."""
    b, keys = b.toDF(*a.columns), a.columns
    ranges, depth = differing(*(kept or trees(a, b, keys)))
    return rules.multiset_difference(divide(a, keys, ranges, depth)[1], divide(b, keys, ranges, depth)[1])
