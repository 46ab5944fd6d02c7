"""Merkle manifests of tables: a tree for each group of rows, and one over the groups' roots.

Leaves of a group are in the order of given columns; every two consecutive nodes become the SHA-256 of
their digests, a last odd one alone that of its own, until one is left. The trees are worked by
Pregel-style supersteps over RDDs. A vertex owns a run of 2^LEVELS neighbouring nodes and the levels
above them. Upwards, children send digests to their vertex; one that has heard all its children hashes
its levels, keeps them as its state and sends its last digest on. Downwards, a vertex that knows the
siblings above it sends each child the siblings on its own way, until they reach the leaves. A vertex
hears at most 2^LEVELS children, so neither a large group nor the root gathers more; there are
log(n) / LEVELS supersteps each way. Places come from a range sort and prefix sums over its parts.

Vertices are checkpointed in the shared folder, so a lost executor costs the superstep it was in.

Defined results: null groups form a group of their own, before all others; null order values come
first; rows that agree in all order columns stand in any order, so digests should be the last of
these; rows may repeat, each is a leaf; an empty table gives no rows; columns named like the
result's are replaced, other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.llm.components import join_counted
from factloom.session import discard, materialize, partitions, shared_dir, ship, without

#: Levels of nodes that one vertex owns.
LEVELS = 8
RESULT = "position bigint, group_size bigint, subroot string, root string, path array<struct<left:string,right:string>>"
Step = tuple[str, str]


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in hex of the fields' texts, each after its byte count and a colon, or a dash where it is null."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the way to the root."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings on its way."""
    return F.aggregate(path, leaf, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def ranked(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """rows, written, with `_name`, its group, `_pos`, its place there from 0, and `_n`, the group's size."""
    g = F.lit(None).cast("string") if group is None else F.col(f"`{group}`").cast("string")
    keyed = rows.withColumns({"_z": g.isNotNull(), "_g": F.coalesce(g, F.lit(""))})
    keys = [F.col("_z"), F.col("_g"), *[F.col(f"`{c}`").asc_nulls_first() for c in order]]
    parted = keyed.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    held = materialize(parted.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted").withColumn("_part", F.shiftright("_at", 33))
    on = ["_part", "_z", "_g"]
    counts = held.groupBy(*on).agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    of_group = Window.partitionBy("_z", "_g")
    before = F.coalesce(F.sum("_here").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select(*on, "_here", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(of_group).alias("_n")), "merkle-counts")
    out = join_counted(held, counts, on, "_here").withColumn("_pos", F.col("_at") + F.col("_shift"))
    placed = materialize(out.withColumn("_name", F.when(F.col("_z"), F.col("_g"))).drop("_at", "_part", "_here", "_shift", "_z", "_g"), "merkle-placed")
    discard(held)
    discard(counts)
    return placed


def _node(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _levels(digests: list[str], n: int, most: int) -> tuple[list[list[str]], int]:
    """The run's digests on each level, at most `most` above the first, and how many nodes the group has on the last."""
    levels = [digests]
    while n > 1 and len(levels) <= most:
        last = levels[-1]
        levels.append([_node(last[k : k + 2]) for k in range(0, len(last), 2)])
        n = (n + 1) // 2
    return levels, n


def _inner(levels: list[list[str]], child: int) -> list[Step]:
    """The siblings of one child on each level that the vertex owns."""
    out = []
    for level in levels[:-1]:
        other = child ^ 1
        beside = level[other] if other < len(level) else ""
        out.append((beside, "") if other < child else ("", beside))
        child >>= 1
    return out


def _held(rdd: RDD) -> RDD:
    """rdd, written to the checkpoint folder."""
    rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    rdd.unpersist()
    return rdd


def _complete(levels: int):
    """A vertex from what its children have sent: (nodes of the group after it, its levels, what its children carry)."""

    def run(vertex: tuple) -> tuple:
        key, heard = vertex
        children = sorted(heard, key=lambda m: m[0])
        n = children[0][1]
        if len(children) != min(1 << levels, n - (key[1] << levels)):
            raise RuntimeError(f"vertex {key} has heard {len(children)} of its children")
        owned, left = _levels([m[2] for m in children], n, levels)
        return key, (left, owned, [m[3] for m in children])

    return run


def _tell(levels: int):
    def run(x: tuple) -> Iterator[tuple]:
        (group, place), ((_, owned, _), (above, facts)) = x
        for child in range(len(owned[0])):
            yield (group, (place << levels) + child), (_inner(owned, child) + above, facts)

    return run


def _reach(x: tuple) -> Iterator[tuple]:
    _, ((_, owned, carried), (above, facts)) = x
    for child, own in enumerate(carried):
        yield facts, owned[0][child], _inner(owned, child) + above, own


class Forest:
    """The vertices of all groups' trees, a superstep each. Leaves: (group, place, group's size, digest, what to carry)."""

    def __init__(self, leaves: RDD, longest: int, parts: int, levels: int = LEVELS) -> None:
        self.parts, self.levels = parts, levels
        self.vertices: list[RDD] = []
        steps = 1
        while longest > 1 << (levels * steps):
            steps += 1
        width = (1 << levels) - 1
        messages = leaves.map(lambda x: ((x[0], x[1] >> levels), (x[1] & width, x[2], x[3], x[4])))
        for _ in range(steps):
            self.vertices.append(_held(messages.groupByKey(parts).map(_complete(levels))))
            messages = self.vertices[-1].filter(lambda v: v[1][0] > 1).map(lambda v: ((v[0][0], v[0][1] >> levels), (v[0][1] & width, v[1][0], v[1][1][-1][0], None)))

    def roots(self) -> RDD:
        """(group, digest, superstep that completed it) of every tree."""

        def ended(k: int):
            return lambda x: (x[0][0], x[1][1][-1][0], k)

        return self.vertices[0].context.union([v.filter(lambda x: x[1][0] == 1).map(ended(k)) for k, v in enumerate(self.vertices)])

    def paths(self, above: RDD) -> RDD:
        """(the group's facts, digest, siblings on the way, what it carries) of every leaf. above: (group, superstep that completed it, (siblings above its tree, facts))."""

        def to_top(k: int) -> RDD:
            return above.filter(lambda x: x[1] == k).map(lambda x: ((x[0], 0), x[2]))

        last = len(self.vertices) - 1
        told = to_top(last)
        for k in range(last, 0, -1):
            told = self.vertices[k].join(told, self.parts).flatMap(_tell(self.levels)).union(to_top(k - 1))
        return self.vertices[0].join(told, self.parts).flatMap(_reach)


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str, levels: int = LEVELS) -> DataFrame:
    """rows with their `position` in the group, `group_size`, `subroot`, `root` and `path`, the siblings on each level up to the root.

    Groups are told apart and ordered by their text. leaf: the column of digests in hex. levels: how many a vertex owns, 1 for a vertex a node.
    """
    spark = rows.sparkSession
    ship(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    kept = without(rows, T.StructType.fromDDL(RESULT).names)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(RESULT).fields])
    at = {c: f"c{k}" for k, c in enumerate(kept.columns)}  # names that don't meet those of ranked()
    given = materialize(kept.toDF(*at.values()), "merkle-leaves")  # the range sort reads its input twice
    placed = ranked(given, at[group], [at[c] for c in order])
    discard(given)
    longest = placed.agg(F.max("_n")).first()[0]
    if not longest:
        return spark.createDataFrame([], schema)
    n, width, digest = partitions(spark), len(at), int(at[leaf][1:])
    leaves = placed.select(*at.values(), "_pos", "_n", "_name").rdd.map(lambda r: (r[width + 2], r[width], r[width + 1], r[digest], r[: width + 2]))
    forest = Forest(leaves, longest, n, levels)
    discard(placed)
    tops = ranked(spark.createDataFrame(forest.roots(), "name string, digest string, step int"), None, ["name"])
    count = tops.count()
    crown = Forest(tops.select("name", "step", "digest", "_pos", "_n").rdd.map(lambda r: (0, r[3], r[4], r[2], (r[0], r[1]))), count, min(n, 1 + (count >> levels)), levels)
    discard(tops)
    # a group's facts are its subroot and the root; its tree goes on below the siblings of its subroot
    above = _held(crown.paths(crown.roots().map(lambda r: (r[0], r[2], ([], r[1])))).map(lambda x: (*x[3], (x[2], (x[1], x[0])))))
    return spark.createDataFrame(forest.paths(above).map(lambda x: (*x[3], *x[0], x[2])), schema, verifySchema=False)
