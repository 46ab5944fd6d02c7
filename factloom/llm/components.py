"""Connected components of an edge table, each named by its smallest node.

Tasks first contract their own edges with union-find; then rounds of large-star and small-star run
until nothing changes. Minima are aggregated map-side and joined back, the nodes with very many
neighbours by broadcast, so none is gathered in one place; every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import discard, materialize

EDGE = "a bigint, b bigint"
#: A key is hot with over HOT rows and over one in HOT_KEYS of all; so there are at most HOT_KEYS hot keys.
HOT, HOT_KEYS = 500, 50_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int | None = None) -> DataFrame:
    """The inner join of rows with keyed, which has one row for each key and the number of rows that have it (total: of all).

    Hot keys are broadcast, at most HOT_KEYS by their definition, so no task gets all rows of one; the others meet by shuffle.
    """
    if total is None:
        total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    bound = max(HOT, total // HOT_KEYS)
    hot, cold = keyed.where(F.col(count) > bound), keyed.where(F.col(count) <= bound)
    if hot.isEmpty():
        return rows.join(keyed, on)
    told = rows.join(F.broadcast(hot), on)
    return told.unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


class Union:
    """Disjoint sets; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        self.parent.setdefault(x, x)
        return True


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _contract(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Union()

        def forest() -> pa.RecordBatch:
            return edge_batch([(x, r) for x in sets.parent if (r := sets.find(x)) != x])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.join(x, y)
            if len(sets.parent) > limit:
                yield forest()
                sets = Union()
        yield forest()

    return run


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    return r[0], int(r[1])


def connected_components(edges: DataFrame, max_rounds: int = 60, task_nodes: int = 500_000) -> DataFrame:
    """(node, component) for every node that an edge (a, b) names. task_nodes bounds a task's union-find."""
    now = materialize(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(_contract(task_nodes), EDGE), "cc-0")
    state = _state(now)
    for k in range(max_rounds):
        if not state[0]:
            break
        # large-star: a node's larger neighbours go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("c")).where("c > 0"), f"cc-large-{k}")
        large = join_counted(both.where("b > a"), least, ["a"], "c", state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its smaller neighbours go to the least of them
        down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"cc-down-{k}")
        lower = materialize(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), f"cc-small-{k}")
        small = join_counted(down, lower, ["a"], "c", state[0]).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(small.where("a <> b").distinct(), f"cc-{k + 1}")
        for done in (now, least, down, lower):
            discard(done)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    # every edge now leads from a node to the least of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
