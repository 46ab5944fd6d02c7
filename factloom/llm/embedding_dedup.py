"""Near-duplicate vectors by a forest of random-projection trees whose splits overlap.

Equal vectors are one class. Crowds of near copies become balls first: in rounds, items in the order of
random projections are taken in chunks, and those within half of the threshold's angle of their common
centre are one ball, which the next rounds may join with others. Any two members of a ball are linked for
certain, so a group of millions is an item like any other and is never compared with itself.

Every tree splits its nodes at a quantile of a random projection, level by level, and items near the
split go both ways; nodes of at most `leaf_items` are leaves. Splits are fitted on bounded samples of a
node's items, several levels a round, and every item is then routed by them. Items that share a leaf in
any tree are compared by matrix products. A pair that shares several leaves counts in the first of them
only, by the leaves that both items carry, so no pairs have to be told apart by a shuffle, and a leaf gives
sums and a spanning forest and never its pairs. Balls whose distance leaves links open are compared member
by member, in blocks. Links are unions; the components of these are the groups.

Fixed by parameters: `sample` items a node fit its splits (all items are routed), with eight trees and the
overlap of 0.06 about 99.9 % of pairs at the threshold share a leaf in a table of 50,000 random vectors (a
test measures against brute force); closer pairs share more. Splits are broadcast up to BROADCAST_SPLITS
nodes a round and joined by shuffle beyond.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and
are kept; vectors of different length aren't linked; rows that share an id are vectors of their own; a null
id is no group's smallest; an empty table gives no rows; other columns are carried, those named like
results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.components import connected_components, join_counted
from factloom.session import discard, materialize, partitions, ship, without

THRESHOLD = 0.9
TREES, LEAF_ITEMS, OVERLAP = 8, 1024, 0.06
#: Levels that one round adds, items of a node that fit them, and nodes whose splits are broadcast.
LEVELS, SAMPLE, BROADCAST_SPLITS = 7, 8192, 20_000
#: Classes that make a ball, and items that are looked at together for it.
CROWD, CHUNK = 64, 2048
#: Members of a ball that are compared at once.
BLOCK = 2048
RESULT = ("n_links", "component_id", "kept")
#: What rounding may add to an angle.
SLACK = 1e-6


def units(column: pa.Array) -> np.ndarray:
    """The vectors of one length as rows of length 1, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose vectors have one length."""
    sizes = pa.compute.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield batch if (sizes == n).all() else batch.take(pa.array(np.flatnonzero(sizes == n)))


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit rows of x and one unit vector, by the chord, which is exact for small ones."""
    return 2 * np.arcsin(np.minimum(1, np.sqrt(((x - y) ** 2).sum(axis=1)) / 2))


def directions(seed: int, count: int, length: int) -> np.ndarray:
    d = np.random.default_rng([seed, length]).standard_normal((length, count))
    return d / np.sqrt((d * d).sum(axis=0))


# balls


def _codes(seed: int, planes: int = 40):
    """Adds `_code`: the sides of random planes, those of the first plane first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_length(whole, "vec"):
                x = units(b.column("vec"))
                side = (x @ directions(seed, planes, x.shape[1])) > 0
                code = (side.astype(np.int64) << np.arange(planes)[::-1]).sum(axis=1) + (x.shape[1] << planes)
                yield b.append_column("_code", pa.array(code))

    return run


def balls_of(x: np.ndarray, rad: np.ndarray, crowd: int, reach: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Disjoint (items, centre, radius), each of `crowd` items at least, all within `reach` of the centre with their own radii."""
    near = (x.astype(np.float32) @ x.astype(np.float32).T) >= np.float32(np.cos(reach))
    count, free, out = near.sum(axis=1), np.ones(len(x), dtype=bool), []
    while len(x) and count.max() >= crowd:
        seed = int(count.argmax())
        got = np.flatnonzero(near[seed] & free)
        centre = x[got].sum(axis=0)
        centre /= np.sqrt(centre @ centre)
        far = angles(x, centre) + rad
        mine = np.flatnonzero((far <= reach - SLACK) & free)
        if len(mine) >= crowd:
            out.append((mine, centre, float(far[mine].max()) + SLACK))
        else:
            mine = np.array([seed])  # stays what it is
        free[mine] = False
        count = count - near[:, mine].sum(axis=1)
        count[~free] = 0
    return out


def _gather(crowd: int, reach: float, chunk: int):
    """Rows (item, vec, rad, size, _code) in order of _code to rows (item, ball, vec, rad): the ball, or null for what stays alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for b in table.to_batches():
                for part in by_length(b, "vec"):
                    items = part.column("item").to_numpy()
                    for mine, centre, rad in balls_of(units(part.column("vec")), part.column("rad").to_numpy(), crowd, reach):
                        n = len(mine)
                        yield pa.RecordBatch.from_arrays([pa.array(items[mine]), pa.array(np.full(n, items[mine].min())), lists(np.tile(centre, (n, 1))), pa.array(np.full(n, rad))], names=["item", "ball", "vec", "rad"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                take = min(batch.num_rows - lo, chunk - sum(b.num_rows for b in held))
                held.append(batch.slice(lo, take))
                lo += take
                if sum(b.num_rows for b in held) == chunk:
                    yield from out()
        if held:
            yield from out()

    return run


def find_balls(items: DataFrame, threshold: float, crowd: int = CROWD, chunk: int = CHUNK, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(items with balls in place of their members, (member, item) for members of balls). items: (item, vec, rad, size)."""
    spark, reach = items.sparkSession, float(np.arccos(threshold) / 2)
    double = "item bigint, ball bigint, vec array<double>, rad double"
    todo, member, least, singles = items, None, crowd, None
    count = -1
    for k in range(rounds):
        coded = todo.mapInArrow(_codes(k), T.StructType([*todo.schema.fields, T.StructField("_code", T.LongType())]))
        # the second key lets a hot code go to several parts
        dealt = coded.repartitionByRange(partitions(spark), "_code", F.xxhash64("item")).sortWithinPartitions("_code")
        found = materialize(dealt.mapInArrow(_gather(least, reach, chunk), double), f"balls-{k}")
        made = found.groupBy("ball").agg(F.first("vec").alias("vec"), F.first("rad").alias("rad"))
        into = found.select("item", "ball")
        if member is None:
            singles = items.join(into, "item", "left_anti")
            member = materialize(into.select(F.col("item").alias("member"), F.col("ball").alias("item")), f"members-{k}")
            balls = materialize(made.select(F.col("ball").alias("item"), "vec", "rad"), f"centres-{k}")
        else:
            # balls that haven't met another one stay
            moved = member.join(into, "item", "left").select("member", F.coalesce("ball", "item").alias("item"))
            member = materialize(moved, f"members-{k}")
            balls = materialize(todo.select("item", "vec", "rad").join(into, "item", "left_anti").unionByName(made.select(F.col("ball").alias("item"), "vec", "rad")), f"centres-{k}")
        todo, least = balls.withColumn("size", F.lit(1).cast("bigint")), 2
        before, count = count, balls.count()
        if count < 2 or count == before:
            break
    sizes = member.join(items.select(F.col("item").alias("member"), "size"), "member").groupBy("item").agg(F.sum("size").alias("size"))
    whole = balls.join(sizes, "item").select("item", "vec", "rad", "size")
    return singles.select("item", F.col("vec").cast("array<double>").alias("vec"), "rad", "size").unionByName(whole), member


# trees


def _thresholds(x: np.ndarray, tree: int, depth: int, levels: int, overlap: float, leaf: float) -> np.ndarray:
    """(low, high) of each node of a subtree fitted on x, in heap order; infinite where a node has `leaf` items or less and isn't split."""
    bounds = np.full((2 ** (levels + 1), 2), np.inf)
    inside = {1: np.arange(len(x))}
    for level in range(levels):
        p = x @ directions(1000 + tree * 1000 + depth + level, 1, x.shape[1])[:, 0]
        for node in range(2**level, 2 ** (level + 1)):
            own = inside.pop(node, None)
            if own is None or len(own) <= max(leaf, 8):
                continue
            low, high = np.quantile(p[own], [0.5 - overlap, 0.5 + overlap])
            bounds[node] = low, high
            inside[2 * node], inside[2 * node + 1] = own[p[own] <= high], own[p[own] >= low]
    return bounds


def _place(x: np.ndarray, spread: np.ndarray, bounds: np.ndarray, tree: int, depth: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) for every node of the subtree where a row ends. spread: how far a row reaches to either side."""
    row, node, ended = np.arange(len(x)), np.ones(len(x), dtype=np.int64), []
    for level in range(levels):
        low, high = bounds[node, 0], bounds[node, 1]
        stays = np.isinf(low)
        ended.append((row[stays], node[stays]))
        row, node, low, high = row[~stays], node[~stays], low[~stays], high[~stays]
        p = x[row] @ directions(1000 + tree * 1000 + depth + level, 1, x.shape[1])[:, 0]
        left, right = p - spread[row] <= high, p + spread[row] >= low
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    ended.append((row, node))
    return np.concatenate([r for r, _ in ended]), np.concatenate([n for _, n in ended])


def child_cell(cell: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The number of a node below a cell: 8 bits of tree and a hash of the way there; the cell itself where the node is its root."""
    way = (cell.astype(np.uint64) << np.uint64(8)) ^ (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    way ^= way >> np.uint64(29)
    way *= np.uint64(0xBF58476D1CE4E5B9)
    way ^= way >> np.uint64(32)
    tree = cell.astype(np.uint64) >> np.uint64(55)
    out = ((tree << np.uint64(55)) | (way & np.uint64((1 << 55) - 1))).astype(np.int64)
    return np.where(node == 1, cell, out)


def _route(splits: Callable[[pa.RecordBatch], dict], depth: int, levels: int):
    """Rows (item, vec, rad, size, cells, ...) to the same with the cells replaced by those below; splits: bounds by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_length(whole, "vec"):
                x = units(b.column("vec"))
                bounds = splits(b)
                # two standard deviations of where a ball's members lie along a random direction
                spread = 2 * b.column("rad").to_numpy() / np.sqrt(x.shape[1])
                cells = b.column("cells")
                row = np.repeat(np.arange(len(b)), pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False))
                flat = cells.flatten().to_numpy()
                rows, out = [], []
                order = np.argsort(flat, kind="stable")
                uniques, first = np.unique(flat[order], return_index=True)
                for cell, mine in zip(uniques.tolist(), np.split(order, first[1:]), strict=True):
                    if (own := bounds.get(cell)) is None:
                        rows.append(row[mine])
                        out.append(flat[mine])
                        continue
                    r, node = _place(x[row[mine]], spread[row[mine]], own, cell >> 55, depth, levels)
                    rows.append(row[mine][r])
                    out.append(child_cell(np.full(len(node), cell, dtype=np.int64), node))
                rows, out = np.concatenate(rows), np.concatenate(out)
                order = np.lexsort((out, rows))
                ends = np.cumsum(np.bincount(rows, minlength=len(b)))
                now = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out[order]))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("item", "vec", "rad", "size")], now], names=["item", "vec", "rad", "size", "cells"])

    return run


CELLS = "item bigint, vec array<double>, rad double, size bigint, cells array<bigint>"


def _fit(depth: int, levels: int, overlap: float, leaf_items: int, sample: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["vec"].to_numpy())
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        # leaves have leaf_items of all rows, of which the sample is a part
        bounds = _thresholds(x, int(key[0]) >> 55, depth, levels, overlap, leaf_items * len(x) / max(float(rows["n"].iloc[0]), 1.0))
        return pd.DataFrame({"cell": [key[0]], "bounds": [bounds.reshape(-1)]})

    return run


def plant(items: DataFrame, trees: int = TREES, leaf_items: int = LEAF_ITEMS, overlap: float = OVERLAP, levels: int = LEVELS, sample: int = SAMPLE, broadcast_splits: int = BROADCAST_SPLITS, rounds: int = 12) -> DataFrame:
    """items (item, vec, rad, size) with `cells`, the leaves of each in all trees."""
    spark = items.sparkSession
    # a root for each tree and length of vectors
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.shiftleft(t.cast("bigint"), 55) + F.size("vec"))
    now = materialize(items.select("item", F.col("vec").cast("array<double>").alias("vec"), "rad", "size", roots.alias("cells")), "forest-0")
    settled = None
    for k in range(rounds):
        depth = k * levels
        counts = now.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
        large = counts.where(F.col("n") > leaf_items)
        if settled is not None:  # a cell that didn't split is as good as a leaf
            large = large.join(settled, "cell", "left_anti")
        large = materialize(large, f"forest-large-{k}")
        nodes = large.count()
        if not nodes:
            break
        # a sample of each large cell, by a hash of the item
        each = now.select(F.explode("cells").alias("cell"), "item", "vec")
        picked = join_counted(each, large, ["cell"], "n").where(F.pmod(F.xxhash64("item", F.lit(k)), F.lit(1 << 30)) < F.lit(float(sample) * (1 << 30)) / F.col("n"))
        fitted = materialize(picked.groupBy("cell").applyInPandas(_fit(depth, levels, overlap, leaf_items, sample), "cell bigint, bounds array<double>"), f"forest-splits-{k}")
        if nodes <= broadcast_splits:
            table = spark.sparkContext.broadcast({r.cell: np.array(r.bounds).reshape(-1, 2) for r in fitted.toLocalIterator()})
            after = now.mapInArrow(_route(_from_broadcast(table), depth, levels), CELLS)
        else:
            spread = now.select("item", "vec", "rad", "size", F.explode("cells").alias("cell"))
            there = join_counted(spread, fitted.join(large, "cell"), ["cell"], "n").withColumn("cells", F.array("cell"))
            routed = there.select("item", "vec", "rad", "size", "cells", "bounds").mapInArrow(_route(_from_rows, depth, levels), CELLS)
            stayed = spread.join(F.broadcast(large.select("cell")) if nodes < 100_000 else large.select("cell"), "cell", "left_anti").select("item", "vec", "rad", "size", F.array("cell").alias("cells"))
            after = routed.unionByName(stayed).groupBy("item").agg(F.first("vec").alias("vec"), F.first("rad").alias("rad"), F.first("size").alias("size"), F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
        after = materialize(after, f"forest-{k + 1}")
        settled = large.select("cell") if settled is None else settled.unionByName(large.select("cell"))
        discard(now)
        now = after
    return now


def _from_broadcast(table):
    return lambda batch: table.value


def _from_rows(batch: pa.RecordBatch) -> dict:
    cells = batch.column("cells").flatten().to_pylist()
    column = batch.column("bounds")
    return {c: np.array(column[k].as_py()).reshape(-1, 2) for k, c in enumerate(cells) if cells.index(c) == k}


# comparison


def spanning(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches through a symmetric boolean matrix."""
    label = np.arange(len(near))
    while len(near):
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    return label


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have that cosine. Only what single precision leaves open is computed in double."""
    c = x.astype(np.float32) @ y.astype(np.float32).T
    out = c >= np.float32(threshold)
    for i, j in _chunks(*np.nonzero(np.abs(c - np.float32(threshold)) < 1e-5)):
        out[i, j] = (x[i] * y[j]).sum(axis=1) >= threshold
    return out


def _chunks(i: np.ndarray, j: np.ndarray, n: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, len(i), n):
        yield i[lo : lo + n], j[lo : lo + n]


def _earlier(cells: list[np.ndarray], cell: int) -> np.ndarray:
    """Which pairs of rows share a leaf with a smaller number than this one."""
    before = [c[c < cell] for c in cells]
    numbers, at = np.unique(np.concatenate(before), return_inverse=True) if before else (np.zeros(0), np.zeros(0, np.int64))
    there = np.zeros((len(cells), max(len(numbers), 1)), dtype=np.float32)
    there[np.repeat(np.arange(len(cells)), [len(c) for c in before]), at] = 1
    there = there[:, there.sum(axis=0) > 1]
    return there @ there.T > 0


def _compare(threshold: float):
    limit = float(np.arccos(threshold))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = units(table.column("vec"))
        rad, size, item = (table.column(c).to_numpy() for c in ("rad", "size", "item"))
        near = linked(x, x, threshold)
        np.fill_diagonal(near, False)
        openly = np.zeros_like(near)
        for k in np.flatnonzero(rad > 0):  # balls: certain, open or out of reach
            theta, reach = angles(x, x[k]), rad + rad[k]
            sure, may = theta + reach <= limit - SLACK, theta - reach <= limit + SLACK
            near[k], openly[k] = sure, may & ~sure
            near[:, k], openly[:, k] = near[k], openly[k]
        np.fill_diagonal(near, False)
        np.fill_diagonal(openly, False)
        some = np.flatnonzero((near | openly).any(axis=1))
        out: dict[str, list] = {"a": [], "b": [], "n": [], "open": []}
        if len(some):
            near, openly, item, size = near[np.ix_(some, some)], openly[np.ix_(some, some)], item[some], size[some]
            cells = table.column("cells").take(pa.array(some)).combine_chunks()
            first = ~_earlier([np.asarray(c.values) for c in cells], key[0].as_py())
            near &= first
            order = np.argsort(item)
            label = spanning(near[np.ix_(order, order)])
            root = np.empty_like(item)
            root[order] = item[order][label]
            count = near.astype(np.float64) @ size
            hit = count > 0
            i, j = np.nonzero(np.triu(openly & first))
            out = {"a": np.concatenate([item[hit], item[i]]), "b": np.concatenate([root[hit], item[j]]), "n": np.concatenate([count[hit].astype(np.int64), np.zeros(len(i), np.int64)]), "open": np.concatenate([np.zeros(hit.sum(), bool), np.ones(len(i), bool)])}
        return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "open": pa.array(out["open"], pa.bool_())})

    return run


def _members(threshold: float):
    """Rows of two blocks of different items to their links: (a, b, cls, n) with cls null for the items' own link."""

    def run(table: pa.Table) -> pa.Table:
        x, side = units(table.column("vec")), table.column("side").to_numpy(zero_copy_only=False)
        cls, item, size = (table.column(c).to_numpy() for c in ("cls", "item", "size"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows: list[tuple] = []
        if len(left) and len(right):
            near = linked(x[left], x[right], threshold)
            if near.any():
                rows.append((item[left[0]], item[right[0]], None, 0))
                for mine, count in ((left, near.astype(np.float64) @ size[right]), (right, near.T.astype(np.float64) @ size[left])):
                    rows += [(item[k], item[k], cls[k], int(n)) for k, n in zip(mine, count, strict=True) if n]
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a", "b", "cls", "n"])

    return run


def near_duplicates(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, trees: int = TREES, leaf_items: int = LEAF_ITEMS, overlap: float = OVERLAP, crowd: int = CROWD, chunk: int = CHUNK, block: int = BLOCK, **forest: int) -> DataFrame:
    """vectors with n_links (other vectors linked directly), component_id (the smallest id reachable by links) and kept (the id is that one)."""
    spark = vectors.sparkSession
    ship(spark)
    rest = without(vectors, list(RESULT))
    names = rest.columns
    v, own = (F.col(f"c{names.index(c)}") for c in (vec_col, id_col))
    kind = rest.schema[vec_col].dataType.elementType
    wide = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: F.coalesce((F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e.cast("double")), F.lit(False))) & F.exists(v, lambda e: e != 0), F.lit(False))
    plain = rest.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("vec", F.when(fine, v.cast(wide)))
    classes = plain.where("vec is not null").groupBy("vec").agg(F.min(own).alias("least"), F.count("*").alias("size"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    items, member = find_balls(classes.select(F.col("cls").alias("item"), "vec", F.lit(0.0).alias("rad"), "size"), threshold, crowd, chunk)
    leaves = plant(items, trees, leaf_items, overlap, **forest)
    each = leaves.withColumn("cell", F.explode("cells"))
    found = materialize(each.groupBy("cell").applyInArrow(_compare(threshold), "a bigint, b bigint, n bigint, open boolean"), "links")
    # the item of every class
    of_class = materialize(classes.select("cls", "vec", "size").join(member.select(F.col("member").alias("cls"), "item"), "cls", "left").withColumn("item", F.coalesce("item", "cls")), "classes")
    between = materialize(_between(found.where("open"), of_class, threshold, block), "between")
    links = found.where("not open").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("n"))
    more = between.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("more"))
    sizes = leaves.select("item", F.col("size").alias("whole"))
    edges = found.where("not open and a <> b").select("a", "b").unionByName(between.where("cls is null").select("a", "b"))
    comps = connected_components(edges).withColumnsRenamed({"node": "item"})
    facts = sizes.join(links, "item", "left").join(comps, "item", "left").withColumn("component", F.coalesce("component", "item"))
    of_item = join_counted(of_class.drop("vec", "size"), materialize(facts.withColumn("n", F.coalesce("n", F.lit(0)) + F.col("whole") - 1), "items"), ["item"], "whole")
    counted = materialize(of_item.join(more, "cls", "left").select("cls", "component", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links")).join(classes.select("cls", "least", "vec", "size"), "cls"), "counted")
    least = counted.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = materialize(join_counted(counted, least, ["component"], "n").select("vec", "n_links", "component_id", "size"), "known")
    told = join_counted(plain.where("vec is not null"), known, ["vec"], "size")
    alone = plain.where("vec is null").withColumns({"n_links": F.lit(0).cast("bigint"), "component_id": own})
    kept = F.coalesce(own == F.col("component_id"), own.isNull() & F.col("component_id").isNull()).alias("kept")
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    both = told.drop("size").unionByName(alone)
    return both.select(*back, F.col("n_links").cast("bigint").alias("n_links"), "component_id", kept)


def _between(open_pairs: DataFrame, of_class: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, cls, n) for pairs of items whose members have to be compared: cls and the size of what it links with, or null for a link of the items."""
    blocks = of_class.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(1 << 20)))
    counts = of_class.groupBy("item").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    pairs = open_pairs.select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("item").alias(side), F.col("blocks").alias(f"{side}_n")), side)
    deals = materialize(pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b_n") - 1))).withColumn("deal", F.monotonically_increasing_id()), "deals")
    sides = []
    for k, (side, at) in enumerate((("a", "i"), ("b", "j"))):
        wanted = deals.select(F.col(side).alias("item"), F.col(at).alias("at"), "deal")
        rows = blocks.join(counts.select("item", "blocks"), "item").withColumn("at", F.pmod("block", F.col("blocks")).cast("int"))
        sides.append(rows.join(wanted, ["item", "at"]).select("deal", F.lit(k).alias("side"), "item", "cls", "size", "vec"))
    return sides[0].unionByName(sides[1]).groupBy("deal").applyInArrow(_members(threshold), "a bigint, b bigint, cls bigint, n bigint")
