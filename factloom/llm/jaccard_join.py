"""N-gram Jaccard self-join with signature trees, as components of linked documents.

1. Every text becomes the set of its hashed word shingles. Documents of equal sets form one class.
   A count sketch over all shingles marks those that very many documents share.
2. Dealing: the universe of shingles is cut into partitions so that two sets of similarity t or more
   agree on a whole partition that isn't empty. Tasks send the hashes of their sets' partitions as packed
   blocks to buckets, which connect the documents that share one. These parts only say which
   sets must meet in one task.
3. Each task puts the sets of its parts, up to `tree_shingles` at once, into one signature tree over sets ordered by
   size class: nodes hold OR-combined bitmaps of their sets and size ranges; a dual traversal drops node
   pairs whose largest possible overlap is too small or whose documents are all in one component
   already; surviving pairs are verified on whole sets.
4. A part beyond `part_shingles`, or of over `part_sets` sets, is cut into blocks. First every block meets one of them, in linear work,
   which settles a group of near copies; the documents outside the part's largest component then
   meet all blocks. No pair is left out and no task holds more than two blocks.

Shingles are 64-bit hashes of the words' bytes. No pair is left out by steps 2 to 4; a size or a link differs from the words' own only
where two different shingles within one pair of documents agree by chance, n * n / 2^65 for n shingles.

Defined results: null or empty text gives an empty set, which links with nothing; fewer words than
the shingle length make one shingle of the whole sequence; rows with equal ids count as one document
in the links; a row with null id links with nothing and has a null component; an empty table gives
no rows; other input columns are not carried.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.components import EDGE, Union, connected_components, edge_batch, join_counted
from factloom.session import discard, materialize, partitions, release, ship

SHINGLE = 5
#: Bytes that a map task gathers before it sends blocks, and signatures that a bucket is planned for.
FLUSH, BUCKET = 6 << 20, 1_000_000
#: Buckets at least; classes of copies that are broadcast at most (16 bytes each).
BUCKETS, COPIED = 64, 500_000
K1, K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row."""
    for lo, hi, offsets, data in words.groups(column):
        starts, ends, first = words.spans(offsets, data)
        h = words.hashes(data, starts, ends, lower=True)
        whole = np.zeros(0, np.uint64)
        if len(h) >= length:
            whole = h[: len(h) - length + 1].copy()
            for k in range(1, length):
                whole = whole * K1 + h[k : len(h) - length + 1 + k]
            whole = words.mix(whole)
        for row in range(lo, hi):
            a, b = first[row - lo], first[row - lo + 1]
            if b - a >= length:
                yield row, np.unique(whole[a : b - length + 1])
            elif b > a:
                x = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in h[a:b]:
                        x = x * K2 + w
                yield row, words.mix(np.array([x], dtype=np.uint64))
            else:
                yield row, np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    hi, lo = words.mix(s + K1).sum(dtype=np.uint64), words.mix(s ^ K2).sum(dtype=np.uint64)
    return int(hi.astype(np.int64)), int(lo.astype(np.int64))


def needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any set of similarity num / den."""
    return -(-num * n // den)


# ---- 1. sets, classes and the sketch

BLOCK = 1 << 16
SCANNED = "id bigint, n bigint, hi bigint, lo bigint, block int, counts binary"


def _scan(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            ids, out, parts, size = batch.column(0), ([], [], [], []), [], 0
            for row, s in shingle_sets(batch.column(1), length):
                hi, lo = fingerprint(s)
                for column, x in zip(out, (ids[row].as_py(), len(s), hi, lo), strict=True):
                    column.append(x)
                parts.append((s & np.uint64((1 << bits) - 1)).astype(np.int64))
                size += len(s)
                if size > 1 << 20:
                    sketch += np.bincount(np.concatenate(parts), minlength=1 << bits).astype(np.uint32)
                    parts, size = [], 0
            if parts:
                sketch += np.bincount(np.concatenate(parts), minlength=1 << bits).astype(np.uint32)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["id", "n", "hi", "lo", "block", "counts"])
        for k in range(0, 1 << bits, BLOCK):
            if (part := sketch[k : k + BLOCK]).any():
                one = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*one, pa.array([k // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["id", "n", "hi", "lo", "block", "counts"])

    return run


def _sum_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block."""
        current, total = None, None

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(total > threshold, bitorder="little").tobytes()], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != current:
                    if current is not None:
                        yield bits()
                    current, total = block, np.zeros(BLOCK, dtype=np.uint64)
                total += np.frombuffer(counts.as_buffer(), dtype=np.uint32)
        if current is not None:
            yield bits()

    return run


# ---- 2. candidates by partition signatures


def size_class(n: int, bounds: list[int]) -> int:
    """The class c with bounds[c] <= n < bounds[c + 1]; bounds grow by half."""
    while bounds[-1] <= n:
        bounds.append(max(bounds[-1] + 1, -(-3 * bounds[-1] // 2)))
    return bisect.bisect_right(bounds, n) - 1


def density(num: int, den: int) -> float:
    """Tokens a partition, so that random sets of n have over n (den - num) / num partitions with two tokens or more."""
    x = 8.0
    while x > 0.5 and (1 - math.exp(-x) * (1 + x)) / x <= 1.07 * (den - num) / num:
        x -= 0.05
    return x


def signatures(s: np.ndarray, common: np.ndarray, bounds: list[int], per: float, num: int, den: int) -> np.ndarray:
    """Hashes of which sets of similarity num / den or more share one.

    The universe of tokens is cut into partitions, the same for all sets of a size class. Two such sets differ
    by at most d = n (den - num) / num tokens, n being the smaller size, so of more than d partitions of
    any kind in one set one is equal in both. Partitions of two rare tokens or more come first, as they seldom agree
    by chance; only a set with too few of them sends those of one rare token, then those of common
    tokens, and one with still too few its plain prefix. Kinds are added in the same order by every
    set, so two sets agree on a kind that both send.
    A set sends to its own size class, and to the next if a similar set may lie there.
    """
    n, out = len(s), []
    c = size_class(n, bounds)
    rare, often = s[~common], s[common]
    for k in (c, c + 1):
        if k > c and den * n < num * bounds[k]:
            break
        size_class(bounds[k], bounds)
        cells = np.uint64(max(1, math.ceil(bounds[k + 1] / per)))
        found = 0
        for late, part in ((0, rare), (1, often)):
            if len(part) and num * found <= (den - num) * n:
                # hashes are sorted, and so are the partitions they fall in
                cell = ((part >> np.uint64(32)) * cells) >> np.uint64(32)
                first = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
                several = np.diff([*first, len(part)]) > 1
                sig = np.add.reduceat(words.mix(part ^ K1), first) + np.uint64(int(K2) * (2 * k + late) % (1 << 64))
                for kind in (sig[several], sig[~several]):
                    if num * found <= (den - num) * n:
                        out.append(kind)
                        found += len(kind)
        if num * found <= (den - num) * n:
            out.append(s[: n - needed(n, num, den) + 1])
    return words.mix(np.concatenate(out))


SENT = "bucket int, block binary"


def _encode(ids: np.ndarray, row: np.ndarray, sig: np.ndarray) -> bytes:
    """Ids once with their counts, then 40 bits of each signature; a chance agreement of those only adds a candidate."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    counts = np.diff([*first, len(row)]).astype("<u4")
    return b"".join([np.array([len(first), len(sig)], dtype="<u8").tobytes(), ids[row[first]].astype("<i8").tobytes(), counts.tobytes(), (sig & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((sig >> np.uint64(32)) & np.uint64(0xFF)).astype("u1").tobytes()])


def _decode(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, n = (int(x) for x in np.frombuffer(block, dtype="<u8", count=2))
    ids, at = np.frombuffer(block, dtype="<i8", count=rows, offset=16), 16 + 8 * rows
    counts = np.frombuffer(block, dtype="<u4", count=rows, offset=at)
    low = np.frombuffer(block, dtype="<u4", count=n, offset=at + 4 * rows)
    high = np.frombuffer(block, dtype="u1", count=n, offset=at + 4 * rows + 4 * n)
    return np.repeat(ids, counts), low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _send(length: int, bits: int, flags, copied, buckets: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bounds, per = flags.value, [1], density(num, den)
        classes, least = copied.value
        kept, rows, ids, size, seen = [], [], [], 0, set()

        def blocks() -> pa.RecordBatch:
            sig, row, own = np.concatenate(kept), np.repeat(np.arange(len(kept)), rows), np.array(ids, dtype=np.int64)
            to = (sig >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            sig, row, to = sig[order], row[order], to[order]
            edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(sig)]
            cuts = list(zip(edges, edges[1:], strict=False))
            return pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in cuts], pa.int32()), pa.array([_encode(own, row[a:b], sig[a:b]) for a, b in cuts], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            keys = batch.column(0)
            for row, s in shingle_sets(batch.column(1), length):
                key = keys[row].as_py()
                if key is None or not len(s):
                    continue
                own = fingerprint(s)
                if own in seen:  # the class is represented already
                    continue
                if len(classes) and classes[c := min(int(np.searchsorted(classes, own[0])), len(classes) - 1)] == own[0] and least[c] != key:
                    continue
                if len(seen) < 500_000:
                    seen.add(own)
                at = s & np.uint64((1 << bits) - 1)
                common = ((marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                sig = signatures(s, common, bounds, per, num, den)
                kept.append(sig)
                rows.append(len(sig))
                ids.append(key)
                size += 16 * len(sig)
                if size > FLUSH:
                    yield blocks()
                    kept, rows, ids, size = [], [], [], 0
        if kept:
            yield blocks()

    return run


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from every document to the least that shares a signature. Blocks come sorted by bucket."""

    def edges(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        both = [_decode(x) for x in parts]
        ids, sig = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        order = np.argsort(sig, kind="stable")
        ids, sig = ids[order], sig[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        ids, sig = ids[shared], sig[shared]
        if not len(ids):
            return
        first = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1])
        hub = np.repeat(np.minimum.reduceat(ids, first), np.diff([*first, len(ids)]))
        pairs = np.unique(np.stack([ids, hub], axis=1)[ids != hub], axis=0)
        for lo in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + 100_000, 0]), pa.array(pairs[lo : lo + 100_000, 1])], names=["a", "b"])

    current, parts = None, []
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != current:
                if parts:
                    yield from edges(parts)
                current, parts = bucket, []
            parts.append(block.as_py())
    if parts:
        yield from edges(parts)


# ---- 3. signature trees

LEAF, FAN = 4, 8


class Tree:
    """Levels of nodes over items; an item is a set, a node the OR of bitmaps and the size range below."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], bits: int) -> None:
        # by size class, and near copies stand close within one: they mostly share their least hash
        order = sorted(range(len(sets)), key=lambda i: (int(math.log2(len(sets[i])) / math.log2(1.25)), sets[i][0], len(sets[i]), nodes[i]))
        self.nodes, self.sets = [nodes[i] for i in order], [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)
        maps = np.zeros((len(order), bits // 8), dtype=np.uint8)
        for k, s in enumerate(self.sets):
            at = (s >> np.uint64(7)).astype(np.int64) & (bits - 1)
            np.bitwise_or.at(maps[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        extra = self.n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, extra, self.n, self.n)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            m, e, lo, hi = self.levels[-1]
            at = np.arange(0, len(m), step)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.maximum.reduceat(e, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
            step = FAN
        self.labels: list[np.ndarray] = []
        #: Pairs of nodes that a traversal has looked at, dropped above the items, and verified on sets.
        self.seen = self.pruned = self.verified = 0

    def label(self, sets: Union) -> None:
        """For each node the component of all items below it, or -1 where they are in several."""
        own = np.array([sets.find(x) for x in self.nodes], dtype=np.int64)
        self.mixed = [np.zeros(len(own), dtype=bool)]
        self.labels = [own]
        step = LEAF
        for _ in self.levels[1:]:
            at = np.arange(0, len(self.labels[-1]), step)
            lo, hi = np.minimum.reduceat(self.labels[-1], at), np.maximum.reduceat(self.labels[-1], at)
            self.mixed.append((lo != hi) | np.logical_or.reduceat(self.mixed[-1], at))
            self.labels.append(lo)
            step = FAN


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _meet(x: Tree, y: Tree, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of nodes (one row each) of which some pair of items below may be similar."""
    ma, ea, la, ha = x.levels[level]
    mb, eb, lb, hb = y.levels[level]
    # different components and fitting sizes
    keep = (x.mixed[level][a] | y.mixed[level][b] | (x.labels[level][a] != y.labels[level][b])) & (den * ha[a] >= num * lb[b]) & (den * hb[b] >= num * la[a])
    a, b = a[keep], b[keep]
    # the largest possible overlap: shared bits, and the elements that share bits within their own set
    shared = np.empty(len(a), dtype=np.int64)
    step = max(1, MEET_BYTES // (8 * ma.shape[1]))  # long bitmaps are met a few at a time
    for k in range(0, len(a), step):
        shared[k : k + step] = np.bitwise_count(ma[a[k : k + step]] & mb[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    most = shared + np.minimum(ea[a], eb[b])
    most = np.minimum(most, np.minimum(ha[a], hb[b]))
    ok = (num + den) * most >= num * (la[a] + lb[b])
    return np.stack([a[ok], b[ok]], axis=1)


PAIRS_AT_ONCE = 1 << 14
#: Bytes of bitmaps met at once.
MEET_BYTES = 4 << 20


def dual_join(x: Tree, y: Tree, sets: Union, num: int, den: int) -> None:
    """Unite the nodes of similar items of x and y; both trees must have equal numbers of levels."""
    same = x is y
    height = min(len(x.levels), len(y.levels)) - 1
    tops = [(i, j) for i in range(len(x.levels[height][0])) for j in range(len(y.levels[height][0])) if not same or i <= j]
    stack = [(height, np.array(tops, dtype=np.int64).reshape(-1, 2))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > PAIRS_AT_ONCE:
            stack += [(level, pairs[PAIRS_AT_ONCE:]), (level, pairs[:PAIRS_AT_ONCE])]
            continue
        looked = len(pairs)
        pairs = _meet(x, y, level, pairs[:, 0], pairs[:, 1], num, den)
        x.seen += looked
        if level:
            x.pruned += looked - len(pairs)
        else:
            x.verified += len(pairs)
        if not len(pairs):
            continue
        if level == 0:
            for i, j in pairs.tolist():
                if (not same or i != j) and sets.find(x.nodes[i]) != sets.find(y.nodes[j]) and similar(x.sets[i], y.sets[j], num, den):
                    sets.join(x.nodes[i], y.nodes[j])
            x.label(sets)
            y.label(sets)
            continue
        step = LEAF if level == 1 else FAN
        grid = np.stack(np.meshgrid(np.arange(step), np.arange(step), indexing="ij"), axis=-1).reshape(-1, 2)
        below = (pairs[:, None, :] * step + grid[None, :, :]).reshape(-1, 2)
        below = below[(below[:, 0] < len(x.levels[level - 1][0])) & (below[:, 1] < len(y.levels[level - 1][0]))]
        if same:
            below = below[below[:, 0] <= below[:, 1]]
        stack.append((level - 1, below))


def bitmap_bits(sizes: list[int]) -> int:
    typical = int(np.median(sizes))
    return 1 << min(16, max(8, (16 * typical - 1).bit_length()))


def join_items(items: list[tuple[int, np.ndarray]], sets: Union, num: int, den: int) -> Tree:
    """Unite similar items by a tree over them. Its neighbours come first, so that nodes of near copies soon hold one component."""
    tree = Tree([a for a, _ in items], [s for _, s in items], bitmap_bits([len(s) for _, s in items]))
    for k in range(1, len(tree.nodes)):
        if sets.find(tree.nodes[k - 1]) != sets.find(tree.nodes[k]) and similar(tree.sets[k - 1], tree.sets[k], num, den):
            sets.join(tree.nodes[k - 1], tree.nodes[k])
    tree.label(sets)
    dual_join(tree, tree, sets, num, den)
    return tree


#: Blocks that a part is cut into for its number of sets.
SPREAD = 64
#: Sets that one tree of several parts holds at most; a single part's tree may hold more.
TREE_SETS = 2048


def _join_parts(length: int, num: int, den: int, tree_shingles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part and task. side 0 meets itself and 1; 1 meets 0 only. Parts of side 0 alone share trees."""
        current, left, right, labels = None, [], [], []
        waiting, known, size = [], [], 0  # items and labels of whole parts

        def united(pairs: list) -> Union:
            sets = Union()
            for node, label in pairs:  # what earlier steps have united
                if label is not None:
                    sets.join(node, label)
            return sets

        def edges(nodes: set[int], sets: Union) -> pa.RecordBatch:
            return edge_batch([(a, r) for a in nodes if (r := sets.find(a)) != a])

        def one_tree() -> pa.RecordBatch:
            sets = united(known)
            join_items(waiting, sets, num, den)
            return edges({a for a, _ in waiting}, sets)

        def two_trees() -> pa.RecordBatch:
            sets = united(labels)
            bits = bitmap_bits([len(s) for _, s in left + right])
            x, y = (Tree([a for a, _ in z], [s for _, s in z], bits) for z in (left, right))
            x.label(sets)
            y.label(sets)
            dual_join(x, x, sets, num, den)
            y.label(sets)
            dual_join(x, y, sets, num, den)
            return edges({a for a, _ in left} | {a for a, _ in right}, sets)

        def part_done() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, known, size
            if right:
                if left:
                    yield two_trees()
                return
            own = sum(len(s) for _, s in left)
            if waiting and (size + own > tree_shingles or len(waiting) + len(left) > TREE_SETS):
                yield one_tree()
                waiting, known, size = [], [], 0
            waiting, known, size = waiting + left, known + labels, size + own

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for row, s in shingle_sets(batch.column(5), length):
                part, task, side, node, label = keys[row]
                if (part, task) != current:
                    yield from part_done()
                    current, left, right, labels = (part, task), [], [], []
                if len(s):
                    (right if side else left).append((node, s))
                    labels.append((node, label))
        yield from part_done()
        if waiting:
            yield one_tree()

    return run


def _run_parts(rows: DataFrame, length: int, num: int, den: int, name: str, tree_shingles: int = 1_000_000) -> DataFrame:
    dealt = rows.select("part", "task", "side", "id", "label", "text").repartition(4 * partitions(rows.sparkSession), "part", "task").sortWithinPartitions("part", "task")
    out = materialize(dealt.mapInArrow(_join_parts(length, num, den, tree_shingles), EDGE), name)
    release(rows.sparkSession)
    return out


# ---- the operator


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, num: int = 4, den: int = 5, part_shingles: int = 4_000_000, tree_shingles: int = 1_000_000, part_sets: int = 256) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of docs; similarity num / den or more links."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # the sketch's size follows the rows up to 2^24 counters; it only tells which partitions a token may use
    bits = min(24, max(18, (16 * texts.select("id").count()).bit_length()))
    scanned = materialize(texts.mapInArrow(_scan(length, bits), SCANNED), "join-scan")
    rows = scanned.where("block is null").select("id", "n", "hi", "lo")
    classes = materialize(rows.where("n > 0 and id is not null").groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "join-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    occurrences = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mean = occurrences / (1 << bits)
    threshold = mean + 6 * mean**0.5 + 48
    flags = np.zeros((1 << bits) // 8, dtype=np.uint8)
    blocks = scanned.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    for r in blocks.mapInArrow(_sum_blocks(threshold), "block int, counts binary").collect():  # a bit for each counter: 2 MB at most
        flags[r[0] * BLOCK // 8 : (r[0] + 1) * BLOCK // 8] = np.frombuffer(r[1], dtype=np.uint8)
    common = spark.sparkContext.broadcast(flags)
    buckets = int(max(BUCKETS, partitions(spark), -(-total // (2 * BUCKET))))  # about half a signature a token
    # which document stands for a class of copies: told to the tasks if the list is small, else all copies send
    multi = classes.where("rows > 1").groupBy("hi").agg(F.min("rep").alias("rep"), F.count("*").alias("c")).where("c = 1").orderBy("hi")
    told = multi.select("hi", "rep").collect() if multi.count() <= COPIED else []
    copied = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in told], dtype=np.int64) for k in (0, 1)))
    sent = texts.mapInArrow(_send(length, bits, common, copied, buckets, num, den), SENT)
    near = materialize(sent.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_connect, EDGE), "join-near")
    release(spark)

    # candidates between classes; copies hang together already
    members = rows.where("n > 0 and id is not null")
    several = classes.where("rows > 1").select("hi", "lo", "n", "rep", "rows")
    copies = join_counted(members, several, ["hi", "lo", "n"], "rows").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    weak = connected_components(near.unionByName(copies))
    sizes = classes.select(F.col("rep").alias("node"), "n")
    weak = materialize(weak.join(sizes.groupBy("node").agg(F.sum("n").alias("n")), "node"), "join-weak")
    per_part = weak.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    # many sets are spread over up to SPREAD blocks so that no task has much more than others; more blocks only by shingles, as blocks meet blocks
    spread = F.least(F.ceil(F.col("sets") / part_sets), F.lit(SPREAD))
    sized = per_part.withColumn("_blocks", F.greatest(F.ceil(F.col("total") / part_shingles), spread).cast("bigint"))
    giants = materialize(sized.where("_blocks > 1").select("component", F.col("_blocks") + 1, F.col("sets").alias("_sets")).toDF("component", "_blocks", "_sets"), "join-giants")
    member = join_counted(weak, giants, ["component"], "_sets").select("node", "component", "_blocks").unionByName(weak.join(giants.select("component"), "component", "left_anti").select("node", "component", F.lit(None).cast("bigint").alias("_blocks")))
    # a table of the candidates' texts only
    candidates = texts.join(member.select(F.col("node").alias("id"), F.col("component").alias("part"), "_blocks"), "id").withColumn("label", F.lit(None).cast("bigint"))
    if giants.isEmpty():
        small = candidates.withColumns({"task": F.lit(0).cast("bigint"), "side": F.lit(0)})
        links = _run_parts(small, length, num, den, "join-links", tree_shingles)
    else:
        candidates = materialize(candidates, "join-candidates")
        small = candidates.where("_blocks is null").withColumns({"task": F.lit(0).cast("bigint"), "side": F.lit(0)})
        links = _run_parts(small, length, num, den, "join-links", tree_shingles).unionByName(_giant_links(candidates.where("_blocks is not null"), part_shingles, length, num, den))
    final = connected_components(links)
    named = materialize(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "n", "rows", F.coalesce("component", "rep").alias("_component")), "join-named")
    discard(near)
    linked = join_counted(members, named, ["hi", "lo", "n"], "rows").select("id", "n", "_component")
    out = linked.unionByName(rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("_component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_component").cast("bigint").alias("component_id"))


def _giant_links(rows: DataFrame, part_shingles: int, length: int, num: int, den: int) -> DataFrame:
    """Parts of several blocks, block by block."""
    spark = rows.sparkSession
    blocked = rows.withColumnRenamed("_blocks", "blocks").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # every block meets itself and block 0
    zero = blocked.where("block = 0").withColumn("task", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    own = blocked.where("block > 0").withColumn("task", F.col("block")).withColumn("side", F.lit(0))
    first = _run_parts(zero.unionByName(own), length, num, den, "join-giant-first")
    labels = connected_components(first).withColumnsRenamed({"node": "id", "component": "_label"})
    named = materialize(blocked.join(labels, "id", "left").withColumn("label", F.coalesce("_label", "id")).drop("_label"), "join-giant-labels")
    # the largest component of each part needs no more joins within itself
    counts = named.groupBy("part", "label").agg(F.count("*").alias("c"))
    largest = materialize(counts.groupBy("part").agg(F.max_by("label", F.struct("c", "label")).alias("_largest"), F.sum("c").alias("_rows")), "join-giant-largest")
    split = materialize(join_counted(named, largest, ["part"], "_rows").drop("_rows"), "join-giant-split")
    discard(named)
    others = split.where("label <> _largest")
    if others.isEmpty():
        return first
    sized = others.groupBy("part").agg(F.count("*").alias("_others"), F.sum(F.length("text")).alias("_chars"))
    sized = materialize(sized.withColumn("groups", F.ceil(F.col("_chars") / (8 * part_shingles)).cast("bigint") + 1).drop("_chars"), "join-giant-sized")
    others = join_counted(others, sized, ["part"], "_others").drop("_others").withColumn("group", F.pmod(F.xxhash64("id", F.lit("other")), F.col("groups")))
    per_part = sized.join(largest.select("part", "_rows"), "part").select("part", "groups", "_rows")
    # task = group of others * blocks + block; a document is on either side at most once for each task
    left = others.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: F.col("group") * F.col("blocks") + b))).withColumn("side", F.lit(0))
    right = join_counted(split, per_part, ["part"], "_rows").withColumn("task", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1), lambda g: g * F.col("blocks") + F.col("block")))).withColumn("side", F.lit(1))
    cols = ["part", "task", "side", "id", "label", "text"]
    second = _run_parts(left.select(cols).unionByName(right.select(cols)), length, num, den, "join-giant-second")
    return first.unionByName(second)
