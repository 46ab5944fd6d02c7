"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow from
patterns to sources routes each pattern's token capacity to the sources' quotas; repetition is
charged convexly, each further copy of a pattern's tokens costs more than the one before, so single
copies are used up everywhere before any document repeats. The flow is solved on the driver over
patterns and sources only (at most `max_patterns`, which is checked); everything per document stays
in Spark. Selection draws documents in the order of a seeded hash: histograms over its leading bits
find the place where a pattern's taken tokens reach the flow, again on further bits until the
bucket there is small, and that bucket is filled with the documents that still fit; while a
remainder is left the same goes on with the later documents that aren't larger.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; a reserved mark keeps it apart from any name. Rows that share id, text and
sources are decided together; of a null id the text alone counts. An empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import words
from factloom.session import materialize, ship, without

WEIGHTS = (3, 1, 2)
OUTPUT = ["size", "source_size", "target", "copies", "taken"]
#: Bits of the draw that a histogram tells apart; the documents among which a remainder is filled at once.
BITS, SMALL = 10, 2000


@F.arrow_udf(T.LongType())
def words_in(texts: pa.Array) -> pa.Array:
    """The number of maximal runs of other characters than blank, tab and line breaks; null has none."""
    counts = [np.diff(words.spans(offsets, data)[2]) for _, _, offsets, data in words.groups(texts)]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes by weight; no target above most times its source's size, the excess shared again."""
    budget, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = budget - sum(out[i] for i in range(len(sizes)) if i not in free)
        total = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
    return out


def _augment(start: int, end: int, arcs: list[list[int]], to: list[int], room: list[int]) -> None:
    """Dinic's algorithm: blocking flows over shortest paths until none is left. Arc k ^ 1 is the reverse of arc k."""
    while True:
        level = [-1] * len(arcs)
        level[start], queue = 0, [start]
        for u in queue:
            for k in arcs[u]:
                if room[k] and level[to[k]] < 0:
                    level[to[k]] = level[u] + 1
                    queue.append(to[k])
        if level[end] < 0:
            return
        at, path, u = [0] * len(arcs), [], start
        while True:
            if u == end:
                push = min(room[k] for k in path)
                for k in path:
                    room[k] -= push
                    room[k ^ 1] += push
                full = next(i for i, k in enumerate(path) if not room[k])
                u = to[path[full] ^ 1]
                del path[full:]
            while at[u] < len(arcs[u]) and not (room[arcs[u][at[u]]] and level[to[arcs[u][at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(arcs[u]):
                path.append(arcs[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def min_cost_flow(patterns: Sequence[tuple[frozenset[int], int]], quotas: Sequence[int], copies: int = 2) -> list[dict[int, int]]:
    """For each (sources, capacity) pattern the tokens it gives to each source.

    Arcs: start to pattern once for every copy, pattern to its sources, source to end up to its quota. A copy costs more
    than the one before, for every pattern alike, and nothing else costs anything. So the cheapest paths are always
    those of the least copy: flow is augmented as far as it goes copy by copy, which may route what earlier copies
    give to other sources.
    """
    n = len(patterns) + len(quotas) + 2
    start, end = n - 2, n - 1
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, most: int) -> int:
        for u, v, r in ((a, b, most), (b, a, 0)):
            arcs[u].append(len(to))
            to.append(v)
            room.append(r)
        return len(to) - 2

    into = [arc(start, p, 0) for p in range(len(patterns))]
    gives = [{s: arc(p, len(patterns) + s, copies * capacity) for s in sorted(sources)} for p, (sources, capacity) in enumerate(patterns)]
    for s, quota in enumerate(quotas):
        arc(len(patterns) + s, end, quota)
    for _ in range(copies):
        for k, (_, capacity) in zip(into, patterns, strict=True):
            room[k] = capacity
        _augment(start, end, arcs, to, room)
    return [{s: room[k ^ 1] for s, k in of.items() if room[k ^ 1]} for of in gives]


def _selection(sized: DataFrame, need: dict[int, int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, str, int]]]:
    """What is taken of each pattern: (pattern, first draw, draw after the last, greatest size) and single documents (pattern, draw, id, greatest size).

    Documents are tried in the order of their draws and taken while they fit. A round takes what lies before the document that
    passes the rest, tries single documents from there on, and leaves the later ones to a
    round of those that are no larger than what is left then, until none is.
    need: pattern to tokens, each less than the pattern holds. sized: (_pattern, _draw, _key, size).
    """
    ranges: list[tuple[int, int, int, int]] = []
    singles: list[tuple[int, int, str, int]] = []
    start, left, most = {p: 0 for p in need}, dict(need), {p: (1 << 62) for p in need}
    trying = set(need)
    while trying:
        base, end = _round(sized, {p: start[p] for p in trying}, left, most, singles)
        ranges += [(p, start[p], base[p], most[p]) for p in sorted(trying) if base[p] > start[p]]
        start.update(end)
        most = dict(left)
        trying = {p for p in trying if left[p] > 0 and start[p] < 1 << 60}
    return ranges, singles


def _round(sized: DataFrame, base: dict[int, int], left: dict[int, int], most: dict[int, int], singles: list[tuple[int, int, str, int]]) -> tuple[dict[int, int], dict[int, int]]:
    """For each pattern the draw below which all of at most its greatest size is taken, and the draw below which all is tried. Changes left and singles."""
    spark = sized.sparkSession
    end: dict[int, int] = {}
    open_, width = set(base), 60  # a pattern's draws below base are taken
    while open_:
        bits = min(width, BITS if len(open_) <= 500 else 4)  # half a million bins at most come to the driver
        width -= bits
        at = spark.createDataFrame([(p, base[p], most[p]) for p in sorted(open_)], "_p int, _base bigint, _most bigint")
        inside = sized.join(F.broadcast(at), F.col("_pattern") == F.col("_p"))  # a row for each open pattern at most
        inside = inside.where((F.col("size") > 0) & (F.col("size") <= F.col("_most")) & (F.col("_draw") >= F.col("_base")) & (F.col("_draw") < F.col("_base") + F.lit(1 << (width + bits))))
        bins = inside.groupBy("_pattern", F.shiftright(F.col("_draw") - F.col("_base"), width).cast("int").alias("_bin")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows")).collect()
        fill = {}
        for p in sorted(open_):
            own = sorted((r for r in bins if r[0] == p), key=lambda r: r[1])
            for k, b in enumerate(own):
                if b[2] > left[p]:
                    if b[3] <= SMALL or width == 0:
                        # what follows may fit too: SMALL documents at once
                        rows, last = 0, b[1]
                        for after in own[k:]:
                            rows += after[3]
                            if rows > SMALL and after is not b:
                                break
                            last = after[1]
                        fill[p] = base[p] + ((last + 1) << width)
                    base[p] += b[1] << width
                    break
                left[p] -= b[2]
            else:  # all that are left fit
                base[p] = end[p] = 1 << 60
        if fill:
            at = spark.createDataFrame([(p, base[p], stop, most[p]) for p, stop in fill.items()], "_p int, _base bigint, _end bigint, _most bigint")
            tail = sized.join(F.broadcast(at), F.col("_pattern") == F.col("_p"))
            tail = tail.where((F.col("_draw") >= F.col("_base")) & (F.col("_draw") < F.col("_end")) & (F.col("size") > 0) & (F.col("size") <= F.col("_most")))
            found: dict[int, list] = {}
            for r in tail.groupBy("_pattern", "_draw", "_key").agg(F.sum("size").alias("size")).collect():  # about SMALL rows a pattern
                found.setdefault(r[0], []).append(r)
            for p in fill:
                for r in sorted(found.get(p, []), key=lambda r: (r[1], r[2])):
                    if r[3] <= left[p]:
                        singles.append((p, r[1], r[2], most[p]))
                        left[p] -= r[3]
            end.update(fill)
        open_ -= end.keys()
    return base, end


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = WEIGHTS, share: float = 1.5, copies: int = 2, seed: int = 0, max_patterns: int = 10_000) -> DataFrame:
    """docs with size, source_size and target (of the first source of each row), copies and taken.

    members: an array of source names, null for the unnamed source. weights repeat over the sources in
    order of their code points.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = without(docs, [*OUTPUT, "_members", "_pattern", "_draw", "_key"])
    names = F.transform(members, lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("null")))
    full = rows.withColumns({"_members": F.array_sort(F.array_distinct(names)), "size": words_in(F.col(f"`{text_col}`").cast("string"))})
    key = F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    slim = materialize(full.select("_members", "size", key.alias("_key")), "mix-sizes")
    stats = slim.groupBy("_members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(stats) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    if not stats:
        return full.select(*[F.col(f"`{c}`") for c in rows.columns], "size", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("taken"))
    stats.sort(key=lambda r: r[0])
    # by code point, null last: "=name" sorts before "null"
    sources = sorted({m for r in stats for m in r[0]})
    sizes = [sum(r[1] for r in stats if m in r[0]) for m in sources]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(sources))], share, copies)
    where = {m: k for k, m in enumerate(sources)}
    patterns = [(frozenset(where[m] for m in r[0]), int(r[1])) for r in stats]
    flow = min_cost_flow(patterns, [round(x) for x in wanted], copies)
    total = [sum(f.values()) for f in flow]
    # whole copies of every document of the pattern, and what the next copy takes
    whole = [min(copies, t // c) if c else 0 for t, (_, c) in zip(total, patterns, strict=True)]
    need = {k: total[k] - whole[k] * patterns[k][1] for k in range(len(patterns)) if patterns[k][1] and 0 < total[k] - whole[k] * patterns[k][1] < patterns[k][1]}
    first = [min((where[m] for m in r[0]), default=0) for r in stats]
    plan = spark.createDataFrame(
        [(list(r[0]), k, int(whole[k]), int(sizes[first[k]]) if r[0] else 0, float(wanted[first[k]]) if r[0] else 0.0) for k, r in enumerate(stats)],
        T.StructType([T.StructField("_m", T.ArrayType(T.StringType())), T.StructField("_pattern", T.IntegerType()), T.StructField("_whole", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]),
    )
    plan = F.broadcast(plan)  # max_patterns rows at most
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_key"), F.concat_ws("\x00", "_members")), 4)
    sized = slim.join(plan, F.col("_members") == F.col("_m")).select("_pattern", draw.alias("_draw"), "_key", "size")
    ranges, singles = _selection(sized, need)
    full = full.withColumns({"_key": key}).join(plan, F.col("_members") == F.col("_m")).withColumn("_draw", draw)
    own: dict[int, list[tuple[int, int, int]]] = {}
    for p, lo, hi, most in ranges:
        own.setdefault(p, []).append((lo, hi, most))
    limits = spark.createDataFrame(sorted(own.items()), "_pattern int, _ranges array<struct<lo: bigint, hi: bigint, most: bigint>>")
    extra = spark.createDataFrame(singles, "_pattern int, _draw bigint, _key string, _most bigint")
    full = full.join(F.broadcast(limits), "_pattern", "left").join(F.broadcast(extra), ["_pattern", "_draw", "_key"], "left")  # SMALL rows a pattern and round at most
    within = F.exists("_ranges", lambda r: (F.col("_draw") >= r["lo"]) & (F.col("_draw") < r["hi"]) & (F.col("size") <= r["most"]))
    more = F.coalesce(within, F.lit(False)) | (F.col("size") <= F.col("_most"))
    taken = (F.col("_whole") + F.when(F.coalesce(more, F.lit(False)), F.lit(1)).otherwise(F.lit(0))).cast("bigint")
    return full.select(*[F.col(f"`{c}`") for c in rows.columns], "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))
