"""Which texts contain which of any number of patterns, without telling the patterns to all tasks.

An inverted join on each pattern's rarest piece. Pieces are runs of SIZES code points, the longest size that a
pattern has; they travel as 64-bit hashes. Texts' pieces are counted where a bitmap of fixed size says that some pattern may have
them, so each pattern picks the piece that stands in the fewest places, and one with a piece that stands nowhere is out. Places of
the picked pieces, again behind a bitmap, meet the patterns by a join on the hash, and every candidate is verified by the
text itself. Nothing is collected but the bitmaps.

Null and empty patterns and null texts give no rows; equal patterns are one; a pattern of one row gives one row however
often it stands there. Other columns of the rows are carried; one named like the pattern's is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize, ship, without

#: Lengths of pieces in code points.
SIZES = (1, 2, 3, 4, 8, 16)
#: Bits of the bitmaps; with 2,000,000 patterns about 3 % of other pieces pass.
BITS = 1 << 26


def _mixed(h: np.ndarray) -> np.ndarray:
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def piece_hashes(points: np.ndarray, size: int, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A hash of the pieces of that size from every place on, made of those of its two halves. known: hashes of the same points by size, which grow."""
    known = {} if known is None else known
    return (_halves(points, size, known) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)


def _halves(points: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    if size not in known:
        n = max(0, len(points) - size + 1)
        if size == 1:
            known[size] = _mixed(points + np.uint64(1))
        else:
            first = (size + 1) // 2
            left, right = _halves(points, first, known), _halves(points, size - first, known)
            known[size] = _mixed((left[:n] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size)) ^ right[first : first + n])
    return known[size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _pattern_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern) to (pattern, piece, size, offset), each distinct piece once."""
    for batch in batches:
        out: list[tuple[str, int, int, int]] = []
        for text in batch.column(0).to_pylist():
            points = code_points(text)
            size = max(s for s in SIZES if s <= len(points))
            pieces, at = np.unique(piece_hashes(points, size), return_index=True)
            out += [(text, p, size, a) for p, a in zip(pieces.tolist(), at.tolist(), strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["pattern", "piece", "size", "offset"])


def _bitmap(pieces: DataFrame, bits: int):
    """A broadcast of (bits by hash, sizes in use)."""
    spark = pieces.sparkSession
    slots = pieces.select(F.pmod("piece", F.lit(bits)).alias("slot")).distinct()
    words = slots.groupBy(F.expr("shiftright(slot, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 32 AS INT)))").alias("set")).toArrow()
    table = np.zeros(bits >> 5, dtype=np.uint32)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy().astype(np.uint32)
    sizes = sorted(r[0] for r in pieces.select("size").distinct().collect())  # one of SIZES each
    return spark.sparkContext.broadcast((table, sizes))


def _passes(shared, bits: int, points: np.ndarray, known: dict[int, np.ndarray], once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of the text's pieces that the bitmap lets through; once: of equal pieces the first. known: as in piece_hashes."""
    table, sizes = shared.value
    for size in sizes:
        h = piece_hashes(points, size, known)
        slot = h % bits
        at = np.flatnonzero((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1)
        yield _first_of_each(points, h[at], at, size) if once else (h[at], at)


def _counts(shared, bits: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times.astype(np.int64))], names=["piece", "times"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for h, _ in _passes(shared, bits, code_points(text or ""), {}):
                    held.append(h)
                    size += len(h)
                if size > limit:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return run


def _first_of_each(points: np.ndarray, h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Less the places that repeat, code point by code point, what stands at the first place of the same hash."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    origin = at[first][inverse]
    same = origin != at
    for k in range(size):
        same &= points[at + k] == points[origin + k]
    return h[~same], at[~same]


def _places(whole, parts, bits: int):
    """Places of picked pieces, in one pass over the texts. whole: the bitmap of patterns that are pieces themselves, of which one place each is enough; parts: of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, places, kinds = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.bool_))
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, known = code_points(text or ""), {}
                for shared, once in ((whole, True), (parts, False)):
                    for h, at in _passes(shared, bits, points, known, once):
                        rows.append(np.full(len(h), row, dtype=np.int64))
                        pieces.append(h)
                        places.append(at)
                        kinds.append(np.full(len(h), once))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, pieces, places, kinds)], names=["_row", "piece", "place", "whole"])

    return run


def contained(rows: DataFrame, column: str, words: DataFrame, word: str, bits: int = BITS, limit: int = 2_000_000) -> DataFrame:
    """rows with one of the words that their text contains, a row for each. Any number of words, of any lengths."""
    ship(rows.sparkSession)
    own = without(rows, [word]) if word != column else rows
    held = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "search-rows")
    patterns = words.where(F.col(word).isNotNull() & (F.col(word) != "")).select(F.col(word).cast("string").alias("pattern")).distinct()
    pieces = materialize(patterns.mapInArrow(_pattern_pieces, "pattern string, piece bigint, size int, offset int"), "search-pieces")
    counts = held.select(F.col(f"`{column}`").cast("string").alias("text")).mapInArrow(_counts(_bitmap(pieces, bits), bits, limit), "piece bigint, times bigint").groupBy("piece").agg(F.sum("times").alias("times"))
    told = pieces.join(counts, "piece", "left")
    best = told.groupBy("pattern").agg(F.min("times").alias("times"), F.count_if(F.col("times").isNull()).alias("nowhere"), F.min_by(F.struct("piece", "size", "offset"), F.struct("times", "piece")).alias("b")).where("nowhere = 0")
    picked = materialize(best.select("pattern", "b.*"), "search-picked")
    texts = held.select("_row", F.col(f"`{column}`").cast("string").alias("text"))
    own = picked.withColumn("whole", F.length("pattern") == F.col("size"))
    places = texts.mapInArrow(_places(*[_bitmap(own.where(F.col("whole") == whole), bits) for whole in (True, False)], bits), "_row bigint, piece bigint, place bigint, whole boolean")
    candidates = places.join(own.select("piece", "pattern", "offset", "whole"), ["piece", "whole"]).select("_row", "pattern", (F.col("place") - F.col("offset")).alias("start")).where("start >= 0")
    # a row's text meets its candidates where they are compared
    found = candidates.join(texts, "_row").where(F.substring(F.col("text"), F.col("start").cast("int") + 1, F.length("pattern")) == F.col("pattern"))
    return held.join(found.select("_row", F.col("pattern").alias(word)).distinct(), "_row").drop("_row")


def passage_counts(docs: DataFrame, passages: DataFrame, **options: int) -> DataFrame:
    """(item_id, documents) as corpus.passage_counts gives it, for any number of passages."""
    numbered = docs.select("text").where("text IS NOT NULL")
    named = passages.where("passage IS NOT NULL AND passage <> ''").select("item_id", "passage").distinct()
    counts = contained(numbered, "text", named, "passage", **options).groupBy("passage").agg(F.count("*").alias("documents"))
    return named.join(counts, "passage").groupBy("item_id").agg(F.sum("documents").alias("documents"))
