"""Removal of repeated passages by recompression.

Words become 64-bit names. Rounds of pair compression name adjacent symbols: a round deals
names to two sides by a hash bit, and a left symbol followed by a right one becomes a pair, named by
a hash of both, so naming is global without any exchange. At the top, runs of equal symbols are named
by symbol and length. Every symbol carries the word range that determines it: wherever those words
recur, the same symbol recurs. Spark then counts the symbols of three words and more over all
documents. A window that determines a symbol nobody shares can't be repeated, so only windows
whose determined symbols are all shared are candidates. Those are compared across all documents by 128-bit fingerprints of
their whole word sequences, made of two independent hashes of each word, and every one but the first
is repeated. So a result is wrong only where two such fingerprints agree by chance.

Departure from the method's name: a round needs no exchange, as a pair's name is a hash of both sides and so the same in
every task; all rounds of a chunk run in the task that holds it, and Spark's rounds are the two that count
symbols and compare windows.

Documents are worked on in chunks of about CHUNK bytes, held zstd-compressed in a table in the shared folder. Chunks send
packed blocks to buckets by name and get bits back; each distinct name or window goes once from a
chunk, so a passage in very many documents costs one entry a chunk. Documents of equal word
sequences are found first and only the first of them takes part.

Defined results: null or empty text has no words; texts under the window length lose nothing; rows that share an id
are ordered as they come; null ids come last; an empty table gives no rows; other input columns are
not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.components import join_counted
from factloom.session import materialize, partitions, release, ship

WINDOW = 20
ROUNDS, LEAST_WORDS = 3, 3
CHUNK = 2 << 20
BUCKET = 1_000_000
K1, K2, K3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
LAST = (1 << 63) - 1


def compress(names: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, last word) of the symbols that a window may determine; names: of the words, doc: of each word."""
    at = np.arange(len(names), dtype=np.int64)
    lo, hi, left, right = at, at, at, at  # extent; and the words that determine the symbol
    found = []
    for k in range(ROUNDS):
        if len(names) < 2:
            break
        side = (words.mix(names ^ np.uint64(int(K3) * (k + 1) % (1 << 64))) >> np.uint64(63)).astype(bool)
        near = doc[1:] == doc[:-1]
        opens = np.zeros(len(names), dtype=bool)
        opens[:-1] = ~side[:-1] & side[1:] & near
        closes = np.concatenate([[False], opens[:-1]])
        # a single is determined only together with the neighbour that it might have paired with
        follows, precedes = np.concatenate([near, [False]]), np.concatenate([[False], near])
        next_right = np.where(follows, np.concatenate([right[1:], [0]]), first[doc + 1])
        prev_left = np.where(precedes, np.concatenate([[0], left[:-1]]), first[doc] - 1)
        single = ~opens & ~closes
        right2 = np.where(single & ~side, np.maximum(right, next_right), right)
        left2 = np.where(single & side, np.minimum(left, prev_left), left)
        i = np.flatnonzero(opens)
        names, hi2 = names.copy(), hi.copy()
        names[i] = words.mix(names[i] * K1 + words.mix(names[i + 1] + np.uint64(k)))
        hi2[i] = hi[i + 1]
        left2[i], right2[i] = np.minimum(left[i], left[i + 1]), np.maximum(right[i], right[i + 1])
        if k:
            long = i[hi2[i] - lo[i] + 1 >= LEAST_WORDS]
            found.append((names[long], left2[long], right2[long], doc[long]))
        keep = ~closes
        names, doc, lo, hi, left, right = names[keep], doc[keep], lo[keep], hi2[keep], left2[keep], right2[keep]
    if len(names) > 1:
        # runs: determined together with what stands on either side
        same = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        ends = np.concatenate([starts[1:], [len(names)]]) - 1
        runs = ends > starts
        s, e = starts[runs], ends[runs]
        before = np.where((s > 0) & (doc[np.maximum(s - 1, 0)] == doc[s]), left[np.maximum(s - 1, 0)], first[doc[s]] - 1)
        after = np.where((e + 1 < len(names)) & (doc[np.minimum(e + 1, len(names) - 1)] == doc[e]), right[np.minimum(e + 1, len(names) - 1)], first[doc[e] + 1])
        found.append((words.mix(names[s] * K2 + (e - s).astype(np.uint64)), np.minimum(before, left[s]), np.maximum(after, right[e]), doc[s]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    name, left, right, doc = (np.concatenate([f[k] for f in found]) for k in range(4))
    ok = (right - left < window) & (left >= first[doc]) & (right < first[doc + 1])
    return name[ok], left[ok], right[ok]


def window_hashes(names: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """A hash of every window of names; one for each position that has a whole window after it."""
    n = len(names) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # blocks of 1, 2, 4, ... names, put together by the binary digits of the window
    block, size, out, done = names, 1, None, 0
    while True:
        if window & size:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(int(base), size, 1 << 64)) + part
            done += size
        if 2 * size > window:
            return words.mix(out)
        block = block[:-size] * np.uint64(pow(int(base), size, 1 << 64)) + block[size:]
        size *= 2


class Chunk:
    """The documents of a chunk row, split and named."""

    def __init__(self, blob: bytes, window: int, copies: list[int] | None) -> None:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
        self.keys = np.frombuffer(raw, dtype="<i8", count=n, offset=8)
        self.offsets = np.frombuffer(raw, dtype="<i8", count=n + 1, offset=8 + 8 * n)
        self.data = np.frombuffer(raw, dtype=np.uint8, offset=16 + 16 * n)
        self.window = window
        self.starts, self.ends, self.first = words.spans(self.offsets, self.data)
        self.names = words.hashes(self.data, self.starts, self.ends)
        self.others = words.hashes(self.data, self.starts, self.ends, seed=1)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.active = np.ones(n, dtype=bool)
        self.active[copies or []] = False

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The determined symbols of active documents, and their distinct names."""
        name, left, right = compress(self.names, self.doc, self.first, self.window)
        on = self.active[self.doc[left]] if len(left) else np.zeros(0, bool)
        name, left, right = name[on], left[on], right[on]
        return name, left, right, np.unique(name)

    def candidates(self, shared: np.ndarray, parsed: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Starts of the windows all of whose determined symbols are shared; shared: for each distinct name."""
        name, left, right, distinct = parsed
        n = len(self.names)
        room = self.first[self.doc + 1] - np.arange(n) >= self.window
        alone = ~shared[np.searchsorted(distinct, name)] if len(name) else np.zeros(0, bool)
        bars = np.zeros(n + 1, dtype=np.int32)
        lo = np.maximum(right[alone] - self.window + 1, self.first[self.doc[left[alone]]])
        np.add.at(bars, lo, 1)
        np.add.at(bars, left[alone] + 1, -1)
        return np.flatnonzero(room & self.active[self.doc] & (np.cumsum(bars[:n]) == 0))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, the two halves of the fingerprint) of the first of each distinct window in document order, and the starts of the others."""
        one, two = window_hashes(self.names, self.window, K1)[at], window_hashes(self.others, self.window, K2)[at]
        rank = np.empty(len(self.keys), dtype=np.int64)
        rank[np.lexsort((np.arange(len(self.keys)), self.keys))] = np.arange(len(self.keys))
        order = np.lexsort((at, rank[self.doc[at]], two, one))
        one, two, at = one[order], two[order], at[order]
        again = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])]) if len(at) else np.zeros(0, bool)
        return at[~again], one[~again], two[~again], at[again]


def deal(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The order by bucket, the buckets in that order, and where each begins and ends."""
    to = (hashes >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    return order, to, [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def bits_of(answers: list[tuple[int, bytes]], order: np.ndarray, to: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The answers of all buckets, in the order in which the chunk holds its hashes."""
    by = dict(answers)
    out = np.zeros(len(order), dtype=bool)
    for a, b in cuts:
        bits = np.unpackbits(np.frombuffer(by[int(to[a])], dtype=np.uint8), count=b - a, bitorder="little")
        out[order[a:b]] = bits.astype(bool)
    return out


# ---- chunks

STORED = "chunk bigint, blob binary, row int, key bigint, n bigint, hi bigint, lo bigint"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        keys = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype("<i8")
        for a, b, offsets, data in words.groups(batch.column(1)):
            raw = b"".join([np.array([b - a], dtype="<i8").tobytes(), keys[a:b].tobytes(), offsets.astype("<i8").tobytes(), data.tobytes()])
            starts, ends, first = words.spans(offsets, data)
            hashed = words.hashes(data, starts, ends), words.hashes(data, starts, ends, seed=1)
            # fingerprints of whole word sequences: positions count
            place = np.arange(len(starts), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h + words.mix(place + k)), dtype=np.uint64)]) for h, k in zip(hashed, (K1, K2), strict=True)]
            hi, lo = ((s[first[1:]] - s[first[:-1]]).astype(np.int64) for s in sums)
            n, m = b - a, number
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([squeeze.compress(raw)], pa.binary()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * 4], names=["chunk", "blob", "row", "key", "n", "hi", "lo"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m), pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n), pa.int32()), pa.array(keys[a:b]), pa.array(np.diff(first), pa.int64()), pa.array(hi), pa.array(lo)], names=["chunk", "blob", "row", "key", "n", "hi", "lo"])
            number += 1


# ---- passes over the chunks: rows (chunk, blob, copies[, shared answers[, window answers]])

BLOCKS = "bucket int, chunk bigint, block binary"
BITS = "chunk bigint, bucket int, bits binary"


def _lists(column: pa.Array, k: int) -> list:
    return column[k].as_py() or []


def _answers(column: pa.Array, k: int) -> list[tuple[int, bytes]]:
    return [(x["bucket"], x["bits"]) for x in _lists(column, k)]


def _send_symbols(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                c = Chunk(blob.as_py(), window, _lists(batch.column(2), k))
                name, _, _, distinct = c.symbols()
                many = np.bincount(np.searchsorted(distinct, name), minlength=len(distinct)) > 1
                order, to, cuts = deal(distinct, buckets)
                distinct, many = distinct[order], many[order]
                blocks = [np.packbits(many[a:b], bitorder="little").tobytes() + distinct[a:b].tobytes() for a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in cuts], pa.int32()), pa.array([chunk] * len(cuts), pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "chunk", "block"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows come sorted by bucket."""
    current, chunks, blocks = None, [], []
    for batch in batches:
        for bucket, chunk, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != current:
                if chunks:
                    yield current, chunks, blocks
                current, chunks, blocks = bucket, [], []
            chunks.append(chunk)
            blocks.append(block.as_py())
    if chunks:
        yield current, chunks, blocks


def _reply(bucket: int, chunks: list[int], sizes: list[int], bits: np.ndarray) -> pa.RecordBatch:
    at = np.cumsum([0, *sizes])
    packed = [np.packbits(bits[a:b], bitorder="little").tobytes() for a, b in zip(at, at[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "bucket", "bits"])


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each name that a chunk has sent, whether it occurs elsewhere or more than once."""
    for bucket, chunks, blocks in _by_bucket(batches):
        names, many, sizes = [], [], []
        for block in blocks:
            # n names take 8 n bytes, their flags n / 8 rounded up
            n = next(x for x in range(8 * len(block) // 65, 8 * len(block) // 65 + 3) if 8 * x + -(-x // 8) == len(block))
            many.append(np.unpackbits(np.frombuffer(block, dtype=np.uint8, count=-(-n // 8)), count=n, bitorder="little").astype(bool))
            names.append(np.frombuffer(block, dtype="<u8", offset=-(-n // 8)))
            sizes.append(n)
        name = np.concatenate(names)
        order = np.argsort(name, kind="stable")
        same = np.concatenate([[False], name[order][1:] == name[order][:-1], [False]])
        shared = np.concatenate(many)
        # a name that one chunk has more than once is shared everywhere it occurs, by itself or by being there twice
        shared[order] |= same[1:] | same[:-1]
        yield _reply(bucket, chunks, sizes, shared)


def _send_windows(window: int, symbol_buckets: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                c = Chunk(blob.as_py(), window, _lists(batch.column(2), k))
                at, one, two, _ = _windows(c, _answers(batch.column(3), k), symbol_buckets)
                order, to, cuts = deal(one, buckets)
                at, one, two, keys = at[order], one[order], two[order], c.keys[c.doc[at[order]]]
                blocks = []
                for a, b in cuts:
                    key, inverse = np.unique(keys[a:b], return_inverse=True)
                    blocks.append(b"".join([np.array([len(key), b - a], dtype="<u8").tobytes(), key.astype("<i8").tobytes(), inverse.astype("<u4").tobytes(), one[a:b].astype("<u8").tobytes(), two[a:b].astype("<u8").tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in cuts], pa.int32()), pa.array([chunk] * len(cuts), pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "chunk", "block"])

    return run


def _windows(c: Chunk, answers: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parsed = c.symbols()
    shared = bits_of(answers, *deal(parsed[3], buckets))
    return c.windows(c.candidates(shared, parsed))


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each window that a chunk has sent, whether it also starts earlier elsewhere."""
    for bucket, chunks, blocks in _by_bucket(batches):
        parts, sizes = [], []
        for chunk, block in zip(chunks, blocks, strict=True):
            docs, n = (int(x) for x in np.frombuffer(block, dtype="<u8", count=2))
            key = np.frombuffer(block, dtype="<i8", count=docs, offset=16)
            at = 16 + 8 * docs
            which = np.frombuffer(block, dtype="<u4", count=n, offset=at)
            one, two = np.frombuffer(block, dtype="<u8", count=n, offset=at + 4 * n), np.frombuffer(block, dtype="<u8", count=n, offset=at + 12 * n)
            parts.append((one, two, key[which], np.full(n, chunk)))
            sizes.append(n)
        one, two, key, chunk = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((chunk, key, two, one))
        o, t = one[order], two[order]
        later = np.zeros(len(order), dtype=bool)
        later[order[1:]] = (o[1:] == o[:-1]) & (t[1:] == t[:-1])
        yield _reply(bucket, chunks, sizes, later)


def _cut(window: int, symbol_buckets: int, buckets: int, with_text: bool, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in enumerate(batch.column(1)):
                copies = _lists(batch.column(2), k)
                c = Chunk(blob.as_py(), window, copies)
                at, one, _, again = _windows(c, _answers(batch.column(3), k), symbol_buckets)
                later = bits_of(_answers(batch.column(4), k), *deal(one, buckets))
                gone = np.zeros(len(c.names) + window + 1, dtype=np.int32)
                for starts in (at[later], again):
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                gone = np.cumsum(gone)[: len(c.names)] > 0
                for d in copies:
                    if c.first[d + 1] - c.first[d] >= window:
                        gone[c.first[d] : c.first[d + 1]] = True
                texts, digests = [], []
                for d in range(len(c.keys)):
                    a, b = c.first[d], c.first[d + 1]
                    parts = c.data[c.offsets[d] : c.offsets[d + 1]].tobytes().split()
                    kept = b" ".join(parts if not gone[a:b].any() else [w for w, g in zip(parts, gone[a:b].tolist(), strict=True) if not g])
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8", "replace"))
                removed = np.concatenate([[0], np.cumsum(gone)])
                keys = pa.array(c.keys, pa.int64(), mask=c.keys == LAST)
                out = [keys, pa.array(np.diff(c.first), pa.int64()), pa.array(removed[c.first[1:]] - removed[c.first[:-1]], pa.int64()), pa.array(digests, pa.string())]
                names = [id_col, "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(texts, pa.string())] if with_text else [])], names=names + ["kept_text"] * with_text)

    return run


def _gather(answers: DataFrame, name: str) -> DataFrame:
    """All answers to a chunk in one row: a bit for each name the chunk has sent."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    stored = materialize(docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_store, STORED), "repeats-chunks")
    rows = stored.where("row is not null").select("chunk", "row", "key", "n", "hi", "lo")
    # documents of equal word sequences: all but the first are copies
    long = rows.where(F.col("n") >= window)
    groups = materialize(long.groupBy("hi", "lo", "n").agg(F.min(F.struct("key", "chunk", "row")).alias("first"), F.count("*").alias("c")).where("c > 1"), "repeats-groups")
    copies = join_counted(long, groups, ["hi", "lo", "n"], "c").where("struct(key, chunk, row) <> first").groupBy("chunk").agg(F.collect_list("row").alias("copies"))
    copies = materialize(copies, "repeats-copies")
    words_in_all = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(n, words_in_all // (2 * BUCKET))
    chunks = stored.where("blob is not null").select("chunk", "blob").join(copies, "chunk", "left")

    def answered(sent: DataFrame, reduce, name: str) -> DataFrame:
        dealt = sent.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket")
        out = materialize(dealt.mapInArrow(reduce, BITS), name)
        release(spark)
        return out

    shared = answered(chunks.mapInArrow(_send_symbols(window, buckets), BLOCKS), _count_symbols, "repeats-shared")
    asked = chunks.join(_gather(shared, "shared"), "chunk", "left")
    later = answered(asked.mapInArrow(_send_windows(window, buckets, buckets), BLOCKS), _first_windows, "repeats-later")
    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return asked.join(_gather(later, "later"), "chunk", "left").mapInArrow(_cut(window, buckets, buckets, with_text, id_col), schema)
