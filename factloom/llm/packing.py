"""Hierarchical residual best-fit packing of token sequences.

Map tasks tokenise documents into pieces. The pieces, by number and length only, are dealt to
partitions of about `round_items`, which pack them best-fit, longest first. Bins that are full to
within `slack` tokens are final. The underfull bins of several partitions become the items of the
next round, which packs them best-fit as wholes, again emitting nearly full bins, in a tree of ever
fewer tasks. A round's task holds about `round_items` items, so the tree ends at as many tasks as the
leftover needs, not always at one.

Tokens come from a word cache in front of the tokenizer: its pre-tokenizer never joins text across
blank, tab and line breaks, so the ids of a text are those of its words one after another.

Defined results: null or empty text has only the end id and so one piece of one token; every row is
a document of its own, also when rows or ids repeat; a null id is kept; an empty table gives no
pieces; other input columns are not carried. Only documents longer than the capacity are cut.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.session import materialize, ship

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS, CACHED_LENGTH = 500_000, 64
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, _bin bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, by way of a bounded cache of words."""

    _made: dict[str, Tokens] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-case letters up to U+00FF pass the normaliser unchanged and are one pre-token: the model alone does
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[bytes, bytes] = {}
        # which ids end a pre-token
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith("</w>")

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def learn(self, new: list[bytes], letters: bool) -> list[bytes]:
        """Ids of words, many in one call. letters: all are of lower-case letters up to U+00FF only. Others are told apart by their offsets."""
        joined = b" ".join(new).decode("utf-8", "replace")
        if letters:
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(new):
                raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
                return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        found = self.tokenizer.encode(joined, add_special_tokens=False)
        starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
        at = [0, *np.searchsorted(starts, np.cumsum([len(w.decode("utf-8", "replace")) + 1 for w in new])).tolist()]
        raw = np.array(found.ids, dtype="<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]

    def resolve(self, new: list[bytes]) -> list[bytes]:
        """Ids of words that the cache hasn't.

        A full stop or comma after a letter is a token of its own, and case doesn't count. Words with characters
        beyond U+00FF are left whole, as their case and composition aren't plain.
        """
        stems = []
        letters: dict[bytes, bytes | None] = {}
        others: dict[bytes, bytes | None] = {}
        for w in new:
            if w.isalpha() and w.islower():  # ASCII
                stem, mark, group = w, b"", letters
            elif w.isascii():
                stem = w.lower()
                mark = stem[-1:] if stem[-1:] in (b".", b",") and stem[-2:-1].isalpha() else b""
                stem = stem[: len(stem) - len(mark)]
                group = letters if stem.isalpha() else others
            else:
                text = w.decode("utf-8", "replace")
                if latin := max(text) <= "\xff":
                    text = text.lower()
                mark = text[-1:].encode() if latin and text[-1:] in (".", ",") and text[-2:-1].isalpha() else b""
                if mark:
                    text = text[:-1]
                stem, group = text.encode(), letters if latin and text.isalpha() else others
            stems.append((stem, mark))
            group[stem] = None
        for group, is_letters in ((letters, True), (others, False)):
            todo = list(group)
            for lo in range(0, len(todo), 300):
                part = todo[lo : lo + 300]
                group.update(zip(part, self.learn(part, is_letters), strict=True))
        marks = dict(zip((b".", b","), self.learn([b".", b","], False), strict=True)) | {b"": b""}
        letters |= others
        return [letters[stem] + marks[mark] for stem, mark in stems]

    def of_column(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null read as empty.

        Words are told apart by hash for a slice of the column at once, and checked byte by byte; only distinct ones are looked up.
        """
        for _, _, offsets, data in words.groups(column):
            starts, ends, first = words.spans(offsets, data)
            raw = data.tobytes()
            _, at, inverse = np.unique(words.hashes(data, starts, ends), return_index=True, return_inverse=True)
            if not words.same_words(data, starts, ends, at[inverse]):  # different words of one hash
                number: dict[bytes, int] = {}
                inverse = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                at = np.unique(inverse, return_index=True)[1]
            keys = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            found = list(map(self.cache.get, keys))
            if missing := [k for k, b in enumerate(found) if b is None]:
                resolved = self.resolve([keys[k] for k in missing])
                if len(self.cache) > CACHE_WORDS:
                    self.cache.clear()
                for k, b in zip(missing, resolved, strict=True):
                    found[k] = b
                    if len(b) <= 4 * CACHED_LENGTH:
                        self.cache[keys[k]] = b
            flat = np.frombuffer(b"".join(found), dtype="<u4")
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            begin = np.cumsum(sizes) - sizes
            own = sizes[inverse]
            ends_at = np.cumsum(own)
            ids = flat[np.arange(int(ends_at[-1]) if len(own) else 0) - np.repeat(ends_at - own - begin[inverse], own)].tobytes()
            cuts = 4 * np.concatenate([[0], ends_at])[first]
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                yield ids[a:b]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return list(self.of_column(pa.array(texts, pa.string())))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: for each item its bin and place there, and the fill of each bin."""
    room: dict[int, list[int]] = {}
    mask, where, at, fill = 0, [0] * len(lengths), [0] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[i]
        if fits := mask >> size:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        where[i], at[i] = b, fill[b]
        fill[b] += size
        left = r - size
        if left:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    return where, at, fill


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, stop = Tokens.of(path), np.array([end], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "_bin"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            out = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)  # noqa: B023, E731
            for key, ids in zip(batch.column(0).to_pylist(), tokens.of_column(batch.column(1)), strict=True):
                ids += stop
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((key, k, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None, number))
                    number += 1
                if len(rows) >= 2000:
                    yield out()
                    rows = []
            if rows:
                yield out()

    return run


def _round(capacity: int, round_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Tokens._made.clear()  # workers that made the pieces don't need their word caches any more
        first = TaskContext.get().partitionId() << 33
        bins: list[int] = []
        fills: list[int] = []

        def packed() -> pa.RecordBatch:
            nonlocal first
            where, at, fill = best_fit(fills, capacity)
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (bins, [first + b for b in where], at, [fill[b] for b in where])], names=["_bin", "_next", "_base", "_fill"])
            first += len(fill)
            return out

        for batch in batches:
            bins += batch.column(0).to_pylist()
            fills += batch.column(1).to_pylist()
            if len(bins) >= 4 * round_items:
                yield packed()
                bins, fills = [], []
        if bins:
            yield packed()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END, slack: int = 8, fan_in: int = 8, round_items: int = 200_000, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    spark = docs.sparkSession
    ship(spark)
    pairs = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string"))
    pieces = materialize(pairs.mapInArrow(_pieces(tokenizer or tokenizer_path(), capacity, end_id, with_ids), PIECE), "pack-pieces")
    # where pieces go: (_bin, _seq, _base); those that fill a sequence alone have no row
    moved: DataFrame | None = None
    under = pieces.select("_bin", F.col("length").alias("_fill")).where(F.col("_fill") < capacity - slack)
    count, tasks, level = under.count(), 0, 0
    while count > 1:
        level += 1
        before, least = tasks, -(-count // round_items)
        tasks = least if level == 1 else max(least, -(-tasks // fan_in))
        # numbers of later rounds lie above those of earlier ones
        packed = under.repartition(tasks, F.xxhash64("_bin", F.lit(level))).select("_bin", "_fill").mapInArrow(_round(capacity, round_items), "_bin bigint, _next bigint, _base bigint, _fill bigint")
        packed = materialize(packed.withColumn("_next", F.col("_next") + F.lit(level << 56)), f"pack-round-{level}")
        if moved is None:
            moved = packed.select("_bin", F.col("_next").alias("_seq"), "_base")
        else:
            step = packed.select(F.col("_bin").alias("_seq"), "_next", F.col("_base").alias("_more"))
            moved = moved.join(step, "_seq", "left").select("_bin", F.coalesce("_next", "_seq").alias("_seq"), (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("_base"))
        if tasks == 1:
            break  # one task has seen all of them
        left = materialize(packed.groupBy("_next").agg(F.first("_fill").alias("_fill")).where(F.col("_fill") < capacity - slack).withColumnRenamed("_next", "_bin"), f"pack-under-{level}")
        remain = left.count()
        gone, under, count = count - remain, left, remain
        if before == tasks and gone <= count // 100:
            break  # nothing fits together any more
    if moved is None:
        moved = spark.createDataFrame([], "_bin bigint, _seq bigint, _base bigint")
    out = pieces.join(moved, "_bin", "left")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return out.select(*cols, F.coalesce("_seq", "_bin").alias("sequence_id"), F.coalesce("_base", F.lit(0)).cast("bigint").alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences; needs pack(..., with_ids=True). A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
