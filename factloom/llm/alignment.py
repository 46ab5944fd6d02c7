"""Alignment of the tokens of two tokenizers over the same text, by byte-owner arrays.

Each side's token indices are repeated over the bytes of its tokens, so every byte names its owner in A
and in B. Consecutive distinct owner pairs are the overlaps; where both owners change at once there is a
cut, and cuts part a text into groups. The A token and the B token that end at a cut are linked.

Neither tokenizer joins text at certain places (see `unit_starts`): A's pattern opens a new piece there,
and B has no piece with what would have to meet, which is checked when it is loaded. So a text is the
sequence of its units, most of them words and marks, and a unit's tokens, groups and links are the same
wherever it stands. Only a task's distinct units are tokenised and aligned, from a bounded cache; what a
text has is gathered from its units, in slices of about two megabytes of text. A text without such places
is one unit.

Corpus counts of linked id pairs are summed in each task before they are dealt by pair. Texts are
tokenised once for the counts and again for the result, so links of documents aren't kept anywhere.
Counts are broadcast as sorted arrays if there are at most `broadcast_pairs` of them; beyond that
the documents' pairs are joined with them by shuffle, hot pairs by broadcast.

Defined results: text that is null, empty, not UTF-8, or that B can't spell byte by byte (as with its own
blank mark in the text) has no tokens and its numbers are 0; every row is a document of its own, also
when rows or ids repeat; other columns are carried, those named like results are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.components import join_counted
from factloom.llm.words import buffers, groups, hashes, same_words
from factloom.session import discard, materialize, ship, without

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLANK_MARK = "▁"
CACHE_UNITS, CACHED_LENGTH = 600_000, 64
#: Pairs that a task sums up before it hands them on.
TALLY = 1_000_000
BROADCAST_PAIRS = 2_000_000
COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
SPANS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, overlaps array<struct<a:int,b:int,bytes:int>>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The bytes behind the letters of byte-level vocabularies: printable ones stand for themselves, the others follow U+00FF in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Owners:
    """Two token sequences over the same bytes. a, b: ids; a_ends, b_ends: where tokens end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def align(self) -> None:
        """Sets the token numbers (a_at, b_at) of the overlaps, their bytes, and which of them end at a cut."""
        total = int(self.a_ends[-1]) if len(self.a_ends) else 0
        a = np.repeat(np.arange(len(self.a), dtype=np.int32), np.diff(self.a_ends, prepend=0))
        b = np.repeat(np.arange(len(self.b), dtype=np.int32), np.diff(self.b_ends, prepend=0))
        a_new, b_new = a[1:] != a[:-1], b[1:] != b[:-1]
        last = np.append(np.flatnonzero(a_new | b_new), total - 1) if total else np.zeros(0, np.int64)
        self.a_at, self.b_at, self.bytes = a[last], b[last], np.diff(last, prepend=-1)
        both = np.append(a_new & b_new, True) if total else np.zeros(0, bool)
        self.cut = both[last]
        #: the tokens that end at the cuts, in order; token k of A is in group searchsorted(a_cut, k)
        self.a_cut, self.b_cut = self.a_at[self.cut], self.b_at[self.cut]


#: Marks that no piece of B joins with an ASCII letter, and that A's pattern parts from letters (not so the apostrophe).
MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Bytes that open a character no tokenizer takes for white space, so that a blank before them starts a unit.
_OPENS, _LETTER, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_OPENS[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEF)]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[b for b in range(0x21, 0x7F) if chr(b) != "'" and not chr(b).isalnum()]] = True
_LINE = 0x0A
#: The pattern that A's byte-level pre-tokenizer stands for, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Two tokenizers, and what is known of units: (A tokens, B tokens, groups as text, linked pairs as 64-bit numbers), None where B can't spell it."""

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        inside = re.compile(rf".{BLANK_MARK}|\n.|.\n|[{MARKS}][A-Za-z]|[A-Za-z][{MARKS}]", re.S)
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(BLANK_MARK, " ").encode())
            if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k)) and inside.search(piece.lstrip(BLANK_MARK)):
                raise ValueError(f"B's piece {piece!r} goes over the end of a unit")
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        if not (self.a_sizes.all() and self.b_sizes.all()):
            raise ValueError("a token has no bytes")
        self.before = self.b.encode("\n")  # the blank that B adds, and a line end, which joins with nothing
        self.fast = self._ranked(json.loads(self.a.to_str()))
        # an id's digits with what may follow: nothing, a comma, a bar, a semicolon
        self.digits = [f"{k}{mark}".encode() for k in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ("", ",", "|", ";")]
        self.cache: dict[bytes, tuple | None] = {}

    def _ranked(self, a: dict):
        """A as an encoder by ranks, or None if its ids don't follow the order of its merges or its pattern is another one.

        It is used for units of letters up to U+024F and ASCII, for which the two libraries' character classes agree.
        """
        pre = a.get("pre_tokenizer") or {}
        if a["model"]["type"] != "BPE" or a.get("normalizer") or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
            return None
        vocabulary, special = a["model"]["vocab"], {t["content"] for t in a["added_tokens"]}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in a["model"]["merges"]]
        at = [vocabulary[m] for m in merges]
        if at != sorted(set(at)):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[k]: k for t, k in vocabulary.items() if t not in special}, special_tokens={})

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Pair:
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        out = [self.fast.encode_ordinary(t) if self.fast and (t.isascii() or max(t) < "\u0250") else None for t in texts]
        if rest := [k for k, ids in enumerate(out) if ids is None]:
            for k, found in zip(rest, self.a.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = found.ids
        return out

    def tokens(self, units: list[bytes]) -> tuple[list[bool], np.ndarray, np.ndarray, Owners]:
        """Which units both sides spell byte by byte, the ends of each one's A and B tokens among all, and the tokens of those units."""
        texts = [u.decode("utf-8", "replace") for u in units]
        skip = len(self.before)
        a_ids, b_ids = self.a_ids(texts), [ids[skip:] for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        spelled = [b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y)) for u, x, y in zip(units, a_ids, b_ids, strict=True)]
        if not all(spelled):
            a_ids, b_ids = ([ids if ok else [] for ids, ok in zip(side, spelled, strict=True)] for side in (a_ids, b_ids))
        a = np.fromiter(itertools.chain.from_iterable(a_ids), dtype=np.int64)
        b = np.fromiter(itertools.chain.from_iterable(b_ids), dtype=np.int64)
        return spelled, np.cumsum([len(x) for x in a_ids]), np.cumsum([len(x) for x in b_ids]), Owners(a, b, np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))

    def learn(self, units: list[bytes]) -> list[tuple | None]:
        spelled, a_end, b_end, owners = self.tokens(units)
        owners.align()
        ends = np.cumsum([len(u) if ok else 0 for u, ok in zip(units, spelled, strict=True)])
        parts = self.text_of(owners, ends)
        cuts = (8 * np.searchsorted(owners.a_cut, a_end, side="left")).tolist()
        links = ((owners.a[owners.a_cut] << 32) | owners.b[owners.b_cut]).tobytes()
        tokens, a_n, b_n = (a_end + b_end).tolist(), np.diff(a_end, prepend=0).tolist(), np.diff(b_end, prepend=0).tolist()
        froms = zip([0, *tokens], tokens, [0, *cuts], cuts, strict=False)
        return [(x, y, b"".join(parts[t0:t1]), links[c0:c1]) if ok else None for ok, x, y, (t0, t1, c0, c1) in zip(spelled, a_n, b_n, froms, strict=True)]

    def text_of(self, owners: Owners, ends: np.ndarray) -> list[bytes]:
        """The digits of all ids, A's and B's of each group, with the mark that follows; none at the ends of units."""
        n, m = len(owners.a), len(owners.b)
        a_group = np.searchsorted(owners.a_cut, np.arange(n), side="left")
        b_group = np.searchsorted(owners.b_cut, np.arange(m), side="left")
        codes = np.empty(n + m, dtype=np.int64)
        a_mark = np.ones(n, dtype=np.int64)
        a_mark[owners.a_cut] = 2
        b_mark = np.ones(m, dtype=np.int64)
        b_mark[owners.b_cut] = np.where(np.isin(owners.b_ends[owners.b_cut], ends), 0, 3)
        codes[np.arange(n) + np.append(0, owners.b_cut + 1)[a_group]] = owners.a * 4 + a_mark
        codes[np.arange(m) + (owners.a_cut + 1)[b_group]] = owners.b * 4 + b_mark
        return list(map(self.digits.__getitem__, codes.tolist()))

    def of_units(self, keys: list[bytes]) -> list[tuple | None]:
        found = [self.cache.get(k, 0) for k in keys]
        if missing := [k for k, x in enumerate(found) if x == 0]:
            if len(self.cache) > CACHE_UNITS:
                self.cache.clear()
            for lo in range(0, len(missing), 4000):
                part = missing[lo : lo + 4000]
                for k, x in zip(part, self.learn([keys[k] for k in part]), strict=True):
                    found[k] = x
                    if len(keys[k]) <= CACHED_LENGTH:
                        self.cache[keys[k]] = x
        return found


def unit_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where units start in texts that each begin with a blank.

    At that; at a blank between two characters other than blanks; between an ASCII letter and a mark or line end, either way
    (after a line end only where no other white space stands before it).
    """
    start = np.zeros(len(data), dtype=bool)
    blank, letter, mark, line = data == 0x20, _LETTER[data], _MARK[data], data == _LINE
    start[1:] = (letter[:-1] & (mark[1:] | line[1:])) | (mark[:-1] & letter[1:])
    # 0x81 may end B's blank mark
    start[1:-1] |= blank[1:-1] & _OPENS[data[2:]] & ~blank[:-2] & (data[:-2] != 0x81)
    start[2:] |= (letter | mark)[:-2] & line[1:-1] & letter[2:]
    start[np.minimum(offsets[1:], len(data)) - 1] &= ~blank[np.minimum(offsets[1:], len(data)) - 1]  # the blank ends a text
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


def with_blanks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, bytes, which have text) for runs of rows, with a blank before each text that isn't empty."""
    for lo, hi, offsets, data in groups(column):
        there = np.diff(offsets) > 0
        out = np.full(len(data) + int(there.sum()), 0x20, dtype=np.uint8)
        shift = np.cumsum(there)
        out[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
        yield lo, hi, offsets + np.append(0, shift), out, there


class Slice:
    """The distinct units of some texts. inverse: the unit of each place; first: the place where each text with units starts, and the end."""

    def __init__(self, pair: Pair, offsets: np.ndarray, data: np.ndarray, there: np.ndarray) -> None:
        offsets = offsets[np.append(there, True)]
        starts = unit_starts(offsets, data) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        raw = data.tobytes()
        _, at, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if not same_words(data, starts, ends, at[inverse]):  # different units of one hash
            number: dict[bytes, int] = {}
            inverse = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            at = np.unique(inverse, return_index=True)[1]
        self.inverse, self.first = inverse, np.searchsorted(starts, offsets)
        self.keys = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        self.found = pair.of_units(self.keys)
        self.bad = np.array([x is None for x in self.found], dtype=bool)

    def per_text(self, of_unit: np.ndarray) -> np.ndarray:
        """The sum over each text's units."""
        return np.add.reduceat(of_unit[self.inverse], self.first[:-1]) if len(self.first) > 1 else np.zeros(0, of_unit.dtype)

    def whole(self) -> np.ndarray:
        """Which texts have tokens."""
        return self.per_text(self.bad.astype(np.int64)) == 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of all distinct units, and how many each unit has."""
        raw = [b"" if x is None else x[3] for x in self.found]
        return np.frombuffer(b"".join(raw), dtype=np.int64), np.array([len(r) >> 3 for r in raw], dtype=np.int64)

    def sums(self, of_link: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of a number of each link over each unit."""
        total = np.append(0, np.cumsum(of_link))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _tally(paths: tuple[str, str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, size = Pair.of(paths), [], 0

        def out() -> pa.RecordBatch:
            keys, times = _sum_up(held)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["pair", "times"])

        for batch in batches:
            for _, _, offsets, data, there in with_blanks(batch.column(0)):
                s = Slice(pair, offsets, data, there)
                used = np.repeat(s.whole(), np.diff(s.first))
                keys, sizes = s.links()
                times = np.repeat(np.bincount(s.inverse[used], minlength=len(s.keys)), sizes)
                held.append((keys[times > 0], times[times > 0]))
                size += len(held[-1][0])
                if size > limit:
                    held[:] = [_sum_up(held)]
                    if len(held[0][0]) > limit // 2:
                        yield out()
                        held.clear()
                    size = sum(len(k) for k, _ in held)
        if held:
            yield out()

    return run


def pair_counts(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None, tally: int = TALLY) -> DataFrame:
    """(pair, times, best): corpus-wide counts of linked ids, pair being A's id times 2^32 plus B's; best where no other pair of that B id has more."""
    ship(docs.sparkSession)
    paths = paths or (tokenizer_path(A_NAME), tokenizer_path(B_NAME))
    counts = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_tally(paths, tally), "pair bigint, times bigint").groupBy("pair").agg(F.sum("times").alias("times"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "align-counts")
    top = counts.groupBy("b").agg(F.max("times").alias("top"))
    return counts.join(top, "b").select("pair", "times", (F.col("times") == F.col("top")).alias("best"))


def _measures(paths: tuple[str, str], table, with_pairs: bool):
    """Batches, their first column the text, to what `Pair` finds in it; table: a broadcast of (pairs, times, best), sorted by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(paths)
        if table is not None:
            pairs, times, best = table.value
        for batch in batches:
            for lo, hi, offsets, data, there in with_blanks(batch.column(0)):
                s = Slice(pair, offsets, data, there)
                ok = s.whole()
                row = np.flatnonzero(there)
                keys, sizes = s.links()
                found = {"n_a": np.array([x[0] if x else 0 for x in s.found], np.int64), "n_b": np.array([x[1] if x else 0 for x in s.found], np.int64), "n_links": sizes}
                if table is not None:
                    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1) if len(keys) else np.zeros(0, np.int64)
                    known = pairs[at] == keys  # units of texts that have no tokens as a whole may have others
                    found |= {"n_best": s.sums((best[at] & known).astype(np.int64), sizes), "count_sum": s.sums(np.where(known, times[at], 0), sizes)}
                columns = {}
                for name, of_unit in found.items():
                    values = np.zeros(hi - lo, np.int64)
                    values[row] = np.where(ok, s.per_text(of_unit), 0)
                    columns[name] = pa.array(values)
                texts = [x[2] if x else b"" for x in s.found]
                digests = [""] * (hi - lo)
                order = s.inverse.tolist()
                for r, a, b, fine in zip(row.tolist(), s.first[:-1].tolist(), s.first[1:].tolist(), ok.tolist(), strict=True):
                    if fine:
                        digests[r] = hashlib.sha256(b";".join(map(texts.__getitem__, order[a:b]))).hexdigest()
                columns["n_groups"], columns["groups_sha256"] = columns["n_links"], pa.array(digests, pa.string())
                if with_pairs:
                    spread = [keys[e - n : e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
                    own: list[list] = [[] for _ in range(hi - lo)]
                    for r, a, b, fine in zip(row.tolist(), s.first[:-1].tolist(), s.first[1:].tolist(), ok.tolist(), strict=True):
                        if fine:
                            k, n = np.unique(np.concatenate([spread[u] for u in order[a:b]]), return_counts=True)
                            own[r] = [{"pair": x, "n": y} for x, y in zip(k.tolist(), n.tolist(), strict=True)]
                    columns["_pairs"] = pa.array(own, pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))
                names = [f.name for f in batch.schema][1:]
                rest = {n: batch.column(k + 1).slice(lo, hi - lo) for k, n in enumerate(names)}
                yield pa.RecordBatch.from_pydict(rest | columns)

    return run


def _ordered(run, schema: T.StructType):
    """run, with the columns of its batches in the order of schema."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.select(schema.names)

    return ordered


def align(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    ship(spark)
    paths = paths or (tokenizer_path(A_NAME), tokenizer_path(B_NAME))
    numbers = T.StructType.fromDDL(COUNTS + ", n_best bigint, count_sum bigint")
    rest = without(docs, [text_col, *numbers.names])
    # own columns travel under names that no result has
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest.columns)])
    carried = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(rest.schema.fields)])
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(rest.columns)]
    counts = materialize(pair_counts(docs, text_col, paths), "align-best")
    if counts.count() <= broadcast_pairs:
        told = counts.sort("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(told.column(c).to_numpy() for c in ("pair", "times", "best")))
        discard(counts)
        schema = T.StructType([*carried.fields, *numbers.fields])
        return plain.mapInArrow(_ordered(_measures(paths, table, False), schema), schema).select(*back, *numbers.names)
    own = T.StructType.fromDDL(COUNTS + ", _pairs array<struct<pair:bigint,n:bigint>>")
    schema = T.StructType([*carried.fields, *own.fields])
    rows = materialize(plain.mapInArrow(_ordered(_measures(paths, None, True), schema), schema).withColumn("_row", F.monotonically_increasing_id()), "align-rows")
    each = rows.select("_row", F.inline("_pairs"))
    many = counts.withColumn("_n", F.col("times"))
    sums = join_counted(each, many, ["pair"], "_n").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return rows.drop("_pairs").join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"]).select(*back, *numbers.names)


def _spans(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(paths)
        names = ("a_ids", "b_ids", "a_cuts", "b_cuts", "overlaps")
        overlap = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))
        for batch in batches:
            rows = []
            offsets, data = buffers(batch.column(0))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                owners = None
                if b > a:
                    raw = b" " + data[a:b].tobytes()
                    starts = unit_starts(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).tolist()
                    spelled, _, _, owners = pair.tokens([raw[x:y] for x, y in zip(starts, [*starts[1:], len(raw)], strict=True)])
                    owners = owners if all(spelled) else None
                if owners is None:
                    rows.append([[], [], [], [], []])
                    continue
                owners.align()
                laps = [{"a": x, "b": y, "bytes": z} for x, y, z in zip(owners.a_at.tolist(), owners.b_at.tolist(), owners.bytes.tolist(), strict=True)]
                rows.append([owners.a.tolist(), owners.b.tolist(), (owners.a_cut + 1).tolist(), (owners.b_cut + 1).tolist(), laps])
            columns = [pa.array([r[k] for r in rows], overlap if k == 4 else pa.list_(pa.int32())) for k in range(5)]
            rest = {f.name: batch.column(k) for k, f in enumerate(batch.schema) if k}
            yield pa.RecordBatch.from_pydict(rest | dict(zip(names, columns, strict=True)))

    return run


def spans(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """docs with the ids of both sides, how many tokens of each end before or at every cut, and all overlaps of their tokens (numbers from 0)."""
    ship(docs.sparkSession)
    paths = paths or (tokenizer_path(A_NAME), tokenizer_path(B_NAME))
    own = T.StructType.fromDDL(SPANS)
    rest = without(docs, own.names)
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest.columns)])
    schema = T.StructType([*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(rest.schema.fields)], *own.fields])
    back: list[Column] = [F.col(f"c{k}").alias(c) for k, c in enumerate(rest.columns)]
    return plain.mapInArrow(_ordered(_spans(paths), schema), schema).select(*back, *own.names)
