"""Texts longer than the slices that operators work on, and keys that many rows share."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import jaccard_join, mixing, packing, words
from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id bigint, text string, source string"


def long_docs():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(3, 9))) for _ in range(5000)]
    long = r.choices(vocabulary, k=450_000)
    near = list(long)
    for k in range(0, len(near), 100):
        near[k] = "zz"
    passage = long[200_000:200_030]
    return long, near, passage, [(1, " ".join(long), "a"), (2, " ".join(near), "a"), (3, " ".join(long).upper(), "b"), (4, " ".join(["one", *passage, "two"]), "b"), (5, "x" * 3_000_000, "b"), (6, None, "a")]


def test_long_texts(spark):
    long, near, passage, rows = long_docs()
    assert len(rows[0][1]) > words.SLICE
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
    sizes = {r.doc_id: r["size"] for r in mixing.mix(docs, F.array("source")).collect()}
    assert sizes == {1: 450_000, 2: 450_000, 3: 450_000, 4: 32, 5: 1, 6: 0}
    kept = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert [kept[i].keep_id for i in range(1, 7)] == [3, 2, 3, 4, 5, 6] and kept[5].text_sha256 == hashlib.sha256(b"x" * 3_000_000).hexdigest()
    shingles = lambda ws: len({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)})
    groups = {r.doc_id: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert [groups[i].component_id for i in range(1, 7)] == [1, 1, 1, 4, 5, 6] and groups[1].n_shingles == groups[3].n_shingles == shingles(long) and groups[2].n_shingles == shingles(near)
    cut = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert (cut[1].n_removed, cut[3].n_removed, cut[5].n_removed) == (0, 0, 0) and cut[4].n_removed == 30
    # every unchanged run of 99 words of the near copy repeats the first text
    assert cut[2].n_removed == len(near) - near.count("zz")
    pieces = {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    tokenizer = packing.Tokens.of(packing.tokenizer_path()).tokenizer
    for i, text, _ in rows:
        if i in (1, 4, 6):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
            assert sorted(pieces[i]) == [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], dtype="<u4").tobytes())) for k in range(0, len(ids), 4096)]
    for own in pieces.values():
        assert [p[:2] for p in sorted(own)] == [(k, 4096 * k) for k in range(len(own))] and all(p[2] == 4096 for p in sorted(own)[:-1])


def test_many_copies_and_no_list_of_them(spark, monkeypatch):
    """Beyond COPIED all copies send their signatures; a third of the rows is one text, another a group of near copies."""
    r = random.Random(2)
    base = [str(r.random()) for _ in range(60)]
    rows = [(i, " ".join(base), "a") for i in range(600)] + [(1000 + i, " ".join([*base[:50], f"n{i}", *base[51:]]), "a") for i in range(600)] + [(2000 + i, " ".join(str(r.random()) for _ in range(20)), "b") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = {i: 0 if i < 2000 else i for i, _, _ in rows}
    for copied in (500_000, 0):
        monkeypatch.setattr(jaccard_join, "COPIED", copied)
        assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs).collect()} == want


def test_null_ids_are_mixed_by_text(spark):
    rows = [(None, "w " * k, "s") for k in range(1, 120)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), F.array("source")).collect()
    assert abs(sum(x.taken for x in got) - got[0].target) <= 3
