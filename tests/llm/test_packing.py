import random
import zlib

import numpy as np

from factloom.llm import packing as P

from .conftest import SCHEMA, TEXTS


def expected(texts, capacity):
    tokenizer = P.Tokens.of(P.tokenizer_path()).tokenizer
    out = []
    for t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out += [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], dtype="<u4").tobytes())) for k in range(0, len(ids), capacity)]
    return sorted(out)


def check(spark, rows, **kw):
    capacity = kw.get("capacity", P.CAPACITY)
    got = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), **kw).toPandas()
    assert sorted(zip(got.piece, got.start, got.length, got.ids_crc32, strict=True)) == expected([r[1] for r in rows], capacity)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity
    return got


def test_edges(spark, empty):
    check(spark, TEXTS)
    check(spark, TEXTS, capacity=7, slack=0)
    assert P.pack(empty).count() == 0


def test_few_sequences(spark, corpus):
    for capacity in (512, 4096):
        got = check(spark, corpus, capacity=capacity, slack=0)
        least = -(-got.length.sum() // capacity)
        assert got.sequence_id.nunique() <= least * 1.03 + 1
    check(spark, corpus, capacity=512, round_items=20, fan_in=2)


def test_sequences(spark, corpus):
    packed = P.pack(spark.createDataFrame(corpus[:40], SCHEMA), with_ids=True)
    for r in P.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_tokens


def test_best_fit_against_scan():
    r = random.Random(1)
    for _ in range(50):
        lengths = [r.randint(1, 50) for _ in range(60)]
        where, at, fill = P.best_fit(lengths, 50)
        bins = []
        for size in sorted(lengths, reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] + size <= 50]
            if fits:
                bins[max(fits, key=lambda b: bins[b])] += size
            else:
                bins.append(size)
        assert sorted(fill) == sorted(bins)


def test_tokens_match_tokenizer():
    tokens = P.Tokens(P.tokenizer_path())
    texts = [t for _, t, *_ in TEXTS] + ["It's we'll I'M. ok,. a.b, É. é. ΑΣ. x\x1cy  z", "…", " "]
    texts += [f"{chr(c) * 3} a{chr(c)}. {chr(c).upper()}b, {chr(c)}" for c in range(33, 1500)]
    for _ in range(2):
        for t, got in zip(texts, tokens.ids(texts), strict=True):
            assert got == np.array(tokens.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
