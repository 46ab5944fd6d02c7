import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import alignment as A
from factloom.llm import queries as Q

from .conftest import SCHEMA, TEXTS

PATHS = (A.tokenizer_path(A.A_NAME), A.tokenizer_path(A.B_NAME))
ODD = ["x▁y z", " leading", "two  blanks", "a b  c", "line\nbreak \n next", "tab\tand \x00 nul", "don't we'll", "<0x41> <s> </s> <unk> <|endoftext|>", "　wide   x", "é ́", "日本語 テキスト です", "\U0001f600 \U0001f468‍\U0001f469", " ", "   ", "a ", "1 234 5,678.", "ab▁ c", "Á b", "a \u0085b", "﻿ bom"]


def whole(text):
    """Ids, groups and links of a text, token by token and without units."""
    pair = A.Pair.of(PATHS)
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_bytes[k] for k in a) != raw or b"".join(pair.b_bytes[k] for k in b) != raw:
        return None
    ends = []
    for ids, sizes in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, own = 0, {}
        for n, k in enumerate(ids):
            at += len(sizes[k])
            own[at] = n
        ends.append(own)
    out, links, i, j = [], [], 0, 0
    for at in sorted(ends[0].keys() & ends[1].keys()):
        x, y = ends[0][at], ends[1][at]
        out.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
        links.append((a[x], b[y]))
        i, j = x + 1, y + 1
    return len(a), len(b), ";".join(out), links


def expected(texts):
    found = [whole(t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, text, links = f
        out.append((a, b, len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


@pytest.mark.parametrize("limit", [A.BROADCAST_PAIRS, 0])
def test_edges(spark, limit):
    rows = [*TEXTS, *[(100 + k, t, "en", "a") for k, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(A.align(docs, broadcast_pairs=limit)) == expected([r[1] for r in rows])


def test_corpus(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    assert got(A.align(docs)) == got(A.align(docs, broadcast_pairs=0)) == expected([r[1] for r in corpus])


def test_query(spark, corpus, tmp_path):
    rows = corpus[:80] + TEXTS
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    frame = Q.QUERIES["op13_tokenizer_alignment"](spark, str(tmp_path))
    assert got(frame) == expected([r[1] for r in rows])
    assert sorted(str(r.doc_id) for r in frame.collect()) == sorted(str(r[0]) for r in rows)


def test_random_units():
    """Texts drawn from all kinds of characters are aligned by units as they are as wholes."""
    import random

    r, pair = random.Random(3), A.Pair.of(PATHS)
    kinds = [" ", " ", " ", "a", "b", "the", "'s", ".", "1", "\n", "\t", "é", " ", " ", "　", "日", "▁", "\U0001f600", "\x85", "ß", "​", "-", " ", "﻿"]
    texts = ["".join(r.choices(kinds, k=r.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        raw = (" " + t).encode()
        starts = A.unit_starts(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).tolist()
        units = [raw[x:y] for x, y in zip(starts, [*starts[1:], len(raw)], strict=True)]
        assert b"".join(units) == raw
        found, want = pair.learn(units), whole(t)
        if want is None:
            assert None in found, t
        else:
            assert (sum(f[0] for f in found), sum(f[1] for f in found), b";".join(f[2] for f in found).decode()) == want[:3], t


def test_spans(spark, docs):
    found = A.spans(docs).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        want = whole(r.text)
        if want is None:
            assert r.a_ids == r.b_ids == r.overlaps == []
            continue
        i = j = 0
        parts = []
        for x, y in zip(r.a_cuts, r.b_cuts, strict=True):
            parts.append(",".join(map(str, r.a_ids[i:x])) + "|" + ",".join(map(str, r.b_ids[j:y])))
            i, j = x, y
        assert ";".join(parts) == want[2]
        assert sum(o.bytes for o in r.overlaps) == len(r.text.encode()) + 1
        assert len({(o.a, o.b) for o in r.overlaps}) == len(r.overlaps)


def test_columns_and_empty(spark, docs, empty):
    named = docs.withColumn("n_a", F.lit("own")).withColumn("_text", F.lit(1)).withColumn("c0", F.lit(2))
    frame = A.align(named)
    assert frame.columns == ["doc_id", "lang", "source", "_text", "c0", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert {(r._text, r.c0) for r in frame.collect()} == {(1, 2)}
    assert A.align(empty).count() == A.spans(empty).count() == 0


def test_long_text(spark):
    """A text of several slices, and one that is a single unit."""
    texts = ["lorem ipsum dolor " * 200_000, "x" * 100_000]
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], SCHEMA)
    assert got(A.align(docs)) == expected(texts)
