import hashlib
from collections import defaultdict

from factloom.llm.exact_dedup import exact_dedup, normalise

from .conftest import SCHEMA


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normalise(r[1])].append(r[0])
    return groups


def check(spark, rows, **bounds):
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), **bounds).collect()
    groups = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[normalise(r.text)]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(ids)
        assert r.text_sha256 == hashlib.sha256(normalise(r.text)).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    kept = defaultdict(int)
    for r in got:
        kept[normalise(r.text)] += r.kept
    assert set(kept.values()) == {1}


def test_edges(spark, docs):
    from .conftest import TEXTS

    check(spark, TEXTS)


def test_corpus_and_recursion(spark, corpus):
    check(spark, corpus)
    check(spark, corpus, table_bytes=6000, merge_bytes=3000)  # several levels of buckets


def test_empty_and_clashes(spark, empty):
    assert exact_dedup(empty).count() == 0
    rows = spark.createDataFrame([(1, "a", True, 5), (2, "A", False, 6)], "doc_id bigint, text string, KEPT boolean, _n2 int")
    got = {r.doc_id: r.kept for r in exact_dedup(rows).collect()}
    assert got == {1: False, 2: True}
