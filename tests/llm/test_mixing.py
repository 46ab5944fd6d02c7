import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert M.targets([0, 10], [3, 1]) == pytest.approx([0, 15])
    assert M.targets([], []) == []
    t = M.targets([10, 1000, 1000], [3, 1, 2])
    assert t[0] == 20 and sum(t) == pytest.approx(3015)


def test_flow_is_cheapest():
    r = random.Random(3)
    for _ in range(30):
        caps = [r.randint(0, 4) for _ in range(3)]
        patterns = [(frozenset(r.sample(range(2), r.randint(1, 2))), c) for c in caps]
        quotas = [r.randint(0, 6) for _ in range(2)]
        flow = M.min_cost_flow(patterns, quotas)
        most = (-1, 0)
        options = [[(a, b) for a in range(2 * c + 1) for b in range(2 * c + 1 - a) if (a == 0 or 0 in s) and (b == 0 or 1 in s)] for s, c in patterns]
        for choice in product(*options):
            if sum(a for a, _ in choice) <= quotas[0] and sum(b for _, b in choice) <= quotas[1]:
                cost = sum(max(0, a + b - c) for (a, b), c in zip(choice, caps, strict=True))
                most = max(most, (sum(a + b for a, b in choice), -cost))
        got = sum(sum(f.values()) for f in flow)
        cost = sum(max(0, sum(f.values()) - c) for f, c in zip(flow, caps, strict=True))
        assert (got, -cost) == most
        for j, q in enumerate(quotas):
            assert sum(f.get(j, 0) for f in flow) <= q


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_corpus(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string").repartition(5)
    got = M.mix(docs, F.array("source"))
    one = rows_of(got)
    assert one == rows_of(M.mix(docs.repartition(2), F.array("source")))  # reruns agree
    by = {}
    for r in got.collect():
        assert r.size == len((r.text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size)
        s = by.setdefault(r.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] += r.size
    for taken, target, size in by.values():
        assert abs(taken - target) <= 3 + 0.005 * target and target <= 2 * size


def test_overlap_and_edges(spark, docs, empty):
    got = M.mix(docs, F.array("source"))
    assert got.count() == docs.count() and got.where("taken > 2 * size").count() == 0
    both = M.mix(docs, F.when(F.col("source") == "a", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source")))
    assert both.count() == docs.count() and both.where("taken > 2 * size").count() == 0
    assert M.mix(empty, F.array("source")).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, F.array("source"), max_patterns=1)


def test_refinement(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string")
    monkeypatch.setattr(M, "SMALL", 3)
    monkeypatch.setattr(M, "BITS", 2)
    for taken, target in M.mix(docs, F.array("source")).groupBy("source").agg(F.sum("taken"), F.max("target")).select("sum(taken)", "max(target)").collect():
        assert abs(taken - target) < 400


def test_remainder_is_filled_from_all_documents(spark, monkeypatch):
    # half of 1600 words again: the long document never fits, all 200 short ones do
    docs = spark.createDataFrame([(0, "w " * 1000, "s")] + [(i, "a b c", "s") for i in range(1, 201)], "doc_id bigint, text string, source string")
    monkeypatch.setattr(M, "SMALL", 3)
    monkeypatch.setattr(M, "BITS", 4)
    for seed in (0, 1):
        assert M.mix(docs, F.array("source"), seed=seed).agg(F.sum("taken")).first()[0] == 2200


def test_flow_of_many_patterns_is_fast():
    import time

    r = random.Random(1)
    patterns = [(frozenset(r.sample(range(60), r.randint(1, 4))), r.randint(1, 1000)) for _ in range(10_000)]
    quotas = [3 * sum(c for _, c in patterns) // 120] * 60
    began = time.perf_counter()
    flow = M.min_cost_flow(patterns, quotas)
    assert time.perf_counter() - began < 10
    assert all(sum(f.values()) <= 2 * c and f.keys() <= s for f, (s, c) in zip(flow, patterns, strict=True))
    assert sum(sum(f.values()) for f in flow) == sum(quotas)


def test_words_in(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0c\r\nd ", "a\u00a0b \u2003 c", "x" * 100]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3).select("i", M.words_in("t").alias("n")).collect()
    assert [r.n for r in sorted(got)] == [len((t or "").encode().split()) for t in texts]


def test_selection_matches_brute_force(spark, corpus, monkeypatch):
    """Overlapping sources: each pattern's documents are taken in the order of their draws while they fit what the flow gives it."""
    monkeypatch.setattr(M, "SMALL", 4)
    monkeypatch.setattr(M, "BITS", 3)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string")
    members = F.when(F.col("source") == "s0", F.array(F.lit("s0"), F.lit("s1"))).when(F.col("source") == "s2", F.array(F.lit("s1"), F.lit("s2"), F.lit(None))).otherwise(F.array("source"))
    got = {r.doc_id: r for r in M.mix(docs, members).collect()}
    groups = {}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(0), F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text")), F.concat_ws("\x00", F.array_sort(F.array_distinct(F.transform(members, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("null"))))))), 4)
    for r in docs.select("doc_id", draw.alias("draw"), F.array_join(members, ",", "null").alias("m")).collect():
        groups.setdefault(r.m, []).append((r.draw, r.doc_id))
    names = ["s0", "s1", "s2", "s3", "s4", None]
    of = {m: frozenset(names.index(None if x == "null" else x) for x in m.split(",")) for m in groups}
    patterns = [(of[m], sum(got[i].size for _, i in g)) for m, g in groups.items()]
    sizes = [sum(c for s, c in patterns if k in s) for k in range(6)]
    flow = M.min_cost_flow(sorted(patterns, key=lambda x: [("null" if names[k] is None else "=" + names[k]) for k in sorted(x[0])]), [round(t) for t in M.targets(sizes, [3, 1, 2, 3, 1, 2])])
    total = dict(zip([s for s, _ in sorted(patterns, key=lambda x: [("null" if names[k] is None else "=" + names[k]) for k in sorted(x[0])])], [sum(f.values()) for f in flow], strict=True))
    for m, group in groups.items():
        capacity = sum(got[i].size for _, i in group)
        whole, left = min(2, total[of[m]] // capacity), total[of[m]] % capacity if total[of[m]] < 2 * capacity else 0
        for _, i in sorted(group):
            more = 0 < got[i].size <= left
            left -= got[i].size if more else 0
            assert got[i].copies == whole + more
