from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import artifacts, hash_tree, integrity, membership, rules


def versions(spark, n=40_000):
    """Two versions of n artifacts of which one in a thousand has changed, in turn stale, missing and extra."""
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("f"), "id").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    changed = F.when(F.col("id") % 1000 == 7, F.floor(F.col("id") / 1000).cast("int") % 3).otherwise(-1)
    want = rows.where(changed != 2).select("name", "sha256")
    have = rows.where(changed != 1).select("name", F.when(changed == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return want, have


def counted(df):
    return Counter(tuple(str(x) for x in r) for r in df.collect())


def test_drift_of_all_kinds(spark):
    want, have = versions(spark)
    plain = counted(artifacts.drift(want, have))
    assert {s for _, s in plain} == {"OK", "STALE", "MISSING", "EXTRA"}
    assert counted(hash_tree.drift(want, have)) == plain
    assert counted(hash_tree.drift(want, have, changes_only=True)) == Counter({k: n for k, n in plain.items() if k[1] != "OK"})


def test_few_rows_are_compared(spark):
    want, have = versions(spark)
    n = want.count()
    ranges, depth = hash_tree.differing(*hash_tree.trees(want, have, ["name"]))
    for side in (want, have):
        same, compared = hash_tree.divide(side, ["name"], ranges, depth)
        assert same.count() + compared.count() == side.count() and compared.count() < 0.02 * n
        plan = compared._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_nulls_ties_and_empty_tables(spark):
    schema = "name string, sha256 string"
    a = spark.createDataFrame([("a", "1"), ("b", None), (None, "3"), ("d", "4"), ("e", "5")], schema)
    b = spark.createDataFrame([("a", "1"), ("b", None), (None, "3"), ("d", "x"), ("f", None)], schema)
    none = a.limit(0)
    for x, y in ((a, b), (b, a), (a, a), (a, none), (none, b), (none, none)):
        assert counted(hash_tree.drift(x, y)) == counted(artifacts.drift(x, y))


def test_multisets(spark):
    schema = "k int, v string, w array<string>"
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, ["y"]), (3, "z", [None, "a"]), (4, None, []), (None, None, None)] * 2, schema)
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "z", ["a", None]), (4, None, []), (4, None, []), (None, None, None)], schema)
    for x, y in ((a, b), (b, a), (a, a), (a, a.limit(0))):
        assert counted(hash_tree.multiset_difference(x, y)) == counted(rules.multiset_difference(x, y))


@pytest.mark.parametrize("depths", [(3, 11), (17, 9), (0, 8), (8, 8), (16, 16)])
def test_kept_trees_of_unlike_depths(spark, tmp_path, depths):
    want, have = versions(spark, 5000)
    for side, depth, name in zip((want, have), depths, "ab", strict=True):
        hash_tree.build(side, ["name"], depth, f"{tmp_path}/{name}")
    kept = tuple(hash_tree.load(spark, f"{tmp_path}/{x}") for x in "ab")
    assert tuple(t.depth for t in kept) == depths
    assert counted(hash_tree.drift(want, have, kept)) == counted(artifacts.drift(want, have))


def test_folded_bitmap(spark, monkeypatch):
    """More ranges than the bitmap has places: more rows are compared, with the same result."""
    monkeypatch.setattr(hash_tree, "BITS", 5)
    want, have = versions(spark, 5000)
    assert counted(hash_tree.drift(want, have)) == counted(artifacts.drift(want, have))


def test_triples(spark):
    schema = "subject string, predicate string, object string, relation_status string, qualifiers string, evidence array<struct<source_id string>>"
    edges = spark.createDataFrame([(f"s{k % 5}", "p", f"o{k}", "reviewed", '{"source_atom_id":"A%d"}' % k, [("x",)]) for k in range(60)], schema)
    from factloom.operators.graph import triples

    stored = triples(edges.where("object <> 'o3'")).unionByName(triples(edges.where("object = 'o9'")))
    assert counted(integrity.triples_differ(stored, edges, by_ranges=True)) == counted(integrity.triples_differ(stored, edges))
    assert integrity.triples_differ(stored, edges, by_ranges=True).count() == 2


def test_absences(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 500 != 3, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    known = spark.range(0, 50_000, 97).select(F.col("id").alias("x"), (F.col("id") % 7).cast("string").alias("y")).unionByName(spark.createDataFrame([(None, "1")], "x bigint, y string"))
    for keys in ({"a": "x"}, {"a": "x", "b": "y"}):
        assert counted(rules.not_in(rows, keys, known, sparse=True)) == counted(rules.not_in(rows, keys, known))
        sure, maybe = membership.split(rows, keys, known)
        # partners, and chance agreements of about 516 keys with 2 ** 24 places
        assert maybe.count() < 540 and sure.count() + maybe.count() == 50_000
    other = known.withColumn("x", F.col("x").cast("int"))
    assert counted(rules.not_in(rows, {"a": "x"}, other, sparse=True)) == counted(rules.not_in(rows, {"a": "x"}, other))
    assert rules.not_in(rows, {"a": "x"}, known.limit(0), sparse=True).count() == 50_000
    assert rules.not_in(rows.limit(0), {"a": "x"}, known, sparse=True).count() == 0
    a, b = rows.select("a"), known.select(F.col("x").alias("a"))
    assert counted(rules.missing_and_extra(a, b, "a", sparse=True)) == counted(rules.missing_and_extra(a, b, "a"))


def test_multiset_difference_reads_each_side_once(spark):
    from collections import Counter

    a = spark.createDataFrame([(k % 5, "x" if k % 3 else None) for k in range(60)], "a int, b string")
    b = spark.createDataFrame([(k % 7, "x" if k % 2 else None) for k in range(40)], "c int, d string")
    found = rules.multiset_difference(a, b)
    left, right = (Counter(map(tuple, x.collect())) for x in (a, b))
    want = Counter({(*k, "left"): n for k, n in (left - right).items()}) + Counter({(*k, "right"): n for k, n in (right - left).items()})
    assert Counter(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_trees_for_one_comparison_are_no_deeper_than_the_bitmap(spark):
    from unittest.mock import patch

    rows = spark.range(3000).select("id", (F.col("id") % 11).alias("v"))
    other = rows.withColumn("v", F.when(F.col("id") % 500 == 0, -1).otherwise(F.col("v")))
    with patch.object(hash_tree, "BITS", 5):
        assert hash_tree.trees(rows, other, ["id"], 1)[0].depth == 5
        assert hash_tree.multiset_difference(rows, other).count() == 12
