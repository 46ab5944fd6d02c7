import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import merkle as M
from factloom.llm import queries as Q

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def tree(leaves):
    """All levels of a run."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((level[k - 1], "") if k % 2 else ("", level[k + 1] if k + 1 < len(level) else ""))
        k //= 2
    return out


def expected(rows):
    """rows: (group, order, leaf). (group, leaf, subroot, root, path) by brute force."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append(((o is not None, o), leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x for _, x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for k, leaf in enumerate(trees[g][0]):
            out.append((g, leaf, trees[g][-1][0], top[-1][0], siblings(trees[g], k) + siblings(top, n)))
    return sorted(out, key=str)


def got(frame):
    rows = frame.collect()
    return sorted(((r.g, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in rows), key=str)


ROWS = [(g, o, H(f"{g}/{o}/{k}")) for g, n in ((None, 1), ("", 2), ("de", 3), ("en", 37), ("Ärger", 8), ("fr", 17)) for k, o in enumerate([None, *range(n - 1)])]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_against_brute_force(spark, levels):
    rows = [*ROWS, ROWS[5], ROWS[5]]
    frame = spark.createDataFrame(rows, "g string, o long, leaf string").repartition(5)
    out = M.manifest(frame, "g", ["o", "leaf"], "leaf", levels=levels)
    assert got(out) == expected(rows)
    folded = out.select("root", M.fold(F.col("leaf"), F.col("path")).alias("f"), M.fold(F.sha2("leaf", 256), F.col("path")).alias("bad")).collect()
    assert all(r.f == r.root and r.bad != r.root for r in folded)


def test_one_group_and_empty(spark):
    one = spark.createDataFrame([("x", 1, H("a"))], "g string, o long, leaf string")
    r = M.manifest(one, "g", ["o"], "leaf").first()
    assert r.subroot == r.root == r.leaf == H("a") and r.path == [] and (r.position, r.group_size) == (0, 1)
    assert M.manifest(one.limit(0), "g", ["o"], "leaf").count() == 0


def test_columns(spark):
    frame = spark.createDataFrame(ROWS, "g string, o long, leaf string").withColumns({"Path": F.lit("own"), "_pos": F.lit(7), "c0": F.lit(8)})
    out = M.manifest(frame, "g", ["o", "leaf"], "leaf")
    assert out.columns == ["g", "o", "leaf", "_pos", "c0", "position", "group_size", "subroot", "root", "path"]
    assert {(r._pos, r.c0) for r in out.collect()} == {(7, 8)} and got(out) == expected(ROWS)


def test_leaf_digest(spark):
    rows = [(1, "s", None, 5, "é"), (None, "", "de", None, None), (-3, None, "x", 7, "long " * 500_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert {r.h for r in frame.select(M.leaf_digest(*[F.col(c) for c in frame.columns]).alias("h")).collect()} == {H(*map(part, r)) for r in rows}


def test_query(spark, tmp_path):
    rows = [(k, f"s{k % 3}", None if k % 5 == 0 else "en", None if k % 4 == 0 else k, f"text {k}") for k in range(60)] + [(None, None, None, 1, None), (7, "s1", "en", 7, "text 7"), (7, "s1", "en", 7, "other")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(part, r))
    found = Q.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    want = expected([(r[2], r[0], leaf(r)) for r in rows])
    altered = {leaf(r): leaf((*r[:3], r[3] + 1, r[4])) for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert altered
    told = []
    for _, own, subroot, root, path in want:
        now = altered.get(own, own)
        for a, b in path:
            now = H(a, now, b)
        told.append((own, subroot, root, H(*[a + b for a, b in path]), now, own not in altered))
    assert sorted(told) == sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found)
