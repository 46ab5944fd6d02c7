import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import embedding_dedup as E
from factloom.llm import queries as Q

SCHEMA = "vec_id bigint, embedding array<float>"


def expected(rows, threshold=0.9):
    """(id, n_links, component) of every row, by all pairs."""
    ok = [bool(v) and all(e is not None and np.isfinite(e) for e in v) and any(v) for _, v in rows]
    x = [np.array(v, dtype=np.float32).astype(float) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    x = [None if v is None else v / np.sqrt((v * v).sum()) for v in x]
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for size in {len(v) for v in x if v is not None}:
        own = [k for k in range(n) if x[k] is not None and len(x[k]) == size]
        m = np.stack([x[k] for k in own])
        near[np.ix_(own, own)] = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        if np.array_equal(least, label):
            break
        label = least
    groups: dict[int, list] = {}
    for k in range(n):
        groups.setdefault(label[k], []).append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k][0], int(near[k].sum()), least[label[k]]) for k in range(n)), key=str)


def got(frame):
    rows = frame.select("vec_id", "n_links", "component_id", "kept").collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def table(seed, n=1200, dim=16):
    """Random vectors, equal ones, tight and loose crowds, chains and pairs near the threshold."""
    r = np.random.default_rng(seed)
    rows = [r.standard_normal(dim) for _ in range(n // 3)]
    rows += [rows[k % 7] for k in range(n // 8)]
    for spread, size in ((0.02, n // 6), (0.05, n // 10), (0.09, n // 10)):
        c = r.standard_normal(dim)
        c /= np.sqrt(c @ c)
        rows += [c + spread * r.standard_normal(dim) for _ in range(size)]
    while len(rows) < n:
        a = r.standard_normal(dim)
        a /= np.sqrt(a @ a)
        b = r.standard_normal(dim)
        b -= (a @ b) * a
        b /= np.sqrt(b @ b)
        rows += [a, *[np.cos(t) * a + np.sin(t) * b for t in np.cumsum(r.uniform(0.3, 0.55, 3))]]
    order = r.permutation(len(rows))
    return [(int(k), [float(e) for e in np.float32(rows[j])]) for k, j in enumerate(order)]


@pytest.mark.parametrize("seed", [1])
def test_against_all_pairs(spark, seed):
    rows = table(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    small = {"trees": 12, "leaf_items": 60, "overlap": 0.12, "crowd": 16, "chunk": 128, "block": 20, "levels": 2, "sample": 200}
    want = expected(rows)
    found = got(E.near_duplicates(frame, **small))
    links, missed = sum(w[1] for w in want), sum(abs(w[1] - f[1]) for w, f in zip(want, found, strict=True))
    assert missed <= 0.005 * links and all(f[1] <= w[1] for w, f in zip(want, found, strict=True))
    # one leaf a tree, balls and all: every link
    assert got(E.near_duplicates(frame, crowd=16, chunk=128, block=20)) == want
    assert got(E.near_duplicates(frame, crowd=10**6)) == want


def test_splits_by_shuffle(spark):
    frame = spark.createDataFrame(table(3, 400), SCHEMA)
    small = {"trees": 3, "leaf_items": 40, "crowd": 16, "chunk": 128, "levels": 2}
    assert got(E.near_duplicates(frame, broadcast_splits=0, **small)) == got(E.near_duplicates(frame, **small))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.1]), (None, None), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e30, 1e30]), (12, [1e-30, 1e-30]), (13, [-0.0, 1.0]), (14, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(E.near_duplicates(frame)) == expected(rows)
    doubles = frame.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert got(E.near_duplicates(doubles)) == expected(rows)
    assert E.near_duplicates(frame.limit(0)).count() == 0


def test_columns(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], SCHEMA).withColumns({"kept": F.lit("own"), "vec": F.lit(1), "item": F.lit(2), "size": F.lit(3)})
    out = E.near_duplicates(frame)
    assert out.columns == ["vec_id", "embedding", "vec", "item", "size", "n_links", "component_id", "kept"]
    assert {(r.vec, r.item, r.size, r.n_links, r.component_id) for r in out.collect()} == {(1, 2, 3, 1, 1)}


def test_query(spark, tmp_path):
    rows = table(5, 600)
    spark.createDataFrame([(i, v, 1) for i, v in rows], f"{SCHEMA}, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(Q.QUERIES["op12_embedding_near_dedup"](spark, str(tmp_path))) == expected(rows)


def test_recall_of_pairs_at_the_threshold():
    """With the query's parameters, in a table of 50,000 random vectors, pairs of exactly the threshold's angle share a leaf."""
    r, n = np.random.default_rng(0), 50_000
    x = r.standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for k in range(0, 1000, 2):
        y = x[k + 1] - (x[k] @ x[k + 1]) * x[k]
        x[k + 1] = 0.9 * x[k] + np.sqrt(1 - 0.81) * y / np.sqrt(y @ y)
    pick, met = r.choice(n, E.SAMPLE, replace=False), np.zeros(500, dtype=bool)
    for tree in range(E.TREES):
        bounds = E._thresholds(x[pick], tree, 0, E.LEVELS, E.OVERLAP, E.LEAF_ITEMS * E.SAMPLE / n)
        row, node = E._place(x[:1000], np.zeros(1000), bounds, tree, 0, E.LEVELS)
        own = [set(node[row == k]) for k in range(1000)]
        met |= np.array([bool(own[k] & own[k + 1]) for k in range(0, 1000, 2)])
    assert met.mean() >= 0.99
