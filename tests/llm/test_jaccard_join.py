from collections import defaultdict

import numpy as np
import pytest

from factloom.llm.components import connected_components
from factloom.llm import jaccard_join as J
from factloom.llm.jaccard_join import jaccard_components

from .conftest import SCHEMA, TEXTS


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i)) if i is not None else "None") for (i, *_), s in zip(rows, sets, strict=True))


def got(spark, rows, **kw):
    return sorted((str(r[0]), r[1], str(r[2])) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect())


@pytest.mark.parametrize("part_shingles", [4_000_000, 400])
def test_brute_force(spark, corpus, part_shingles):
    assert got(spark, corpus, part_shingles=part_shingles) == brute(corpus)


def test_edges(spark, empty):
    assert got(spark, TEXTS) == brute(TEXTS)
    assert jaccard_components(empty).count() == 0


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = []
    for k in range(0, 30):  # the last k words differ: 100 - k of 100 + k shingles are common
        rows.append((1000 * k, " ".join(f"p{k}{w}" for w in words), "", ""))
        rows.append((1000 * k + 1, " ".join([f"p{k}{w}" for w in words[: 104 - k]] + [f"q{k}{i}" for i in range(k)]), "", ""))
    result = {int(i): int(c) for i, _, c in got(spark, rows)}
    for k in range(0, 30):
        assert (result[1000 * k + 1] == 1000 * k) == (100 * (100 - k) >= 80 * (100 + k))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(200, 100 + i) for i in range(20)] + [(7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), task_nodes=5).collect()}
    groups = defaultdict(set)
    for n, c in found.items():
        groups[c].add(n)
    assert groups == {0: set(range(51)), 100: {200, *range(100, 120)}}


def test_tree_prunes_node_pairs():
    """Unrelated sets are dropped as nodes: few pairs of sets are left to verify, and none that links."""
    r = np.random.default_rng(3)
    items, sizes = [], r.integers(40, 60, 300)
    for k in range(100):
        base = r.integers(0, 1 << 63, int(sizes[k]), dtype=np.uint64)
        for c in range(3):  # three near copies
            s = base.copy()
            s[:c] = r.integers(0, 1 << 63, c, dtype=np.uint64)
            items.append((3 * k + c, np.unique(s)))
    sets = J.Union()
    tree = J.join_items(items, sets, 4, 5)
    assert {a: sets.find(a) for a, _ in items} == {a: a - a % 3 for a, _ in items}
    assert tree.pruned > 0.5 * tree.seen and tree.verified < 0.001 * len(items) ** 2
