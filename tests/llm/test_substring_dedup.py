import hashlib
import random

import numpy as np
import pytest

from factloom.llm import substring_dedup as S

from .conftest import SCHEMA, TEXTS


def brute(rows, window):
    seen, out = set(), []
    for i, t in sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, window):
    return sorted((str(r[0]), r[1], r[2], r[3]) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window=window).collect())


@pytest.mark.parametrize("window", [20, 5])
def test_brute_force(spark, corpus, window):
    assert got(spark, corpus, window) == brute(corpus, window)


def test_small_alphabet(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices("ab", k=r.randint(0, 120))), "", "") for i in range(40)] + [(100 + i, "a " * r.randint(1, 90), "", "") for i in range(10)]
    assert got(spark, rows, 20) == brute(rows, 20)


def test_edges(spark, empty):
    assert got(spark, TEXTS, 3) == brute(TEXTS, 3)
    assert S.remove_repeats(empty).count() == 0


def test_symbols_recur_with_their_words():
    r = random.Random(2)
    names = np.array(r.choices(range(1, 30), k=4000), dtype=np.uint64)
    both = np.concatenate([names, np.array([99], np.uint64), names[700:900]])
    first = np.array([0, 4001, len(both)])
    doc = np.repeat([0, 1], [4001, 200])
    name, left, right = S.compress(both, doc, first, 20)
    inner = {(n, a - 700, b - 700) for n, a, b in zip(name.tolist(), left.tolist(), right.tolist(), strict=True) if a >= 700 and b < 900}
    again = {(n, a - 4001, b - 4001) for n, a, b in zip(name.tolist(), left.tolist(), right.tolist(), strict=True) if a >= 4001}
    assert inner == again and len(inner) > 20


def test_kept_text(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = {r.doc_id: r.kept_text for r in S.remove_repeats(spark.createDataFrame([(1, t, "", ""), (2, f"x {t} y", "", "")], SCHEMA), with_text=True).collect()}
    assert rows == {1: t, 2: "x y"}
