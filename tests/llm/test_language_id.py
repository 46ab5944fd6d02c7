import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id as L

EN = "the cat sat on the mat and looked at the other one with some interest while it was raining outside"
DE = "der Hund lag unter dem Tisch und sah sich die anderen an, während es draußen regnete und stürmte"


def samples():
    rows = [(lang, " ".join(t.split()[k % 7 :] + t.split()[: k % 5]), k % 5 == 0) for k in range(60) for lang, t in (("en", EN), ("de", DE))]
    return pd.DataFrame(rows, columns=["lang", "text", "held"])


def test_probabilities_sum_to_one():
    import numpy as np

    model = L.fit(samples())
    for context in ("th", "d", ""):
        sym = L.symbols(np.array([ord(c) for c in context], dtype=np.uint32), model.alphabet) if context else np.zeros(0, np.uint64)
        h = 0
        for s in sym.tolist():
            h = h << 16 | s
        grams = np.array([h << 16 | s for s in range(len(model.alphabet) + L.FIRST)], dtype=np.uint64)
        total = np.exp(L.lookup(model, grams, len(sym) + 1).astype(float)).sum(axis=0)
        assert total == pytest.approx([1, 1], abs=1e-3)


def test_predict_and_reject():
    model = L.fit(samples())
    got = L.predict(model, pd.Series([EN, DE, None, "", "123 456 !!", "жжж ъъъ ыыы щщщ цццц фффф юююю яяяя ээээ", "the", EN * 9000]))
    assert got.lang_pred.tolist()[:5] == ["en", "de", "und", "und", "und"]
    assert got.accepted.tolist() == [True, True, False, False, False, False, True, True]
    assert got.score.between(0, 1).all() and got.score[2] == 0


def test_blocks_agree(monkeypatch):
    model = L.fit(samples())
    one = L.predict(model, pd.Series([EN * 50, DE]))
    monkeypatch.setattr(L, "BLOCK", 97)
    two = L.predict(model, pd.Series([EN * 50, DE]))
    assert one.cross_entropy.tolist() == pytest.approx(two.cross_entropy.tolist(), rel=1e-5)


def test_edges(spark, docs, empty):
    got = L.identify(docs, docs.where(L.training_rows(docs)))
    assert got.count() == docs.count() and set(L.PREDICTION.names) <= set(got.columns)
    blank = {r.lang_pred for r in got.where("doc_id in (3, 4, 5)").collect()}
    assert blank == {"und"}
    assert L.identify(empty, empty).count() == 0
    unlabelled = L.identify(docs, empty).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and not any(r.accepted for r in unlabelled)
    clash = docs.withColumn("SCORE", F.lit("x"))
    assert [c.lower() for c in L.identify(clash, docs).columns].count("score") == 1


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(rows, rows.where(L.training_rows(rows))).toPandas()
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.accepted.mean() > 0.99


def brute_entropy(texts, alphabet, cp):
    """Nats per symbol by dictionaries: interpolated Kneser-Ney straight from its definition."""
    import math
    from collections import Counter, defaultdict

    def of(c):
        return [L.OTHER if x == 32 else (alphabet.index(x) + L.FIRST if x in alphabet else L.NEW) for x in c.tolist()]

    alphabet = alphabet.tolist()
    grams = [Counter() for _ in range(L.ORDER + 1)]
    for c in texts:
        s = [L.PAD] * (L.ORDER - 1) + of(c)
        for i in range(L.ORDER, len(s)):
            grams[L.ORDER][tuple(s[i - L.ORDER + 1 : i + 1])] += 1
    for k in range(L.ORDER - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k in range(1, L.ORDER + 1):
        n1, n2 = (sum(1 for n in grams[k].values() if n == x) for x in (1, 2))
        discount[k] = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
        for g, n in grams[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / (len(alphabet) + L.FIRST)
        k, context = len(g), g[:-1]
        lower = p(g[1:])
        if context not in total or not total[context]:
            return lower
        return max(0, grams[k][g] - discount[k] if g in grams[k] else 0) / total[context] + discount[k] * kinds[context] / total[context] * lower

    s = [L.PAD] * (L.ORDER - 1) + of(cp)
    at = range(L.ORDER, len(s))
    return -sum(math.log(p(tuple(s[i - L.ORDER + 1 : i + 1]))) for i in at) / len(at)


def test_model_matches_dictionaries():
    model = L.fit(samples())
    for text in (EN, "the dog", "Hündchen und cats qqq", "ж x", "a"):
        got = L.cross_entropy(model, L.codes(text))
        for j, lang in enumerate(model.langs):
            of = [L.codes(t) for x, t, held in samples().itertuples(index=False) if x == lang and not held]
            assert got[j] == pytest.approx(brute_entropy(of, model.alphabet, L.codes(text)), rel=1e-4)


def test_spark_training_is_the_same(spark):
    """The query's rows by a model that is fitted and applied in this process."""
    rows = samples().drop(columns="held").assign(doc_id=range(120))
    df = spark.createDataFrame(rows).repartition(3)
    got = {r.doc_id: r for r in L.identify(df, df).collect()}
    held = {r.doc_id: r.h for r in df.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibrate")), F.lit(5)) == 0).alias("h")).collect()}
    model = L.fit(rows.assign(held=[held[i] for i in rows.doc_id]))
    want = L.predict(model, rows.text)
    assert all(got[i].lang_pred == w.lang_pred and got[i].score == pytest.approx(w.score) and got[i].accepted == w.accepted for i, w in enumerate(want.itertuples()))


def test_alphabet_keeps_the_most_frequent(monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "ALPHABET", 2)
    assert L.alphabet_of(np.array([9, 5, 7]), np.array([3, 1, 3])).tolist() == [7, 9]
    assert L.alphabet_of(np.array([9, 5, 7]), np.array([1, 1, 1])).tolist() == [5, 7]


@pytest.mark.parametrize("most", [1, 3, 10, 40, 200, 10**6])
def test_ngrams_within_a_bound(spark, most):
    """Against the rule applied row by row: best ranks over languages, cut at the last step that fits."""
    import math
    import random

    r = random.Random(most)
    rows = [(lang, g, r.choice([1, 1, 1, 2, 3, 9])) for lang in range(3) for g in r.sample(range(-150, 150), 120)]
    best = {}
    for lang in range(3):
        own = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[2], x[1]))
        for k, (_, g, _) in enumerate(own, 1):
            best[g] = min(best.get(g, k), k)
    steps = sorted({math.ceil(math.log2(k) * 8) for k in best.values()})
    of = {s: {g for g, k in best.items() if math.ceil(math.log2(k) * 8) <= s} for s in steps}
    fits = [s for s in steps if len(of[s]) <= most]
    kept = set(best) if len(rows) <= most else of[fits[-1]] if fits else set()
    got = L.within(spark.createDataFrame(rows, "lang int, gram bigint, n bigint").repartition(3), most)
    assert sorted(map(tuple, got.collect())) == sorted(x for x in rows if x[1] in kept)
    assert got.select("gram").distinct().count() <= most or len(rows) <= most


def test_a_bounded_model_still_tells_languages(spark):
    import numpy as np

    rows = samples().drop(columns="held").assign(doc_id=range(120))
    df = spark.createDataFrame(rows).repartition(3)
    model = L.train(df, max_cells=2 * 60)
    assert 8 <= len(model.grams[-1]) <= 60
    assert L.predict(model, pd.Series([EN, DE])).lang_pred.tolist() == ["en", "de"]
    for sym in (np.zeros(0, np.uint64), model.grams[0][-1:]):  # smoothed probabilities still sum to one
        grams = np.array([(int(sym[0]) << 16 if len(sym) else 0) | s for s in range(len(model.alphabet) + L.FIRST)], dtype=np.uint64)
        assert np.exp(L.lookup(model, grams, len(sym) + 1).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-3)
    with pytest.raises(ValueError, match="at least 4 cells"):
        L.train(df, max_cells=3)


def test_many_languages_score_in_smaller_blocks():
    model = L.fit(samples())
    assert L.block(model) == L.BLOCK
    model.langs = [str(k) for k in range(1600)]
    assert L.block(model) == L.BLOCK // 100
