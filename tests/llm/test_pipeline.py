import corpus_pipeline
from factloom.llm.queries import QUERIES, SQL

from . import test_exact_dedup, test_jaccard_join
from .conftest import SCHEMA, TEXTS


def test_stages_against_brute_force(spark, corpus):
    sample = [(1000 + i, t, "en", "s0") for i, t, *_ in corpus[:60]]
    english = [(2000 + k, f"the little house number {k} stood by the river and nobody lived there " * 3, "en", "s1") for k in range(30)]
    rows = sample + english
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    unique = stages["exact_dedup"](spark, docs, "")
    assert unique.columns == docs.columns
    groups = test_exact_dedup.brute(rows)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(max(ids) for ids in groups.values())
    left = unique.collect()
    near = stages["ngram_jaccard_join"](spark, unique, "")
    want = {int(c) for _, _, c in test_jaccard_join.brute([tuple(r) for r in left])}
    assert {r.doc_id for r in near.collect()} == want
    mixed = stages["mixing"](spark, near, "")
    assert mixed.columns == docs.columns and mixed.count() >= near.count()
    packed = stages["best_fit_packing"](spark, mixed, "")
    assert packed.where("piece = 0").count() == mixed.count()


def test_edges_and_extra_columns(spark, empty):
    for docs in (spark.createDataFrame(TEXTS, SCHEMA).selectExpr("*", "1 AS score", "'x' AS kept", "2 AS _draw"), empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert name != "language_id" or docs is not empty or out.count() == 0
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(SQL) <= set(QUERIES)
