import random

from pyspark.sql import functions as F

from factloom.operators import corpus, search


def test_against_all_pairs(spark):
    r = random.Random(5)
    alphabet = "abcab ca中\U0001f600é"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(150)] + [None, "", "aaaa" * 50, "x" * 3]
    patterns = ["".join(r.choices(alphabet, k=r.randint(1, 24))) for _ in range(300)]
    patterns += [t[k : k + n] for t in texts[:60] if t and len(t) > 30 for k, n in ((0, 16), (5, 17), (3, 9), (1, 1), (2, 2))] + [None, "", "a", "aaaa" * 50, "aaaa" * 51, "zzz"]
    rows = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "id int, text string, word string").repartition(4)
    words = spark.createDataFrame([(p,) for p in patterns], "word string").repartition(3)
    want = sorted((k, p) for k, t in enumerate(texts) for p in {p for p in patterns if p} if t and p in t)
    for bits in (search.BITS, 64):  # every piece passes a small bitmap; the result is the same
        found = search.contained(rows, "text", words, "word", bits, 50)
        assert found.columns == ["id", "text", "word"]
        assert sorted((x.id, x.word) for x in found.collect()) == want
    few = corpus.found_in(rows, "text", words, "word", most=1)
    assert sorted((x.id, x.word) for x in few.select("id", "word").collect()) == want
    assert search.contained(rows.limit(0), "text", words, "word").count() == search.contained(rows, "text", words.limit(0), "word").count() == 0


def test_counts_like_the_automaton(spark):
    docs = spark.createDataFrame([("one two three",), ("two three four",), (None,), ("four",)], "text string")
    items = spark.createDataFrame([(1, "two three"), (2, "four"), (3, "five"), (4, "two three"), (5, None), (6, "o")], "item_id bigint, passage string")
    rows = lambda df: {x.item_id: x.documents for x in df.collect()}
    assert rows(search.passage_counts(docs, items)) == rows(corpus.passage_counts(docs, items)) == {1: 2, 2: 2, 4: 2, 6: 3}


def test_many_patterns(spark):
    """Three hundred thousand patterns, more than an automaton is made for, found in every text that has them."""
    words = spark.range(300_000).select(F.format_string("needle-%06d-of-many", "id").alias("word"))
    texts = spark.range(200).select("id", F.format_string("hay needle-%06d-of-many hay needle-%06d-of-many", F.col("id") * 1499, F.col("id") + 500_000).alias("text"))
    found = corpus.found_in(texts, "text", words, "word").collect()
    assert {(x.id, x.word) for x in found} == {(k, f"needle-{k * 1499:06d}-of-many") for k in range(200)} and len(found) == 200


def test_pieces_are_hashed_from_their_halves():
    text = "the quick brown fox jumps over the quick brown dog, " * 5
    points, known = search.code_points(text), {}
    for size in search.SIZES:
        h = search.piece_hashes(points, size, known)
        pieces = [text[k : k + size] for k in range(len(text) - size + 1)]
        assert len(h) == len(pieces) and len(set(h.tolist())) == len(set(pieces)) == len(set(zip(h.tolist(), pieces, strict=True)))
        assert search.piece_hashes(search.code_points(text[7 : 7 + size]), size).tolist() == [h[7]]
    assert search.piece_hashes(points[:3], 16).size == 0
    assert set(known) == set(search.SIZES)  # each size once; the longest takes no round for each of its code points
