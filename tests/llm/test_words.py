"""Word hashes on words that collide in polynomial hashes, whatever the base."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import packing, words
from factloom.llm.jaccard_join import jaccard_components
from factloom.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id bigint, text string"


def thue_morse(n):
    """A word of n letters and its complement."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def hashed(texts, **how):
    out = []
    for _, _, offsets, data in words.groups(pa.array(texts, pa.string())):
        starts, ends, _ = words.spans(offsets, data)
        out += words.hashes(data, starts, ends, **how).tolist()
    return out


def test_hashes_tell_words_apart():
    r = random.Random(1)
    made = {"".join(r.choices("abAé\U0001f600", k=r.randint(1, 90))) for _ in range(4000)}
    made |= {w for n in (1, 2, 8, 16, 64, 65, 512, 1024, 4096, 65536) for w in thue_morse(n)} | {"a" * n for n in range(1, 200)}
    texts = sorted(made)
    assert len(set(hashed(texts))) == len(texts)
    assert hashed([" ".join(texts)]) == hashed(texts)  # wherever a word stands
    assert not set(hashed(texts)) & set(hashed(texts, seed=1))
    assert hashed(["ÄB" + "c" * 70], lower=True) == hashed(["Äb" + "c" * 70], lower=True)
    low = lambda t: t.encode().translate(bytes.maketrans(b"AB", b"ab")).decode()
    assert hashed(texts, lower=True) == hashed([low(t) for t in texts])


def test_same_words():
    data = np.frombuffer(b"abc abd abc " + b"x" * 70 + b" " + b"x" * 69 + b"y", dtype=np.uint8)
    starts, ends, _ = words.spans(np.array([0, len(data)]), data)
    assert words.same_words(data, starts, ends, np.array([0, 1, 0, 3, 4]))
    assert not words.same_words(data, starts, ends, np.array([0, 0, 0, 3, 4]))
    assert not words.same_words(data, starts, ends, np.array([0, 1, 0, 3, 3]))


@pytest.mark.parametrize("n", [1024, 4096])
def test_results_on_such_words(spark, n):
    one, other = thue_morse(n)
    before = " ".join(f"q{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{before} {one}"), (2, f"{before} {other}"), (3, f"w x y z {one}"), (4, f"w x y z {other}"), (5, f"{one} w x y"), (6, f"{other} w x y")], SCHEMA)
    removed = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert all(r.n_removed == 0 for r in removed.values())
    assert removed[2].kept_sha256 == hashlib.sha256(f"{before} {other}".encode()).hexdigest()
    components = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert components[3] == 3 and components[4] == 4 and components[5] == 5 and components[6] == 6
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack(docs).collect() if r.piece == 0}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for key, text in ((1, f"{before} {one}"), (2, f"{before} {other}"), (5, f"{one} w x y"), (6, f"{other} w x y")):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END][: packing.CAPACITY]
        assert packed[key] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_words_of_one_hash(monkeypatch):
    tokens = packing.Tokens(packing.tokenizer_path())
    want = tokens.ids(["alpha beta gamma alpha", "beta delta"])
    monkeypatch.setattr(words, "hashes", lambda data, starts, ends, **_: np.zeros(len(starts), np.uint64))
    assert packing.Tokens(packing.tokenizer_path()).ids(["alpha beta gamma alpha", "beta delta"]) == want
