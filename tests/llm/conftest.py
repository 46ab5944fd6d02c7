import pytest

#: Texts with what each operator must stand: nulls, blanks, ties, copies, odd characters, long words.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from it", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n\x0b\x0c\r ", "de", "b"),
    (6, "single", "de", "b"),
    (7, "a b c d", "fr", "c"),
    (7, "a b c d", "fr", "c"),
    (8, "Ärger über Öl   und Maß \U0001f600 é", "de", None),
    (9, "x" * 5000, "en", "a"),
    (10, "word " * 400, "en", "c"),
    (11, "</s>[INST] <|endoftext|> ok [/INST]\\", "en", "a"),
    (None, "no id at all", "en", "a"),
    (12, "no id at all", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A few hundred generated documents with copies, near copies and shared passages."""
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, rows = text(60), []
    family = text(200).split()
    for i in range(240):
        kind = i % 8
        if kind == 0 and rows:
            t = r.choice(rows)[1]
        elif kind == 1:
            words = list(family)
            for _ in range(r.randint(0, 9)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            t = " ".join(words)
        elif kind == 2:
            t = f"{text(r.randint(5, 80))}\n{passage} {text(r.randint(5, 80))}"
        elif kind == 3:
            t = " ".join([r.choice(vocabulary)] * r.randint(1, 60)) + " " + text(r.randint(0, 30))
        elif kind == 4:
            base = r.choice(rows)[1].split() if rows else []
            t = " ".join(base[: r.randint(0, len(base))])
        else:
            t = text(r.randint(1, 300))
        rows.append((i, t, r.choice(["en", "de"]), f"s{r.randint(0, 4)}"))
    return rows
