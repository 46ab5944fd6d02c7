"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of orders 1 to ORDER. The models of all languages lie in sorted
arrays of n-gram hashes: one array for each order with the final interpolated log probability under
every language, and one for each context length with the back-off weights. A text is scored as a
whole; the language of lowest cross-entropy per character wins. A text is rejected when it has no
letter or when its cross-entropy lies beyond what held-back training texts of the winner show.

Training reads at most about `train_docs` labelled rows a language, chosen by a hash of their id (the
documented bound of the sample); everything else covers all rows. The sample's letters and n-grams are counted in
Spark, and what its held-back rows show is measured there; the driver gets counts, never texts. The arrays have a column for each language, so
distinct n-grams times languages are bounded too (`max_cells`, 33,554,432: 128 MB of log probabilities): beyond it the model is fitted on the n-grams that
are most frequent in some language; ten languages may have 3.3 million, 2,000 languages 16,777. Symbols have 16 bits: beyond
the ALPHABET most frequent letters of the sample all are one symbol. A language without held-back rows has
the limit of a cross-entropy of 5. Where two languages tie, the first by name wins.

Defined results: null text, empty text and text without a letter give `und`, score 0 and are
rejected; without any labelled row every text is `und`; rows are independent of each other, so
repeated rows get equal values; input columns named like an output column are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import discard, materialize, ship, without

ORDER = 4
UNKNOWN = "und"
#: Symbols before the trained letters: padding, everything that isn't a letter, letters not seen in training.
PAD, OTHER, NEW, FIRST = 0, 1, 2, 3
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    limit: np.ndarray | None = None
    spread: np.ndarray | None = None


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        out = np.zeros(0x110000, dtype=bool)
        for lo, hi in ((0x41, 0xD800), (0xE000, 0x32000)):
            out[lo:hi] = [chr(c).isalpha() for c in range(lo, hi)]
        _LETTERS.append(out)
    return _LETTERS[0]


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; a run of anything but letters is one space, one at each end."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters()[cp]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, cp, 32)[keep]


def symbols(cp: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(alphabet, cp), len(alphabet) - 1)
    return np.where(cp == 32, OTHER, np.where(alphabet[at] == cp, at + FIRST, NEW)).astype(np.uint64)


def packed(sym: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each symbol: its 16-bit symbols side by side, so without collisions up to order 4."""
    h = sym.copy()
    for k in range(1, order):
        shifted = np.zeros_like(sym)
        shifted[k:] = sym[:-k]
        h |= shifted << np.uint64(16 * k)
    return h


#: Letters told apart.
ALPHABET = 65_000


def alphabet_of(letter: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most frequent code points, ties to the smaller one, sorted."""
    order = np.lexsort((letter, -n))[:ALPHABET]
    return np.sort(letter[order])


def gram_counts(texts: list[np.ndarray], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the highest order in code-point sequences, and how often each occurs."""
    raw = [packed(symbols(c, alphabet), ORDER)[1:] for c in texts]
    return np.unique(np.concatenate(raw) if raw else np.zeros(0, np.uint64), return_counts=True)


def fit(samples: pd.DataFrame) -> Model | None:
    """Models from rows (lang, text, held) at hand: held rows set the limits of rejection only."""
    samples = samples[samples.text.map(has_letter)]
    if not len(samples):
        return None
    seen = [codes(t) for t in samples.text]
    letter, n = np.unique(np.concatenate(seen), return_counts=True)
    alphabet = alphabet_of(letter[letter != 32], n[letter != 32])
    counts = {}
    for lang in samples.lang.unique():
        of = [c for c, x, held in zip(seen, samples.lang, samples.held, strict=True) if x == lang and not held]
        counts[lang] = gram_counts(of or [c for c, x in zip(seen, samples.lang, strict=True) if x == lang], alphabet)
    model = fit_counts(alphabet, counts)
    entropy = {lang: [] for lang in model.langs}
    for c, x, held in zip(seen, samples.lang, samples.held, strict=True):
        if held:
            entropy[x].append(cross_entropy(model, c)[model.langs.index(x)])
    return calibrate(model, entropy)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(letters()[codes(text)].any())


def calibrate(model: Model, entropy: dict[str, list[float]]) -> Model:
    """Sets the limits from the cross-entropies of held rows under their own language."""
    model.limit, model.spread = np.zeros(len(model.langs)), np.zeros(len(model.langs))
    for j, lang in enumerate(model.langs):
        e = np.array(entropy.get(lang) or [5.0])
        model.limit[j] = np.quantile(e, 0.99) + 0.75
        model.spread[j] = max(0.25, e.std())
    return model


def fit_counts(alphabet: np.ndarray, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from each language's sorted n-grams of the highest order and their counts; without limits."""
    langs = sorted(counts)
    model = Model(langs, alphabet)
    per: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        grams, n = counts[lang]
        orders = [(grams, n.astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):
            # lower orders count the distinct n-grams that end in theirs
            grams, n = np.unique(orders[0][0] & np.uint64((1 << (16 * k)) - 1), return_counts=True)
            orders.insert(0, (grams, n.astype(np.float64)))
        per.append(orders)
    size, vocabulary = len(langs), len(model.alphabet) + FIRST
    model.floor = np.full(size, -np.log(vocabulary))
    for k in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([orders[k - 1][0] for orders in per]))
        context = np.unique(grams >> np.uint64(16))
        p = np.zeros((len(grams), size))
        weight = np.ones((len(context), size))
        where = np.searchsorted(context, grams >> np.uint64(16))
        for j, orders in enumerate(per):
            own, n = orders[k - 1]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
            at, c = np.searchsorted(grams, own), np.searchsorted(context, own >> np.uint64(16))
            total, kinds = np.bincount(c, n, len(context)), np.bincount(c, minlength=len(context))
            known = total > 0
            weight[known, j] = discount * kinds[known] / total[known]
            p[at, j] = (n - discount) / total[c]
        lower = np.exp(lookup(model, grams & np.uint64((1 << (16 * (k - 1))) - 1), k - 1))
        p += weight[where] * lower
        model.grams.append(grams)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(context)
        model.weights.append(np.log(weight).astype(np.float32))
    return model


def find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(array, keys)
    at[at == len(array)] = 0
    return at, array[at] == keys


def lookup(model: Model, grams: np.ndarray, order: int) -> np.ndarray:
    """Log probability of each n-gram's last symbol after the others, a column for each language."""
    out = np.empty((len(grams), len(model.langs)), dtype=np.float32)
    todo, keys, extra = np.arange(len(grams)), grams, None
    for k in range(order, 0, -1):
        at, hit = find(model.grams[k - 1], keys)
        got = model.logp[k - 1][at[hit]]
        out[todo[hit]] = got if extra is None else got + extra[hit]
        todo, keys, extra = todo[~hit], keys[~hit], None if extra is None else extra[~hit]
        if not len(todo):
            return out
        # context of order k: the k - 1 symbols before the last; unseen contexts weigh 1
        at, hit = find(model.contexts[k - 1], keys >> np.uint64(16))
        weight = np.where(hit[:, None], model.weights[k - 1][at], np.float32(0))
        extra = weight if extra is None else extra + weight
        keys = keys & np.uint64((1 << (16 * (k - 1))) - 1)
    out[todo] = model.floor.astype(np.float32) if extra is None else model.floor.astype(np.float32) + extra
    return out


#: Positions scored at once under up to 16 languages; the totals of a longer text are carried on.
BLOCK = 1 << 18


def block(model: Model) -> int:
    """Positions scored at once: fewer under more languages, so that the scores take the same memory."""
    return max(1, BLOCK * 16 // max(16, len(model.langs)))


def cross_entropy(model: Model, cp: np.ndarray) -> np.ndarray:
    """Nats per symbol under each language."""
    grams = packed(symbols(cp, model.alphabet), ORDER)[1:]
    total = np.zeros(len(model.langs))
    step = block(model)
    for lo in range(0, len(grams), step):
        total += lookup(model, grams[lo : lo + step], ORDER).sum(axis=0, dtype=np.float64)
    return -total / max(1, len(grams))


def decide(model: Model, entropy: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """entropy: a row for each text. The score is the winner's posterior over at most 40 symbols, lowered beyond the winner's limit."""
    rows = np.arange(len(entropy))
    best = entropy.argmin(axis=1)
    least = entropy[rows, best]
    odds = np.exp(-(entropy - least[:, None]) * np.minimum(n, 40)[:, None])
    # the mean over n symbols strays by about 2 / sqrt(n)
    beyond = np.maximum(0, (least - model.limit[best] - 4 / np.sqrt(n)) / model.spread[best])
    score = np.clip(1 / odds.sum(axis=1) * np.exp(-beyond), 0, 1)
    return pd.DataFrame({"lang_pred": np.array(model.langs, dtype=object)[best], "score": np.round(score, 6), "cross_entropy": least, "accepted": beyond <= 3.0})


def predict(model: Model | None, texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": np.full(len(texts), np.nan), "accepted": False})
    if model is None:
        return out.astype({"cross_entropy": object}).where(out.notna(), None)
    todo, parts, size, most = [], [], 0, block(model)

    def flush() -> None:
        nonlocal todo, parts, size
        if not todo:
            return
        joined = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        sym = symbols(joined, model.alphabet)
        grams = packed(sym, ORDER)
        for k in range(1, ORDER):  # what stands before a text's start is padding
            at = starts + k - 1
            at = at[at < ends]
            grams[at] &= np.uint64((1 << (16 * k)) - 1)
        inner = np.ones(len(grams), dtype=bool)
        inner[starts] = False
        n = ends - starts - 1
        logp = lookup(model, grams[inner], ORDER)
        at = np.cumsum(n) - n
        entropy = -np.add.reduceat(logp, at, axis=0, dtype=np.float64) / n[:, None]
        out.iloc[todo] = decide(model, entropy, n).to_numpy()
        todo, parts, size = [], [], 0

    for k, text in enumerate(texts):
        if not text:
            continue
        cp = codes(text)
        if len(cp) < 3 and not letters()[cp].any():
            continue
        if len(cp) > most:
            out.iloc[k] = decide(model, cross_entropy(model, cp)[None, :], np.array([len(cp) - 1])).to_numpy()[0]
            continue
        todo.append(k)
        parts.append(cp)
        size += len(cp)
        if size > most:
            flush()
    flush()
    return out.astype({"lang_pred": str, "score": float, "cross_entropy": float, "accepted": bool})


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """All but the held-out fifth, where a label is given."""
    return F.col("lang").isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)


def within(grams: DataFrame, most: int) -> DataFrame:
    """The rows (lang, gram, n) of at most `most` distinct n-grams.

    All rows where that holds of itself. Otherwise an n-gram stays, in every language, if it is among the K most frequent of one language, ties to
    the smaller, with one K for all languages: the largest that keeps within the bound, in steps of an eighth of a doubling.
    """
    if grams.count() <= most:
        return grams
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = grams.withColumn("_r", rank).groupBy("gram").agg(F.ceil(F.log2(F.min("_r")) * 8).cast("int").alias("step"))
    best = materialize(best, "language-ranks")
    kept, limit = 0, -1
    for step, n in sorted((r.step, r["count"]) for r in best.groupBy("step").count().collect()):  # eight rows a doubling
        kept += n
        if kept > most:
            break
        limit = step
    return grams.join(best.where(F.col("step") <= limit), "gram", "left_semi").select("lang", "gram", "n")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 500, max_languages: int = 2000, max_cells: int = 1 << 25) -> Model | None:
    """Fit on about train_docs rows a language; the largest training table is train_docs * max_languages rows.

    max_cells: distinct n-grams of the highest order times languages that the model may have (`within`), at least the square of the languages.
    """
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = labelled.groupBy(lang_col).count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    # a whole text is read or none of it
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, train_docs / r[1]))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    held = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("calibrate")), F.lit(5)) == 0
    rows = labelled.where(draw < share[F.col(lang_col)])
    sample = materialize(rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), held.alias("held")), "language-sample")
    spark = sample.sparkSession
    ship(spark)
    found = sample.select("text").mapInArrow(_letters_of, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # code points, whatever the sample
    if not found:
        return None
    alphabet = alphabet_of(np.array([r[0] for r in found], dtype=np.uint32), np.array([r[1] for r in found], dtype=np.int64))
    counted = materialize(sample.mapInArrow(_grams_of(alphabet), "lang string, held boolean, gram bigint, n bigint").groupBy("lang", "held", "gram").agg(F.sum("n").alias("n")), "language-grams")
    names = {held: sorted(r[0] for r in counted.where(F.col("held") == held).select("lang").distinct().collect()) for held in (False, True)}  # max_languages each at most
    langs = sorted({*names[False], *names[True]})
    if max_cells < len(langs) ** 2:
        raise ValueError(f"{len(langs)} languages need at least {len(langs) ** 2} cells")
    # a language without other rows is learned from its held-back ones
    own = counted.where(~F.col("held") | ~F.col("lang").isin(names[False]))
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
    grams = within(own.select(number[F.col("lang")].alias("lang"), "gram", "n"), max_cells // len(langs)).toPandas()
    counts = {lang: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for lang in langs}
    for k, rows in grams.groupby("lang"):
        gram = rows.gram.to_numpy().view(np.uint64)
        order = np.argsort(gram)
        counts[langs[k]] = gram[order], rows.n.to_numpy()[order]
    del grams
    discard(counted)
    model = fit_counts(alphabet, counts)
    told = spark.sparkContext.broadcast(model)
    entropy: dict[str, list[float]] = {}
    for lang, e in sample.where("held").mapInArrow(_entropies_of(told), "lang string, entropy double").collect():  # train_docs a language at most
        entropy.setdefault(lang, []).append(e)
    discard(sample)
    return calibrate(model, {lang: sorted(e) for lang, e in entropy.items()})


#: Code points that are counted at once.
COUNTED = 1 << 20


def _letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counts() -> pa.RecordBatch:
        letter, n = np.unique(np.concatenate(of), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(letter[letter != 32].astype(np.int64)), pa.array(n[letter != 32].astype(np.int64))], names=["letter", "n"])

    of: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for text in batch.column(0):
            if has_letter(t := text.as_py()):
                of.append(codes(t))
                size += len(of[-1])
                if size > COUNTED:
                    yield counts()
                    of, size = [], 0
    if of:
        yield counts()


def _grams_of(alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, bool], list[np.ndarray]] = {}
        size = 0

        def counts() -> Iterator[pa.RecordBatch]:
            for (lang, held), of in groups.items():
                gram, n = gram_counts(of, alphabet)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array([held] * len(gram), pa.bool_()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "held", "gram", "n"])

        for batch in batches:
            for lang, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if has_letter(t := text.as_py()):
                    own = codes(t)
                    groups.setdefault((lang, held), []).append(own)
                    size += len(own)
                    if size > COUNTED:
                        yield from counts()
                        groups, size = {}, 0
        yield from counts()

    return run


def _entropies_of(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            rows = [(lang, float(cross_entropy(model, codes(text))[model.langs.index(lang)])) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.float64())], names=["lang", "entropy"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, text_col: str = "text", **training: int) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and accepted."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(labelled, text_col=text_col, **training))

    @F.pandas_udf(PREDICTION)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(model.value, texts)

    rows = without(docs, [*PREDICTION.names, "_p"])
    out = rows.withColumn("_p", predicted(F.col(f"`{text_col}`").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_p.{n}").alias(n) for n in PREDICTION.names])
