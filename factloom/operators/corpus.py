"""The source catalog and the retrieval corpus of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import first_nonempty, rstrip
from factloom.session import ship


def evidence_rows(edges: DataFrame) -> DataFrame:
    return edges.select("subject", "predicate", "object", F.posexplode("evidence").alias("ordinal", "e")).select("subject", "predicate", "object", "ordinal", "e.*")


def used_sources(edges: DataFrame) -> DataFrame:
    """(source_id, allowed_evidence_types, locators, cited): both sorted and distinct, and how often it is evidence."""
    found = evidence_rows(edges).groupBy("source_id").agg(F.array_sort(F.collect_set("evidence_type")).alias("allowed_evidence_types"), F.array_sort(F.collect_set("locator")).alias("locators"), F.count("*").alias("cited"))
    return found


def unregistered(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Evidence rows whose source the registry hasn't; null sources too."""
    return evidence_rows(edges).join(registry.select("source_id").distinct(), "source_id", "left_anti")


def source_catalog(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered sources in use, by id. registry: source_id, source_type, title, url, creators and dates.

    Raises with the sorted ids where a source isn't registered.
    """
    used = used_sources(edges)
    lacking = used.join(registry, "source_id", "left_anti").select("source_id")
    if names := sorted(str(r[0]) for r in lacking.collect()):
        raise ValueError(f"unregistered sources: {', '.join(names)}")
    date = first_nonempty(F.col("publication_date"), F.col("page_date"), F.col("page_last_reviewed"))
    rows = used.join(registry, "source_id").select("source_id", "source_type", "title", F.coalesce("creators", F.array().cast("array<string>")).alias("creators"), date.alias("date"), "url", "access_level", "allowed_evidence_types", "locators")
    return rows.orderBy("source_id")


def corpus_text(docs: DataFrame, preamble: str) -> DataFrame:
    """One row: the preamble and a section for each (id, path, body), by id. Serial: for corpora of a release's size."""
    section = F.concat(F.lit("\n\n## "), F.col("id"), F.lit("\n\n<!-- "), F.col("path"), F.lit(" -->\n\n"), rstrip(F.col("body")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("id"), section.alias("s"))))
    return docs.agg(F.concat(F.lit(preamble), F.array_join(F.transform(parts, lambda p: p["s"]), ""), F.lit("\n")).alias("corpus"))


def leaked(text: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens (ids of later batches, say) that a text must not contain. text: one row (corpus)."""
    return found_in(text, "corpus", tokens, "token").select("token").distinct()


def _automaton(words):
    import ahocorasick

    built = ahocorasick.Automaton()
    for word in words:
        built.add_word(word, word)
    built.make_automaton()
    return built


def found_in(rows: DataFrame, column: str, words: DataFrame, word: str, most: int = 200_000) -> DataFrame:
    """rows with one of the words that their text contains, a row for each.

    Up to `most` words are told to all tasks and searched in one walk over each text by an Aho-Corasick automaton; more
    are joined with the texts by their rarest pieces (operators.search).
    """
    ship(rows.sparkSession)
    known = [r[0] for r in words.where(F.col(word).isNotNull() & (F.col(word) != "")).select(word).distinct().limit(most + 1).collect()]
    if len(known) > most:
        from factloom.operators.search import contained

        return contained(rows, column, words, word)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(shared.value) if shared.value else None
        for texts in batches:
            yield texts.map(lambda t: sorted({w for _, w in automaton.iter(t)}) if automaton and t else [])

    return rows.withColumn(word, F.explode(search(F.col(column))))


def passage_counts(docs: DataFrame, passages: DataFrame, most: int = 200_000) -> DataFrame:
    """(item_id, documents): in how many documents each passage stands; passages in none are left out.

    docs: (text). passages: (item_id, passage), a checked number of them; operators.search counts more. All are searched in one walk over each
    text by an Aho-Corasick automaton, so the cost doesn't grow with their number; tasks add up first.
    """
    import ahocorasick

    ship(docs.sparkSession)
    rows = passages.where("passage IS NOT NULL AND passage <> ''").select("item_id", "passage").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} passages to search for at once")
    shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.passage) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, list[int]] = {}
        for item, passage in shared.value:
            items.setdefault(passage, []).append(item)
        automaton = ahocorasick.Automaton()
        for passage, ids in items.items():
            automaton.add_word(passage, ids)
        automaton.make_automaton()
        counts: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0) if items else ():
                for item in {i for _, ids in automaton.iter(text.as_py() or "") for i in ids}:
                    counts[item] = counts.get(item, 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "documents"])

    found = docs.select("text").mapInArrow(search, "item_id bigint, documents bigint")
    return found.groupBy("item_id").agg(F.sum("documents").alias("documents"))
