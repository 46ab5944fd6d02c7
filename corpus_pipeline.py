"""A corpus pipeline: five stages, each applied to all rows that the one before has kept.

A stage takes (spark, docs, sf_dir), docs having the columns of documents, and returns a DataFrame with
the same columns; the last one returns the packed pieces. A document that the mix takes twice is two
equal rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.jaccard_join import jaccard_components
from factloom.llm.language_id import identify, training_rows
from factloom.llm.mixing import mix
from factloom.llm.packing import pack
from factloom.session import discard, materialize, table

#: The stages of language ID and best-fit packing have no SQL form.
ORACLE_SQL = None


NEEDED = ("doc_id", "text", "lang", "source")


def apart(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names that no operator uses."""
    return docs.toDF(*[c if c in NEEDED else f"_other_{k}" for k, c in enumerate(docs.columns)])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the identifier rejects."""
    rows = apart(docs)
    return identify(rows, rows.where(training_rows(rows))).where("accepted").select(rows.columns).toDF(*docs.columns)


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    rows = apart(docs)
    return exact_dedup(rows).where("kept").select(rows.columns).toDF(*docs.columns)


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays; null ids stay.

    An id names the one document to drop; rows that share an id with another row all stay, copies or not.
    """
    groups = jaccard_components(docs)
    gone = groups.where("component_id <> doc_id").groupBy("doc_id").count().select("doc_id")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return docs.join(gone.join(several, "doc_id", "left_anti"), "doc_id", "left_anti").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies."""
    rows = apart(docs)
    mixed = mix(rows, F.array("source")).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(rows.columns).toDF(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", unique_texts),
    ("ngram_jaccard_join", unlike_texts),
    ("mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # its tokens lie in tables of their own by now
    return packed
