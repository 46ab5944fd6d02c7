"""Nodes, edges and triples from reviewed documents, their union over batches, and the digests of their inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import document_chunk
from factloom.functions.text import numbered_id
from factloom.operators.model import EDGE_COLUMNS, NODE_COLUMNS, TRIPLE_COLUMNS, typed
from factloom.operators.sink import stream_digest
from factloom.session import materialize


def in_batch(docs: DataFrame, batch: str | Column, reviewed_only: bool = True) -> DataFrame:
    """Typed documents admitted in the batch (a column: in their own); by default only reviewed ones."""
    keep = F.col("m.admission.batch_id") == F.lit(batch)
    return typed(docs.where("parse_error IS NULL")).where(keep & (F.col("m.review_status") == "reviewed") if reviewed_only else keep)


def nodes(selected: DataFrame) -> DataFrame:
    m = {c: F.col(f"m.{c}") for c in ("id", "entity_type", "name_zh", "name_en", "scientific_name", "aliases", "one_health_domains", "summary", "review_status")}
    atoms = F.coalesce("m.admission.atom_ids", F.array().cast("array<string>"))
    return selected.select(*[v.alias(k) for k, v in m.items()], F.col("m.admission.batch_id").alias("admission_batch_id"), atoms.alias("source_atom_ids"), F.col("path").alias("source_file"))


def edges(selected: DataFrame, subject: str = "id") -> DataFrame:
    """One row for each relation; subject is `extends_entity` for extensions."""
    rows = selected.select("path", "qualifiers", F.col(f"m.{subject}").alias("subject"), F.posexplode("m.relations").alias("_at", "r"))
    return rows.select("subject", "r.predicate", "r.object", "r.statement_zh", "r.relation_status", "r.evidence", F.element_at("qualifiers", F.col("_at") + 1).alias("qualifiers"), F.col("path").alias("source_file"))


def unreviewed(found: DataFrame) -> DataFrame:
    """Edges that forbid a build."""
    return found.where(~F.coalesce(F.col("relation_status") == "reviewed", F.lit(False)))


def atom_id(qualifiers: str | Column = "qualifiers") -> Column:
    return F.get_json_object(qualifiers, "$.source_atom_id")


def triples(found: DataFrame) -> DataFrame:
    sources = F.array_join(F.transform("evidence", lambda e: e["source_id"]), "|")
    return found.select("subject", "predicate", "object", "relation_status", atom_id().alias("source_atom_id"), sources.alias("evidence_source_ids"))


def sorted_nodes(found: DataFrame) -> DataFrame:
    return found.select(NODE_COLUMNS).orderBy("id")


def sorted_edges(found: DataFrame) -> DataFrame:
    return found.select(EDGE_COLUMNS).orderBy("subject", "predicate", "object", atom_id())


def sorted_triples(found: DataFrame) -> DataFrame:
    return found.select(TRIPLE_COLUMNS).orderBy("subject", "predicate", "object", "source_atom_id")


def batch_digest(selected: DataFrame, path: str | Column = "path", text: str = "text") -> DataFrame:
    """One row: SHA-256 over path and text of the documents in path-component order."""
    at = F.col(path) if isinstance(path, str) else path
    return stream_digest(selected, [F.split(at, "/")], document_chunk(at, F.col(text))).select("digest")


def union_digest(base: DataFrame, documents: DataFrame, extensions: DataFrame, catalogs: DataFrame) -> DataFrame:
    """One row: the digest over a base digest, new documents, extensions and catalog texts.

    base: (digest). documents, extensions: (path, text). catalogs: (ordinal, text).
    """
    zero = F.lit(b"\x00")
    head = base.select(F.lit(0).alias("seg"), F.array().cast("array<string>").alias("k"), F.concat(F.encode(F.concat(F.lit("base:"), F.col("digest")), "UTF-8"), zero).alias("chunk"))
    doc = lambda df, seg: df.select(F.lit(seg).alias("seg"), F.split("path", "/").alias("k"), document_chunk(F.col("path"), F.col("text")).alias("chunk"))
    tail = catalogs.select(F.lit(3).alias("seg"), F.array(F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("k"), F.concat(F.encode("text", "UTF-8"), zero).alias("chunk"))
    parts = head.unionByName(doc(documents, 1)).unionByName(doc(extensions, 2)).unionByName(tail)
    return stream_digest(parts, ["seg", "k"], F.col("chunk")).select("digest")


def coverage(found: DataFrame, prefix: str, first: int, last: int, width: int = 3) -> DataFrame:
    """(id, problem) where ids prefix-first to prefix-last aren't each there exactly once: missing, extra or repeated."""
    wanted = found.sparkSession.range(first, last + 1).select(numbered_id(prefix, F.col("id"), width).alias("id"))
    have = found.groupBy(F.col("id")).agg(F.count("*").alias("n"))
    both = wanted.withColumn("w", F.lit(True)).join(have, "id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def repeated(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_wins(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that share keys the first in the order, and as `n` how many they are."""
    return _one_of(found, keys, order, F.min_by)


def last_wins(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that share keys the last in the order, and as `n` how many they are."""
    return _one_of(found, keys, order, F.max_by)


def _one_of(found: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    others = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(pick(F.struct(*others), F.struct(*order)).alias("_r"), F.count("*").alias("n")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], "n")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    make_digest: Callable[[], DataFrame]

    @cached_property
    def digest(self) -> DataFrame:
        """One row, made when it is first asked for."""
        return self.make_digest()

    @property
    def triples(self) -> DataFrame:
        return triples(self.edges)

    def counts(self) -> DataFrame:
        one = self.nodes.agg(F.count("*").alias("nodes"))
        return one.crossJoin(self.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.size("evidence")), F.lit(0)).alias("evidence")))  # one row each


def build(docs: DataFrame, batch: str) -> Graph:
    """The graph of one batch. Raises where a relation of a reviewed document isn't reviewed itself or an atom id is missing."""
    chosen = materialize(in_batch(docs, batch), "batch")  # read by nodes, edges, checks and digest
    found = edges(chosen)
    _refuse(unreviewed(found), "relation is not reviewed")
    _refuse(found.where(atom_id().isNull()), "relation has no source_atom_id")
    return Graph(nodes(chosen), found, lambda: batch_digest(chosen))


def extend(base: Graph, docs: DataFrame, extensions: DataFrame, batch: str, catalogs: DataFrame) -> Graph:
    """The graph of a base and a later batch with its extension documents."""
    new, more = (materialize(in_batch(x, batch), "batch") for x in (docs, extensions))
    all_nodes = base.nodes.unionByName(nodes(new))
    _refuse(repeated(all_nodes, "id"), "node id is repeated")
    added = edges(new).unionByName(edges(more, "extends_entity"))
    _refuse(unreviewed(added), "relation is not reviewed")
    _refuse(more.select(F.col("m.extends_entity").alias("id")).join(all_nodes, "id", "left_anti"), "extended entity is unknown")
    return Graph(all_nodes, base.edges.unionByName(added), lambda: union_digest(base.digest, new, more, catalogs))


def _refuse(rows: DataFrame, message: str) -> None:
    if first := rows.limit(1).collect():
        raise ValueError(f"{message}: {first[0].asDict(recursive=True)}")
