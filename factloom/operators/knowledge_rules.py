"""Rules over entity documents, their relations and evidence, and the source registry.

What depends on one document alone is checked where its metadata is parsed, since its fields may have any type;
a check that fails stops the later ones of its scope, as noted in each step. What needs other documents is a join.
Vocabularies are rows, so new types or predicates need no code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.rules import COLUMNS, not_in

ENTITY_FIELDS = ["schema_version", "id", "entity_type", "name_zh", "aliases", "one_health_domains", "summary", "review_status", "relations", "review"]
RELATION_FIELDS = ["predicate", "object", "statement_zh", "relation_status", "evidence", "qualifiers"]
EVIDENCE_FIELDS = ["source_id", "locator", "evidence_type"]
SOURCE_FIELDS = ["source_id", "source_type", "title", "roles", "access_level", "full_text_status"]
ID_PATTERN = r"[a-z][a-z0-9_]*\.[a-z0-9][a-z0-9_]*"
SOURCE_PATTERN = r"source\.[a-z0-9][a-z0-9_]*"
#: Fixed values of extension documents.
EXTENSION_PREFIX, EXTENSION_REVIEWER = "extension.", "course_lead"
#: Source ids that are sent to the tasks at most.
MOST_SOURCES = 1_000_000
FOUND = T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("locus", T.StringType()), T.StructField("message", T.StringType())]))


@dataclass
class Vocabulary:
    """Controlled values; small by nature, and sent to the tasks."""

    id_prefix: dict[str, str] = field(default_factory=dict)
    domains: list[str] = field(default_factory=list)
    review_statuses: list[str] = field(default_factory=list)
    subject_types: dict[str, list[str]] = field(default_factory=dict)
    object_types: dict[str, list[str]] = field(default_factory=dict)
    relation_statuses: list[str] = field(default_factory=list)
    source_types: list[str] = field(default_factory=list)
    source_roles: list[str] = field(default_factory=list)
    evidence_types: list[str] = field(default_factory=list)
    access_levels: list[str] = field(default_factory=list)
    full_text_statuses: list[str] = field(default_factory=list)
    headings: list[str] = field(default_factory=list)
    id_pattern: str = ID_PATTERN

    @classmethod
    def of(cls, entities: dict, relations: dict, sources: dict, headings: list[str]) -> Vocabulary:
        """From the three catalogs as parsed YAML."""
        return cls(
            {k: v["id_prefix"] for k, v in entities["entity_types"].items()}, sorted(entities["one_health_domains"]), list(entities["review_statuses"]),
            {k: list(v["subject_types"]) for k, v in relations["relations"].items()}, {k: list(v["object_types"]) for k, v in relations["relations"].items()}, list(relations["relation_statuses"]),
            sorted(sources["source_types"]), sorted(sources["source_roles"]), sorted(sources["evidence_types"]), sorted(sources["access_levels"]), list(sources["full_text_statuses"]), headings, entities.get("id_pattern", ID_PATTERN).strip("^$"),
        )

    def ranges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, t) for p, ts in self.object_types.items() for t in ts], "predicate string, object_type string")


def blank(x: Any) -> bool:
    return not isinstance(x, str) or not x.strip()


def document_findings(meta: dict[str, Any], body: str, v: Vocabulary, sources: set[str]) -> Iterator[tuple[str, str, str]]:
    """(rule, locus, message) of one document."""
    lacking = [k for k in ENTITY_FIELDS if k not in meta]
    if lacking:  # stops the document
        yield "V11", "", f"missing fields: {', '.join(lacking)}"
        return
    kind = meta["entity_type"]
    if not isinstance(kind, str) or kind not in v.id_prefix:  # stops the document
        yield "V12", "entity_type", f"unknown entity type {kind!r}"
        return
    name = meta["id"]
    if not isinstance(name, str) or not re.fullmatch(v.id_pattern, name):
        yield "V13", "id", f"malformed id {name!r}"
    elif not name.startswith(v.id_prefix[kind] + "."):
        yield "V13", "id", f"id {name} does not start with {v.id_prefix[kind]}."
    for k in ("name_zh", "summary"):
        if blank(meta[k]):
            yield "V14", k, f"{k} is blank"
    if not isinstance(meta["aliases"], list):
        yield "V14", "aliases", "aliases is not a list"
    domains = meta["one_health_domains"]
    if not isinstance(domains, list) or any(d not in v.domains for d in domains):
        yield "V15", "one_health_domains", "domain is not allowed"
    if meta["review_status"] not in v.review_statuses:
        yield "V16", "review_status", f"status {meta['review_status']!r} is not allowed"
    for heading in sorted(v.headings):
        if heading not in body:
            yield "V17", heading, f"heading {heading} is missing"
    relations = meta["relations"]
    if not isinstance(relations, list):  # stops the relations
        yield "V18", "relations", "relations is not a list"
        return
    seen: set[tuple[str, str]] = set()
    for k, r in enumerate(relations):
        yield from relation_findings(r, f"relations[{k}]", kind, seen, v, sources)


def relation_findings(r: Any, at: str, kind: str, seen: set[tuple[str, str]], v: Vocabulary, sources: set[str]) -> Iterator[tuple[str, str, str]]:
    if not isinstance(r, dict):  # stops the relation
        yield "V18", at, "relation is not a mapping"
        return
    lacking = [k for k in RELATION_FIELDS if k not in r]
    if lacking:  # stops the relation
        yield "V18", at, f"relation misses fields: {', '.join(lacking)}"
        return
    predicate, target = r["predicate"], r["object"]
    if not isinstance(predicate, str) or predicate not in v.subject_types:  # stops the relation, which isn't counted as seen
        yield "V19", at, f"unknown predicate {predicate!r}"
        return
    if kind not in v.subject_types[predicate]:
        yield "V19", at, f"{kind} is no subject of {predicate}"
    if not isinstance(target, str) or not re.fullmatch(v.id_pattern, target):
        yield "V19", at, f"malformed object id {target!r}"
    pair = (predicate, str(target))
    if pair in seen:
        yield "V19", at, f"{predicate} {target} is repeated"
    seen.add(pair)
    if blank(r["statement_zh"]):
        yield "V20", at, "statement is blank"
    if r["relation_status"] not in v.relation_statuses:
        yield "V20", at, f"status {r['relation_status']!r} is not allowed"
    if not isinstance(r["qualifiers"], dict):
        yield "V20", at, "qualifiers is not a mapping"
    if not isinstance(r["evidence"], list) or not r["evidence"]:  # stops the relation
        yield "V20", at, "evidence is empty"
        return
    for k, e in enumerate(r["evidence"]):
        here = f"{at}.evidence[{k}]"
        if not isinstance(e, dict):
            yield "V21", here, "evidence is not a mapping"
        elif not set(EVIDENCE_FIELDS) <= set(e):
            yield "V21", here, "evidence misses fields"
        else:
            if e["source_id"] not in sources:
                yield "V21", here, f"unknown source {e['source_id']!r}"
            if blank(e["locator"]):
                yield "V21", here, "locator is blank"
            if e["evidence_type"] not in v.evidence_types:
                yield "V21", here, f"evidence type {e['evidence_type']!r} is not allowed"


def source_findings(s: Any, v: Vocabulary) -> Iterator[tuple[str, str, str]]:
    """(rule, locus, message) of one registry entry, but for duplicates."""
    if not isinstance(s, dict):
        yield "V2", "", "source is not a mapping"
        return
    lacking = [k for k in SOURCE_FIELDS if k not in s]
    if lacking:
        yield "V3", "", f"source misses fields: {', '.join(lacking)}"
        return
    if not isinstance(s["source_id"], str) or not re.fullmatch(SOURCE_PATTERN, s["source_id"]):
        yield "V4", "source_id", f"malformed source id {s['source_id']!r}"
    if s["source_type"] not in v.source_types:
        yield "V5", "source_type", "unknown source type"
    if not isinstance(s["roles"], list) or any(r not in v.source_roles for r in s["roles"]):
        yield "V6", "roles", "unknown source role"
    if s["access_level"] not in v.access_levels:
        yield "V7", "access_level", "unknown access level"
    if s["full_text_status"] not in v.full_text_statuses:
        yield "V8", "full_text_status", "unknown full text status"


def _as_rows(found: Iterator[tuple[str, str, str]]) -> list[dict[str, str]]:
    return [{"rule_id": a, "locus": b, "message": c} for a, b, c in found]


def registry_rows(registry: DataFrame) -> DataFrame:
    """(path, place, entry JSON) of a registry read by read_yaml; no rows where `sources` isn't a list."""
    entries = F.try_variant_get(F.try_parse_json("meta"), "$.sources", "array<variant>")
    return registry.select("path", F.posexplode(entries).alias("place", "v")).select("path", "place", F.to_json("v").alias("entry"))


def check_registry(registry: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """(findings, registered source ids)."""

    @F.pandas_udf(FOUND)
    def local(entries: pd.Series) -> pd.Series:
        return entries.map(lambda x: _as_rows(source_findings(json.loads(x), v)))

    unreadable = registry.where(F.col("parse_error").isNotNull() | ~F.coalesce(F.get_json_object("meta", "$.sources").startswith("["), F.lit(False)))
    bad = unreadable.select(F.lit("ERROR").alias("level"), F.lit("V1").alias("rule_id"), F.lit(1).alias("ordinal"), "path", F.lit("").alias("locus"), F.coalesce("parse_error", F.lit("sources is not a list")).alias("message"))
    rows = registry_rows(registry).withColumn("found", local("entry")).withColumn("source_id", F.get_json_object("entry", "$.source_id"))
    stops = lambda *ids: F.exists("found", lambda f: f["rule_id"].isin(*ids))
    counted = rows.where(~stops("V2", "V3", "V4")).withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy("path", "place")))
    place = F.concat(F.lit("sources["), F.col("place").cast("string"), F.lit("]"))
    exploded = rows.select("path", place.alias("at"), F.explode("found").alias("f"))
    findings = exploded.select(F.lit("ERROR").alias("level"), "f.rule_id", F.regexp_extract("f.rule_id", r"(\d+)", 1).cast("int").alias("ordinal"), "path", F.concat_ws(".", "at", F.nullif(F.col("f.locus"), F.lit(""))).alias("locus"), "f.message")
    repeated = counted.where("nth > 1").select(F.lit("ERROR").alias("level"), F.lit("V4").alias("rule_id"), F.lit(4).alias("ordinal"), "path", place.alias("locus"), F.concat(F.lit("repeated source id "), "source_id").alias("message"))
    return bad.unionByName(findings).unionByName(repeated).select(COLUMNS), counted.where("nth = 1").select("source_id")


def check_documents(docs: DataFrame, v: Vocabulary, sources: DataFrame) -> DataFrame:
    """Findings V9 to V22 of documents read by read_documents; sources: (source_id), a registry's size."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((v, _known_sources(sources)))

    @F.pandas_udf(FOUND)
    def local(metas: pd.Series, bodies: pd.Series) -> pd.Series:
        vocabulary, ids = shared.value
        return pd.Series([_as_rows(document_findings(json.loads(m), b or "", vocabulary, ids)) for m, b in zip(metas, bodies, strict=True)])

    row = lambda df, rule, locus, message: df.select(F.lit("ERROR").alias("level"), F.lit(rule).alias("rule_id"), F.lit(int(rule[1:])).alias("ordinal"), "path", locus.alias("locus"), message.alias("message"))
    parsed = docs.where("parse_error IS NULL").select("path", "parts", "meta", "body")
    v9 = row(docs.where("parse_error IS NOT NULL"), "V9", F.lit(""), F.col("parse_error"))
    entities = parsed.select("path", "parts", F.get_json_object("meta", "$.id").alias("id"), F.get_json_object("meta", "$.entity_type").alias("entity_type"), "meta").where("id IS NOT NULL")
    ranked = entities.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("parts")))
    v10 = row(ranked.where("nth > 1"), "V10", F.lit("id"), F.concat(F.lit("repeated id "), "id"))
    exploded = parsed.select("path", F.explode(local("meta", "body")).alias("f"))
    own = exploded.select(F.lit("ERROR").alias("level"), "f.rule_id", F.regexp_extract("f.rule_id", r"(\d+)", 1).cast("int").alias("ordinal"), "path", "f.locus", "f.message")
    index = ranked.where("nth = 1").select(F.col("id").alias("object"), F.col("entity_type").alias("object_type"))
    relations = F.from_json(F.get_json_object("meta", "$.relations"), "array<struct<predicate:string,object:string>>")
    targets = parsed.select("path", F.posexplode(relations).alias("k", "r")).select("path", F.concat(F.lit("relations["), F.col("k").cast("string"), F.lit("]")).alias("locus"), "r.predicate", "r.object").where("object IS NOT NULL")
    dangling = row(targets.join(index, "object", "left_anti"), "V22", F.col("locus"), F.concat(F.lit("object "), "object", F.lit(" has no document")))
    ranges = v.ranges(spark)
    placed = targets.join(index, "object").join(F.broadcast(ranges.select("predicate").distinct()), "predicate")
    outside = row(not_in(placed, {"predicate": "predicate", "object_type": "object_type"}, ranges, vocabulary=True), "V22", F.col("locus"), F.concat("object_type", F.lit(" is no object of "), "predicate"))
    return v9.unionByName(v10).unionByName(own).unionByName(dangling).unionByName(outside)


def _known_sources(sources: DataFrame) -> set[str]:
    known = {r[0] for r in sources.limit(MOST_SOURCES + 1).collect()}
    if len(known) > MOST_SOURCES:
        raise ValueError("over a million sources; check evidence with corpus.unregistered")
    return known


def check_extensions(extensions: DataFrame, nodes: DataFrame, v: Vocabulary, sources: DataFrame, batch: str, prefix: str = EXTENSION_PREFIX, reviewer: str = EXTENSION_REVIEWER) -> DataFrame:
    """Findings V23 of extension documents: their fields and state, ids, reviewer, base entity, relations, and atoms within the admitted ones."""
    spark = extensions.sparkSession
    shared = spark.sparkContext.broadcast((v, _known_sources(sources)))

    def one(meta: dict[str, Any], base_type: str | None) -> Iterator[tuple[str, str, str]]:
        vocabulary, known = shared.value
        lacking = [k for k in ("schema_version", "extension_id", "extends_entity", "review_status", "admission", "relations", "review") if k not in meta]
        if lacking:
            yield "V23", "", f"missing fields: {', '.join(lacking)}"
            return
        if blank(meta["extension_id"]) or not meta["extension_id"].startswith(prefix):
            yield "V23", "extension_id", f"extension id doesn't start with {prefix}"
        if meta["review_status"] != "reviewed":
            yield "V23", "review_status", "extension is not reviewed"
        admission = meta["admission"] if isinstance(meta["admission"], dict) else {}
        if admission.get("batch_id") != batch or not admission.get("atom_ids"):
            yield "V23", "admission", "extension is not admitted in the batch"
        if not isinstance(meta["review"], dict) or meta["review"].get("reviewed_by") != reviewer or not meta["review"].get("last_reviewed"):
            yield "V23", "review", f"not reviewed by {reviewer}, or without a date"
        if base_type is None:
            yield "V23", "extends_entity", f"entity {meta['extends_entity']} is unknown"
            return
        if not isinstance(meta["relations"], list) or not meta["relations"]:
            yield "V23", "relations", "extension has no relations"
            return
        seen: set[tuple[str, str]] = set()
        for k, r in enumerate(meta["relations"]):
            at = f"relations[{k}]"
            for _, where, message in relation_findings(r, at, base_type, seen, vocabulary, known):
                yield "V23", where, message
            if isinstance(r, dict) and isinstance(r.get("qualifiers"), dict):
                if r.get("relation_status") != "reviewed":
                    yield "V23", at, "relation is not reviewed"
                if r["qualifiers"].get("source_atom_id") not in (admission.get("atom_ids") or []):
                    yield "V23", at, "relation's atom is not admitted by the document"

    @F.pandas_udf(FOUND)
    def local(metas: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([_as_rows(one(json.loads(m), t if isinstance(t, str) else None)) for m, t in zip(metas, types, strict=True)])

    parsed = extensions.where("parse_error IS NULL").withColumn("extends_entity", F.get_json_object("meta", "$.extends_entity"))
    placed = parsed.join(nodes.select(F.col("id").alias("extends_entity"), F.col("entity_type").alias("base_type")), "extends_entity", "left")
    found = placed.select("path", F.explode(local("meta", "base_type")).alias("f")).select(F.lit("ERROR").alias("level"), "f.rule_id", F.lit(23).alias("ordinal"), "path", "f.locus", "f.message")
    unparsed = extensions.where("parse_error IS NOT NULL").select(F.lit("ERROR").alias("level"), F.lit("V23").alias("rule_id"), F.lit(23).alias("ordinal"), "path", F.lit("").alias("locus"), F.col("parse_error").alias("message"))
    ids = parsed.select("path", F.get_json_object("meta", "$.extension_id").alias("id")).where("id IS NOT NULL")
    again = ids.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("path"))).where("nth > 1")
    repeated = again.select(F.lit("ERROR").alias("level"), F.lit("V23").alias("rule_id"), F.lit(23).alias("ordinal"), "path", F.lit("extension_id").alias("locus"), F.concat(F.lit("repeated extension id "), "id").alias("message"))
    return found.unionByName(unparsed).unionByName(repeated)
