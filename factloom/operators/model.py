"""Schemas of the graph tables and the typed view of parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVIDENCE = struct(source_id=S, locator=S, evidence_type=S)
RELATION = struct(predicate=S, object=S, statement_zh=S, relation_status=S, evidence=T.ArrayType(EVIDENCE))
META = struct(
    id=S, extension_id=S, extends_entity=S, entity_type=S, name_zh=S, name_en=S, scientific_name=S, aliases=T.ArrayType(S), one_health_domains=T.ArrayType(S), summary=S, review_status=S,
    admission=struct(batch_id=S, source_ledger=S, atom_ids=T.ArrayType(S)), relations=T.ArrayType(RELATION), review=struct(extracted_by=S, reviewed_by=S, last_reviewed=S),
)
NODE_COLUMNS = ["id", "entity_type", "name_zh", "name_en", "scientific_name", "aliases", "one_health_domains", "summary", "review_status", "admission_batch_id", "source_atom_ids", "source_file"]
EDGE_COLUMNS = ["subject", "predicate", "object", "statement_zh", "relation_status", "evidence", "qualifiers", "source_file"]
TRIPLE_COLUMNS = ["subject", "predicate", "object", "relation_status", "source_atom_id", "evidence_source_ids"]


def variant(meta: Column) -> Column:
    return F.try_parse_json(meta)


def typed(docs: DataFrame) -> DataFrame:
    """docs with `m`, the typed metadata, and `qualifiers`, each relation's qualifiers as canonical JSON."""
    with_m = docs.withColumn("m", F.from_json("meta", META))
    raw = F.from_json("meta", "struct<relations:array<string>>")["relations"]
    return with_m.withColumn("qualifiers", F.transform(raw, lambda r: F.coalesce(F.get_json_object(r, "$.qualifiers"), F.lit("{}"))))
