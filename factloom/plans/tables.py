"""The star-schema tables seen as an evidence graph.

Entities are regions, nations, customers, suppliers, parts and orders; relations are their keys; the evidence
of `order contains part` is its line items; order status F stands for reviewed, priority for batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import table

KINDS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"), "orders": ("o_orderkey", "o_orderpriority")}


def ident(kind: str, key: str):
    return F.concat(F.lit(kind + "."), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_type, name, review_status)."""
    rows = []
    for kind, (key, name) in KINDS.items():
        status = F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft") if kind == "orders" else F.lit("reviewed")
        rows.append(table(spark, sf_dir, kind).select(ident(kind, key).alias("id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), status.alias("review_status")))
    return reduce(DataFrame.unionByName, rows)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object) of all key relations but line items."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("customer").select(ident("customer", "c_custkey"), F.lit("in_nation"), ident("nation", "c_nationkey")),
        t("supplier").select(ident("supplier", "s_suppkey"), F.lit("in_nation"), ident("nation", "s_nationkey")),
        t("nation").select(ident("nation", "n_nationkey"), F.lit("in_region"), ident("region", "n_regionkey")),
        t("orders").select(ident("orders", "o_orderkey"), F.lit("placed_by"), ident("customer", "o_custkey")),
    ]
    return reduce(DataFrame.union, parts).toDF("subject", "predicate", "object")


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges `order contains part` with their evidence, one array entry for each line item, and qualifiers JSON."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    entry = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"))
    # nearly every group has one row, so rows are dealt by group before and not as arrays after a partial aggregation
    grouped = items.repartition("l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.array_sort(F.collect_list(entry)).alias("items"), F.min("l_linestatus").alias("_lo"), F.max("l_linestatus").alias("_hi"))
    evidence = F.transform("items", lambda x: F.struct(F.concat(F.lit("supplier."), x["s"].cast("string")).alias("source_id"), x["n"].cast("string").alias("locator"), x["f"].alias("evidence_type")))
    status = F.when((F.col("_lo") == "F") & (F.col("_hi") == "F"), "reviewed").otherwise("draft")
    subject, target = ident("orders", "l_orderkey"), ident("part", "l_partkey")
    atom = F.concat(F.lit('{"source_atom_id":"'), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit('"}'))
    return grouped.select(subject.alias("subject"), F.lit("contains").alias("predicate"), target.alias("object"), F.concat(subject, F.lit(" contains "), target).alias("statement_zh"), status.alias("relation_status"), evidence.alias("evidence"), atom.alias("qualifiers"), F.lit("lineitem").alias("source_file"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed documents: priority is the batch, status F reviewed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    meta = F.struct(ident("orders", "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft").alias("review_status"), F.struct(F.col("o_orderpriority").alias("batch_id")).alias("admission"))
    return o.withColumns({"path": F.concat(ident("orders", "o_orderkey"), F.lit(".md")), "meta": F.to_json(meta), "parse_error": F.lit(None).cast("string")})


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as an edge with itself as evidence."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    entry = F.struct(ident("supplier", "l_suppkey").alias("source_id"), F.col("l_linenumber").cast("string").alias("locator"), F.col("l_returnflag").alias("evidence_type"))
    return items.select(ident("orders", "l_orderkey").alias("subject"), F.lit("contains").alias("predicate"), ident("part", "l_partkey").alias("object"), F.array(entry).alias("evidence"))


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as registered sources, with their balance."""
    no_text = lambda name: F.lit(None).cast("string").alias(name)
    fields = [F.lit("supplier").alias("source_type"), F.col("s_name").alias("title"), F.lit("open").alias("access_level"), F.lit(None).cast("array<string>").alias("creators")]
    return table(spark, sf_dir, "supplier").select(ident("supplier", "s_suppkey").alias("source_id"), *fields, *[no_text(n) for n in ("url", "publication_date", "page_date", "page_last_reviewed")], "s_acctbal")


def turn_id():
    return F.concat_ws(":", "conv_id", "turn")


def conversation_answers(turns: DataFrame, kind=None) -> DataFrame:
    """(request_id, answer_units): conversations as answers of a unit for each turn. kind: the unit type, claims if not given; a gap's code is its role."""
    kind = F.lit("MATERIAL_CLAIM") if kind is None else kind
    none = F.lit(None).cast("string")
    unit = F.struct("turn", turn_id().alias("unit_id"), kind.alias("unit_type"), F.when(kind == "MATERIAL_CLAIM", turn_id()).otherwise(none).alias("claim_id"), F.when(kind != "MATERIAL_CLAIM", F.col("role")).otherwise(none).alias("gap_code"))
    return turns.groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.array_sort(F.collect_list(unit)).alias("answer_units"))
