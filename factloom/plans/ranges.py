"""Queries that compare by hash trees and bitmaps what the plain operators compare by joining everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import hash_tree, integrity, rules
from factloom.operators.graph import triples
from factloom.plans.queries import query
from factloom.plans.tables import contains
from factloom.session import materialize, table


@query("""WITH a AS (SELECT o_orderkey AS name, o_totalprice::DECIMAL(18, 2) AS h FROM orders WHERE o_totalprice > 1600), b AS (SELECT o_orderkey AS name, CASE WHEN o_totalprice > 499000 THEN -1 ELSE o_totalprice::DECIMAL(18, 2) END AS h FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice > 480000))
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'EXTRA' WHEN b.name IS NULL THEN 'MISSING' WHEN a.h <> b.h THEN 'STALE' ELSE 'OK' END AS status FROM a FULL JOIN b ON a.name = b.name""")
def drift_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as artifacts of which few have changed: the dearest are stale, some are missing and the cheapest extra."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    digest = lambda c: F.sha2(c.cast("string"), 256).alias("sha256")
    want = o.where("p > 1600").select("name", digest(F.col("p")))
    have = o.where("NOT (o_orderstatus = 'P' AND p > 480000)").select("name", digest(F.when(F.col("p") > 499000, F.lit(-1)).otherwise(F.col("p"))))
    return hash_tree.drift(want, have)


@query("""WITH e AS (SELECT l_orderkey AS orderkey, l_partkey AS partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'left' AS side, orderkey, partkey FROM e WHERE n > 1 AND partkey <> 1 UNION ALL SELECT 'right', orderkey, partkey FROM e WHERE partkey = 1""")
def triples_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Stored triples of orders' parts, in which those of several line items stand twice and those of part 1 are lacking."""
    edges = materialize(contains(spark, d).drop("statement_zh", "source_file"), "edges")  # grouped once, read for either side's tree and rows
    times = F.explode(F.when(F.size("evidence") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    stored = triples(edges.where("object <> 'part.1'").select("*", times.alias("time")))
    key = lambda c: F.substring_index(c, ".", -1).cast("bigint")
    return integrity.triples_differ(stored, edges, by_ranges=True).select("side", key("subject").alias("orderkey"), key("object").alias("partkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45 AND l_discount >= 0.09)")
def sparse_absences(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a large line item at the highest discounts, as nearly all are: a bitmap settles them without a shuffle."""
    known = table(spark, d, "lineitem").where("l_quantity >= 45 AND l_discount >= 0.09").select("l_orderkey")
    return rules.not_in(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"o_orderkey": "l_orderkey"}, known, sparse=True)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_totalprice > 350000), b AS (SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal < 0)
SELECT custkey, 'missing' AS side FROM a WHERE custkey NOT IN (SELECT custkey FROM b) UNION ALL SELECT custkey, 'extra' FROM b WHERE custkey NOT IN (SELECT custkey FROM a)""")
def sparse_missing_and_extra(spark: SparkSession, d: str) -> DataFrame:
    """Customers of the dearest orders against those in debt, two lists with little in common."""
    dear = table(spark, d, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("custkey"))
    return rules.missing_and_extra(dear, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("custkey")), "custkey", sparse=True)
