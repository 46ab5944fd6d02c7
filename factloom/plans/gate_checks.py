"""Queries over whole gates, schemas and reports, in which every rule has something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import api
from factloom.functions import json_schema
from factloom.functions.canonical import blob_sha1, canonical_sha256, file_sha256
from factloom.functions.text import numbered_id
from factloom.operators import gates, graph
from factloom.plans.checks import gate
from factloom.plans.queries import query
from factloom.plans.tables import ident
from factloom.session import materialize, scratch_path, table
from factloom.sources import documents as sources


@query("""WITH o AS (SELECT 'e' || o_orderkey AS a, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS t FROM orders), c AS (SELECT c_custkey AS k, c_acctbal > 0 AS here, c_nationkey AS n FROM customer), f AS (
  SELECT 'batch_known' AS rule_id, 'B9' AS locus UNION ALL SELECT 'node_ids', 'customer.' || k FROM c WHERE here AND n = 3 UNION ALL SELECT 'planned_nodes', 'customer.' || k FROM c WHERE here = (n = 4) UNION ALL SELECT 'planned_edges', a FROM o WHERE t > 300000
  UNION ALL SELECT 'endpoints', 'customer.' || k FROM c WHERE NOT here AND k IN (SELECT c FROM o) UNION ALL SELECT 'reviewed', a FROM o WHERE s = 'P' UNION ALL SELECT 'other_batches', a FROM o WHERE p = '1-URGENT' UNION ALL SELECT 'sources', 's.5-LOW' FROM o WHERE p = '5-LOW'
  UNION ALL SELECT 'triples', a FROM o WHERE p = '4-NOT SPECIFIED' UNION ALL SELECT 'artifact_hash', r_name FROM region WHERE r_regionkey IN (0, 1) UNION ALL SELECT 'artifact_size', r_name FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'private_paths', n_name FROM nation WHERE n_regionkey = 1
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def intake_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as edges to customers, checked against a plan, other batches, a registry, stored triples, artifacts and texts that each differ in part."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    atom, source = F.concat(F.lit("e"), F.col("o_orderkey").cast("string")), F.concat(F.lit("s."), F.col("o_orderpriority"))
    entry = F.array(F.struct(source.alias("source_id"), F.lit("l").alias("locator"), F.lit("t").alias("evidence_type")))
    edges = o.select(ident("orders", "o_orderkey").alias("subject"), F.lit("placed_by").alias("predicate"), ident("customer", "o_custkey").alias("object"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("reviewed").alias("relation_status"), entry.alias("evidence"), F.to_json(F.struct(atom.alias("source_atom_id"))).alias("qualifiers"), F.col("o_orderpriority").alias("p"))
    edges = materialize(edges, "edges")
    ids, orders = c.select(ident("customer", "c_custkey").alias("id"), "c_acctbal", "c_nationkey"), o.select(ident("orders", "o_orderkey").alias("id"))
    here = ids.where("c_acctbal > 0")
    nodes = here.select("id").unionByName(here.where("c_nationkey = 3").select("id")).unionByName(orders)
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    size = F.length("r_name").cast("bigint")
    tables = {
        # a batch's atoms stand in many rows, each of those within 10,000 keys
        "batches": o.where("o_orderpriority = '1-URGENT'").groupBy(F.floor(F.col("o_orderkey") / 10_000)).agg(F.collect_list(atom).alias("edge_atom_ids")).select(F.lit("B1").alias("batch_id"), "edge_atom_ids", F.lit(None).cast("array<string>").alias("qualifier_atom_ids")),
        "nodes": nodes, "edges": edges.drop("p"), "registry": o.where("o_orderpriority <> '5-LOW'").select(source.alias("source_id")).distinct(), "planned_entities": ids.where("c_nationkey <> 4").select("id").unionByName(orders),
        "planned_atoms": o.where("o_totalprice <= 300000").select(atom.alias("atom_id")), "triples": graph.triples(edges.where("p <> '4-NOT SPECIFIED'")), "manifest": r.select(F.col("r_name").alias("name"), F.lit("h").alias("sha256"), size.alias("size_bytes")),
        "files": r.where("r_regionkey <> 0").select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 1, "x").otherwise("h").alias("sha256"), (size + (F.col("r_regionkey") == 2).cast("int")).alias("size_bytes")),
        "texts": n.select(F.col("n_name").alias("path"), F.when(F.col("n_regionkey") == 1, "see /home/me").otherwise("fine").alias("text")),
    }
    return gate(gates.intake("B9", {"home": "/home/"}), tables)


@query("""WITH p AS (SELECT 'P-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS id, p_size AS z, p_brand AS b FROM part), k AS (
  SELECT id, z, b FROM p WHERE z <> 1 UNION ALL SELECT id, z, b FROM p WHERE z = 2
), s AS (
  SELECT 'C-' || s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'ANSWER' ELSE 'ABSTAIN' END AS dis, s_nationkey AS n, 'P-' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS need FROM supplier
), q AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE n = 3), f AS (
  SELECT 'groups' AS rule_id, CAST(count(DISTINCT b) AS VARCHAR) AS locus FROM k UNION ALL SELECT 'claim_ids', id FROM p WHERE z IN (1, 2) UNION ALL SELECT 'claim_order', CAST(count(*) AS VARCHAR) FROM k
  UNION ALL SELECT 'relation_claims', CAST(count(*) AS VARCHAR) FROM k WHERE z <= 40 UNION ALL SELECT 'narrative_claims', CAST(count(*) AS VARCHAR) FROM k WHERE z > 40 UNION ALL SELECT 'case_ids', id FROM s WHERE n = 3
  UNION ALL SELECT 'dispositions', dis FROM q GROUP BY dis UNION ALL SELECT 'case_claims', id FROM q WHERE need NOT IN (SELECT id FROM p WHERE z > 5)
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def authority_findings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as claims, some missing or repeated, and suppliers as cases that need one each; every declared number is another."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    own = p.select(F.col("p_brand").alias("group_id"), numbered_id("P-", F.col("p_partkey")).alias("claim_id"), F.when(F.col("p_size") <= 40, "is").alias("predicate"), "p_size")
    claims = own.where("p_size <> 1").unionByName(own.where("p_size = 2")).drop("p_size")
    case = s.select(F.concat(F.lit("C-"), F.col("s_suppkey").cast("string")).alias("case_id"), F.when(F.col("s_nationkey") % 2 == 0, "ANSWER").otherwise("ABSTAIN").alias("expected_disposition"), F.array(numbered_id("P-", F.col("s_suppkey"))).alias("required_claim_ids"), "s_nationkey")
    cases = case.unionByName(case.where("s_nationkey = 3")).drop("s_nationkey")
    declared = spark.createDataFrame([("ANSWER", 0), ("ABSTAIN", 1)], "key string, want bigint")
    last = p.agg(F.max("p_partkey")).first()[0] or 0
    return gate(gates.authority("P-", 0, last, 0, 0, 0), {"claims": claims, "cases": cases, "declared": declared, "known_claims": own.where("p_size > 5").select("claim_id")})


@query("""WITH s AS (SELECT 'f' || s_suppkey AS path, s_nationkey AS n FROM supplier), f AS (
  SELECT 'files' AS rule_id, path AS locus FROM s WHERE n IN (1, 2) UNION ALL SELECT 'paths', path FROM s WHERE n = 3 UNION ALL SELECT 'self_hash', 'x' UNION ALL SELECT 'repository', path FROM s WHERE n = 4
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def whole_bundle_findings(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files of a bundle: gone, changed, listed twice, another object in the repository; and a manifest whose own hash isn't the declared one."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.encode("s_name", "UTF-8").alias("content"), F.col("s_nationkey").alias("n"))
    files = s.where("n <> 1").select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.when(F.col("n") == 2, F.encode(F.reverse(F.decode("content", "UTF-8")), "UTF-8")).otherwise(F.col("content")).alias("content"))
    listed = s.select("path", F.octet_length("content").cast("bigint").alias("size_bytes"), file_sha256(F.col("content")).alias("sha256"), blob_sha1(F.col("content")).alias("source_blob_sha1"), "n")
    manifest = listed.unionByName(listed.where("n = 3")).drop("n")
    text = spark.createDataFrame([('{"bundle_sha256": "x", "files": 1}',)], "t string")
    self_hash = text.select(F.get_json_object("t", "$.bundle_sha256").alias("declared"), canonical_sha256(F.col("t"), ("bundle_sha256",)).alias("computed"))
    references = listed.where("n <> 3").select("path", F.when(F.col("n") == 4, "y").otherwise(F.col("source_blob_sha1")).alias("object_id"))
    return gate(gates.bundle(), {"manifest": manifest, "files": files, "self_hash": self_hash, "references": references})


@query("""WITH e AS (SELECT event_id, event_type AS t, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), f AS (
  SELECT event_id, '' AS path, 'required' AS keyword FROM e WHERE u % 11 = 0 UNION ALL SELECT event_id, '/k', 'maximum' FROM e WHERE k > 50 UNION ALL SELECT event_id, '/k', 'minimum' FROM e WHERE k < 3 UNION ALL SELECT event_id, '/k', 'not' FROM e WHERE k IN (7, 60)
  UNION ALL SELECT event_id, '/s', 'minLength' FROM e WHERE u % 11 <> 0 AND length(t) < 5 UNION ALL SELECT event_id, '/s', 'pattern' FROM e WHERE u % 11 <> 0 AND NOT regexp_matches(t, '[aeiou]$|k$') UNION ALL SELECT event_id, '/x', 'uniqueItems' FROM e WHERE u % 2 = 0
  UNION ALL SELECT event_id, '/x', 'minItems' FROM e WHERE u % 2 = 1 AND u % 3 = 0 UNION ALL SELECT event_id, '/x/0', 'type' FROM e WHERE u % 7 = 0 AND NOT (u % 2 = 1 AND u % 3 = 0)
)
SELECT event_id, CAST(count(*) AS INTEGER) AS problems, min(path || ' ' || keyword) AS first FROM f GROUP BY event_id""")
def first_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """Events against a schema of more keywords: how many problems each has, and the first by place and keyword."""
    schema = {"type": "object", "required": ["s"], "properties": {"k": {"minimum": 3, "maximum": 50, "not": {"enum": [7, 60]}}, "s": {"minLength": 5, "pattern": "[aeiou]$|k$"}, "x": {"uniqueItems": True, "minItems": 1, "items": {"type": "integer"}}}}
    u, k = F.col("user_id"), F.get_json_object("props", "$.k")
    one = F.when(u % 7 == 0, '"a"').otherwise("1")
    items = F.when(u % 2 == 0, F.concat(one, F.lit(","), F.when(u % 7 == 0, '"a"').otherwise("1"))).when(u % 3 == 0, "").otherwise(one)
    # of two equal strings both have the wrong type; only the first is kept wrong here by making the second fit where it must differ
    record = F.concat(F.lit('{"k":'), k, F.when(u % 11 != 0, F.concat(F.lit(',"s":"'), F.col("event_type"), F.lit('"'))).otherwise(""), F.lit(',"x":['), items, F.lit("]}"))
    found = table(spark, d, "events").select("event_id", F.filter(json_schema.schema_problems(record, schema), lambda x: ~((x["path"] == "/x/1") & (x["keyword"] == "type"))).alias("p")).where("size(p) > 0")
    return found.select("event_id", F.size("p").alias("problems"), F.concat(json_schema.first_problem(F.col("p"))["path"], F.lit(" "), json_schema.first_problem(F.col("p"))["keyword"]).alias("first"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal < 0 AS miss FROM supplier)
SELECT CASE WHEN count(*) FILTER (WHERE miss) > 0 OR max(k) > 1 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE NOT miss) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE miss) AS BIGINT) AS failed,
  CAST(count(*) FILTER (WHERE miss) + (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS BIGINT) AS failures, string_agg('C-' || k, ',' ORDER BY 'C-' || k) FILTER (WHERE miss) AS missing, 'FAIL' AS qualifiers, 'PASS' AS terms, TRUE AS current FROM s""")
def regression_report_file(spark: SparkSession, d: str) -> DataFrame:
    """The report of a suite of suppliers as cases, written as YAML, read back, and compared with what is to be written."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    key = F.col("s_suppkey").cast("string")
    cases = s.select(F.concat(F.lit("C-"), key).alias("case_id"), F.lit("ANSWER").alias("expected_disposition"), F.array(F.concat(F.lit("A-"), key)).alias("required_claim_ids"))
    claims = s.where("s_acctbal >= 0").select(F.concat(F.lit("A-"), key).alias("claim_id"))
    broken = n.where("n_regionkey = 1").select(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("claim_id"), F.lit("flag").alias("key"), F.lit("differs").alias("problem"))
    report = api.regression_report("suite", "0" * 64, cases, claims, broken, spark.createDataFrame([], "claim_id string, term string"), {"flag": True}, "note")
    folder = scratch_path(spark, "report")
    api.write_report(spark, folder, "report.yml", report)
    current = api.report_is_current(spark, folder, "report.yml", report)
    got = lambda p: F.get_json_object("meta", p)
    missing = F.filter(F.from_json(got("$.case_results"), "array<struct<case_id:string,result:string,missing_claim_ids:array<string>>>"), lambda c: (c["result"] == "FAIL") & (F.size(c["missing_claim_ids"]) == 1))
    return sources.read_yaml(spark, folder).select(
        got("$.status").alias("status"), *[got(f"$.counts.{c}").cast("bigint").alias(c) for c in ("cases", "passed", "failed")], F.size(F.from_json(got("$.failures"), "array<string>")).cast("bigint").alias("failures"),
        F.nullif(F.array_join(F.transform(missing, lambda c: c["case_id"]), ","), F.lit("")).alias("missing"), got("$.boundary_checks.required_qualifiers").alias("qualifiers"), got("$.boundary_checks.excluded_terms").alias("terms"), F.lit(current).alias("current"),
    )
