"""One query for each family of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.canonical import canonical_sha256, file_sha256, ordered_digest
from factloom.operators import contract, corpus, evaluate, graph, integrity
from factloom.operators.corpus import passage_counts
from factloom.operators.rules import expect_counts, missing_and_extra, multiset_difference, not_in
from factloom.plans.tables import contains, conversation_answers, entities, line_edges, order_documents, relations, supplier_registry, turn_id
from factloom.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The SQL view of the graph tables.
WITH_ENTITIES = """e AS (
  SELECT 'region.' || r_regionkey AS id, 'region' AS entity_type, r_name AS name, 'reviewed' AS review_status FROM region
  UNION ALL SELECT 'nation.' || n_nationkey, 'nation', n_name, 'reviewed' FROM nation
  UNION ALL SELECT 'customer.' || c_custkey, 'customer', c_name, 'reviewed' FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey, 'supplier', s_name, 'reviewed' FROM supplier
  UNION ALL SELECT 'part.' || p_partkey, 'part', p_name, 'reviewed' FROM part
  UNION ALL SELECT 'orders.' || o_orderkey, 'orders', o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'reviewed' ELSE 'draft' END FROM orders
)"""
WITH_RELATIONS = """r AS (
  SELECT 'customer.' || c_custkey AS subject, 'in_nation' AS predicate, 'nation.' || c_nationkey AS object FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey, 'in_nation', 'nation.' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation.' || n_nationkey, 'in_region', 'region.' || n_regionkey FROM nation
  UNION ALL SELECT 'orders.' || o_orderkey, 'placed_by', 'customer.' || o_custkey FROM orders
)"""
WITH_CONTAINS = """k AS (
  SELECT l_orderkey, l_partkey, 'orders.' || l_orderkey AS subject, 'contains' AS predicate, 'part.' || l_partkey AS object,
    CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'F' THEN 'reviewed' ELSE 'draft' END AS relation_status,
    string_agg('supplier.' || l_suppkey, '|' ORDER BY l_linenumber, l_suppkey, l_returnflag) AS evidence_source_ids,
    string_agg(l_linenumber || ':' || l_returnflag, '|' ORDER BY l_linenumber, l_suppkey, l_returnflag) AS locators,
    count(*) AS n
  FROM lineitem GROUP BY l_orderkey, l_partkey
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


# ---- graph


@query(f"WITH {WITH_ENTITIES} SELECT id, entity_type, name, review_status FROM e")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d)


@query(f"WITH {WITH_CONTAINS} SELECT subject, predicate, object, relation_status, evidence_source_ids, locators, CAST(n AS BIGINT) AS n_evidence FROM k")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    e = contains(spark, d)
    join = lambda f: F.array_join(F.transform("evidence", f), "|")
    return e.select("subject", "predicate", "object", "relation_status", join(lambda x: x["source_id"]).alias("evidence_source_ids"), join(lambda x: F.concat(x["locator"], F.lit(":"), x["evidence_type"])).alias("locators"), F.size("evidence").cast("bigint").alias("n_evidence"))


@query(f"WITH {WITH_CONTAINS} SELECT subject, predicate, object, relation_status, l_orderkey || '-' || l_partkey AS source_atom_id, evidence_source_ids FROM k")
def graph_triples(spark: SparkSession, d: str) -> DataFrame:
    return graph.triples(contains(spark, d))


@query(f"WITH {WITH_RELATIONS} SELECT subject, predicate, object FROM r")
def graph_relations(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d)


@query(f"WITH {WITH_CONTAINS} SELECT subject, object, relation_status FROM k WHERE relation_status <> 'reviewed'")
def unreviewed_relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreviewed(contains(spark, d)).select("subject", "object", "relation_status")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def reviewed_batch_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = order_documents(spark, d)
    first = docs.agg(F.min("o_orderpriority")).first()[0]
    return graph.in_batch(docs, first).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderpriority AS batch_id, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS not_reviewed FROM orders GROUP BY o_orderpriority")
def batch_review_state(spark: SparkSession, d: str) -> DataFrame:
    chosen = graph.in_batch(order_documents(spark, d), F.col("o_orderpriority"), reviewed_only=False)
    return chosen.groupBy(F.col("m.admission.batch_id").alias("batch_id")).agg(F.count("*").alias("documents"), F.count_if(F.col("m.review_status") != "reviewed").alias("not_reviewed"))


@query(f"WITH {WITH_ENTITIES}, {WITH_RELATIONS} SELECT CAST((SELECT count(*) FROM e) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM r) AS BIGINT) AS edges, CAST((SELECT count(DISTINCT object) FROM r) AS BIGINT) AS targets")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    e, r = entities(spark, d).agg(F.count("*").alias("nodes")), relations(spark, d).agg(F.count("*").alias("edges"), F.count_distinct("object").alias("targets"))
    return e.crossJoin(r)  # one row each


# ---- referential rules


@query(f"WITH {WITH_RELATIONS}, {WITH_ENTITIES} SELECT subject, predicate, object FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = r.object AND e.review_status = 'reviewed' AND (e.entity_type <> 'customer' OR EXISTS (SELECT 1 FROM customer c WHERE 'customer.' || c.c_custkey = e.id AND c.c_acctbal >= 0)))")
def dangling_reviewed_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a negative balance count as not reviewed."""
    owing = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("id"))
    known = entities(spark, d).where("review_status = 'reviewed'").join(owing, "id", "left_anti")
    return not_in(relations(spark, d), {"object": "id"}, known)


_VOCABULARY = [("customer", "in_nation", "nation"), ("nation", "in_region", "region"), ("orders", "placed_by", "customer")]


@query(f"""WITH {WITH_RELATIONS}, v(subject_type, predicate, object_type) AS (VALUES ('customer', 'in_nation', 'nation'), ('nation', 'in_region', 'region'), ('orders', 'placed_by', 'customer'))
SELECT subject, r.predicate, object FROM r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.predicate = r.predicate AND v.subject_type = split_part(r.subject, '.', 1) AND v.object_type = split_part(r.object, '.', 1))""")
def domain_range_violations(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose subject or object type the vocabulary hasn't: suppliers."""
    v = spark.createDataFrame(_VOCABULARY, "subject_type string, predicate string, object_type string")
    kind = lambda c: F.substring_index(c, ".", 1)
    rows = relations(spark, d).withColumns({"subject_type": kind("subject"), "object_type": kind("object")})
    return not_in(rows, {c: c for c in v.columns}, v, vocabulary=True).select("subject", "predicate", "object")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal >= 0)")
def unregistered_evidence(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "supplier").where("s_acctbal >= 0")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return not_in(rows, {"l_suppkey": "s_suppkey"}, registry)


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT text_key, doc_id AS first_doc_id, n FROM (SELECT md5(coalesce(text, '')) AS text_key, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1) x")
def first_wins_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_key"), F.col("doc_id").alias("first_doc_id"))
    return graph.first_wins(rows, ["text_key"], ["first_doc_id"])


@query("SELECT event_type, event_id AS last_event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1")
def last_wins_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("last_event_id"), "user_id", "ts")
    return graph.last_wins(rows, ["event_type"], ["ts", "last_event_id"]).select("event_type", "last_event_id", "user_id")


@query(f"WITH {WITH_RELATIONS} SELECT predicate, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT subject) AS BIGINT) AS subjects, CAST(count(DISTINCT object) AS BIGINT) AS objects FROM r GROUP BY predicate")
def distinct_vs_total(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d).groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))


# ---- catalog and corpus


@query("""SELECT 'supplier.' || l_suppkey AS source_id, any_value(s_name) AS title, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS evidence_types,
  string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), '|' ORDER BY CAST(l_linenumber AS VARCHAR)) AS locators FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey""")
def evidence_catalog(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.source_catalog(line_edges(spark, d), supplier_registry(spark, d))
    return found.select("source_id", "title", F.array_join("allowed_evidence_types", "|").alias("evidence_types"), F.array_join("locators", "|").alias("locators"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, ''), 'unknown') AS label, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS fallback FROM documents")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    return table(spark, d, "documents").select("doc_id", F.coalesce(X.first_nonempty(lang, F.col("source")), F.lit("unknown")).alias("label"), F.coalesce(X.first_nonempty(F.when(lang == "en", "").otherwise(lang), F.col("source")), F.lit("none")).alias("fallback"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered, CAST(count(*) AS BIGINT) AS units FROM conversations GROUP BY conv_id")
def answer_rendering(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as answers: each turn is a claim unit."""
    turns = table(spark, d, "conversations")
    responses = conversation_answers(turns)
    claims = turns.select(turn_id().alias("claim_id"), F.concat("role", F.lit(": "), "text").alias("render_text"))
    gaps, notices = (spark.createDataFrame([], f"{k} string, {v} string") for k, v in (("gap_code", "text"), ("claim_id", "notice")))
    told = contract.render_answers(responses, claims, gaps, notices)
    return told.join(responses.select("request_id", F.size("answer_units").cast("bigint").alias("units")), "request_id").select(F.col("request_id").cast("bigint").alias("conv_id"), "rendered", "units")


@query("SELECT p_brand, sha256(string_agg(p_partkey || ':' || p_name || chr(10), '' ORDER BY p_partkey)) AS corpus_sha256, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part GROUP BY p_brand")
def corpus_sections(spark: SparkSession, d: str) -> DataFrame:
    chunk = F.encode(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name", F.lit("\n")), "UTF-8")
    return table(spark, d, "part").groupBy("p_brand").agg(ordered_digest(F.col("p_partkey"), chunk).alias("corpus_sha256"), F.sum(F.length("p_name")).alias("chars"))


# ---- counts and sets


@query("""WITH want(key, want) AS (VALUES ('F', 0), ('O', 1), ('X', 2)), have AS (SELECT o_orderstatus AS key, count(*) AS have FROM orders GROUP BY 1)
SELECT coalesce(w.key, h.key) AS key, CAST(coalesce(want, 0) AS BIGINT) AS want, CAST(coalesce(have, 0) AS BIGINT) AS have FROM want w FULL JOIN have h ON w.key = h.key WHERE coalesce(want, 0) <> coalesce(have, 0)""")
def group_count_vs_expected(spark: SparkSession, d: str) -> DataFrame:
    return expect_counts(table(spark, d, "orders"), "o_orderstatus", spark.createDataFrame([("F", 0), ("O", 1), ("X", 2)], "key string, want bigint"))


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS items, CAST(max(l_linenumber) AS BIGINT) AS declared FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber)")
def declared_vs_actual_length(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("bigint").alias("count"), F.collect_list("l_linenumber").alias("atom_ids"))
    return integrity.declared_counts(classes).select("l_orderkey", F.size("atom_ids").cast("bigint").alias("items"), F.col("count").alias("declared"))


@query("""WITH c AS (SELECT p_partkey AS atom_id, 'small' AS class FROM part WHERE p_size <= 20 UNION ALL SELECT p_partkey, 'cheap' FROM part WHERE p_retailprice < 1000 UNION ALL SELECT p_partkey, 'large' FROM part WHERE p_size > 40)
SELECT p.p_partkey AS atom_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM part p LEFT JOIN (SELECT atom_id, count(*) AS n FROM c GROUP BY 1) x ON x.atom_id = p.p_partkey WHERE n IS NULL OR n > 1""")
def partition_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    labels = F.array_compact(F.array(F.when(F.col("p_size") <= 20, "small"), F.when(F.col("p_retailprice") < 1000, "cheap"), F.when(F.col("p_size") > 40, "large")))
    classified = p.select(F.col("p_partkey").alias("atom_id"), F.explode(labels).alias("class"))
    return integrity.partition_problems(p.select(F.col("p_partkey").alias("atom_id")), classified)


@query("""SELECT o_custkey AS custkey, 'extra' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> (SELECT min(c_mktsegment) FROM customer)) a
UNION ALL SELECT c_custkey, 'missing' FROM (SELECT c_custkey FROM customer WHERE c_mktsegment <> (SELECT min(c_mktsegment) FROM customer) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') b""")
def missing_and_extra_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    least = c.agg(F.min("c_mktsegment").alias("least"))
    planned = c.join(F.broadcast(least), F.col("c_mktsegment") == F.col("least"), "left_anti").select(F.col("c_custkey").alias("custkey"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return missing_and_extra(planned, done, "custkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' INTERSECT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def later_batch_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases that ask for the parts they got early; the parts they got late belong to a later batch."""
    atom = F.concat_ws("-", "l_orderkey", "l_partkey")
    items = table(spark, d, "lineitem").select("l_orderkey", atom.alias("atom_id"), (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).alias("late"))
    cases = items.where(~F.col("late")).groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("atom_id").alias("required_relation_atom_ids"))
    found = evaluate.leakage(cases, items.where("late"))
    return found.select(F.col("case_id").alias("l_orderkey"), F.substring_index("atom_id", "-", -1).cast("bigint").alias("l_partkey"))


@query("""WITH x AS (SELECT o_custkey AS c, l_suppkey AS s, l_shipdate > (SELECT quantile_disc(l_shipdate, 0.5) FROM lineitem) AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT c AS c_custkey, s AS s_suppkey FROM x WHERE NOT late INTERSECT SELECT c, s FROM x WHERE late""")
def later_supplier_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cases that ask for the suppliers they had in the first half of the line items by date; those they had later belong to a later batch."""
    atom = F.concat_ws("-", "o_custkey", "l_suppkey")
    middle = table(spark, d, "lineitem").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(CAST(l_shipdate AS TIMESTAMP)))")).first()[0]
    items = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", atom.alias("atom_id"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) > F.lit(middle).cast("bigint")).alias("late"))
    cases = items.where(~F.col("late")).groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_set("atom_id").alias("required_relation_atom_ids"))
    found = evaluate.leakage(cases, items.where("late"))
    return found.select(F.col("case_id").alias("c_custkey"), F.substring_index("atom_id", "-", -1).cast("bigint").alias("s_suppkey"))


@query("""SELECT o_orderkey, CASE WHEN n = k THEN 'subset' ELSE 'not_subset' END AS relation FROM (SELECT o_orderkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT CASE WHEN s_acctbal >= 1000 THEN l_suppkey END) AS k
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey) x""")
def subset_of_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Whether an order's suppliers are a subset of those with a balance of 1000 or more."""
    good = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 1000).alias("ok"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(good, F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.col("l_suppkey").cast("string")
    per = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(key).alias("used"), F.collect_set(F.when(F.col("ok"), key)).alias("allowed"))
    rows = table(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey")
    return rows.select("o_orderkey", F.when(X.is_subset(F.col("used"), F.col("allowed")), "subset").otherwise("not_subset").alias("relation"))


@query("""WITH a AS (SELECT o_custkey AS custkey, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderpriority < '3' GROUP BY 1, 2), b AS (SELECT o_custkey AS custkey, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderpriority >= '3' GROUP BY 1, 2)
SELECT coalesce(a.custkey, b.custkey) AS custkey, coalesce(a.status, b.status) AS status, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS surplus FROM a FULL JOIN b ON a.custkey = b.custkey AND a.status = b.status WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_equality(spark: SparkSession, d: str) -> DataFrame:
    """How often (customer, status) is in one half of the orders more than in the other."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") < "3").alias("left"))
    rows = multiset_difference(o.where("left").drop("left"), o.where("not left").drop("left"))
    return rows.groupBy("custkey", "status").agg(F.sum(F.when(F.col("side") == "left", 1).otherwise(-1)).alias("surplus"))


@query("SELECT part_no AS missing_key FROM (SELECT unnest(generate_series(1, (SELECT max(p_partkey) FROM part))) AS part_no) s WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = part_no AND p.p_size > 5)")
def dense_id_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the dense sequence that no part of a size over 5 has."""
    p = table(spark, d, "part")
    last = p.agg(F.max("p_partkey")).first()[0] or 0
    have = p.where("p_size > 5").select(X.numbered_id("P-", F.col("p_partkey")).alias("id"))
    found = graph.coverage(have, "P-", 1, last).where("problem = 'missing'")
    return found.select(F.substring_index("id", "-", -1).cast("bigint").alias("missing_key"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS sources, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large FROM lineitem GROUP BY 1, 2")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("sources"), F.count_if(F.col("l_quantity") > 25).alias("large"))


# ---- keys, qualifiers, patterns


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_key FROM events")
def required_key_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.all_keys(F.try_parse_json("props"), ["k"]).alias("has_key"))


@query("SELECT e.event_id, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS have, e.user_id % 7 AS want FROM events e WHERE CAST(json_extract_string(e.props, '$.k') AS BIGINT) <> e.user_id % 7")
def json_qualifier_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Events as edges whose qualifier k must be the user's number modulo 7."""
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("claim_id"), "props", "user_id")
    edges = events.select(F.concat(F.lit('{"source_atom_id":"'), "claim_id", F.lit('",'), F.substring("props", 2, 1_000_000)).alias("qualifiers"))
    expected = events.select("claim_id", F.lit("k").alias("key"), (F.col("user_id") % 7).cast("string").alias("value"))
    failed = evaluate.boundary_failures(expected, edges).where("problem = 'qualifier differs'")
    rows = events.join(failed.select("claim_id"), "claim_id")
    return rows.select(F.col("claim_id").cast("bigint").alias("event_id"), X.variant_at(F.try_parse_json("props"), "$.k", "bigint").alias("have"), (F.col("user_id") % 7).alias("want"))


@query(r"SELECT doc_id, coalesce(regexp_full_match(source, 'src[0-9]'), FALSE) AS short_source, contains(text, 'License') AS has_license, coalesce(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) = 0, TRUE) AS is_blank, starts_with(text, 'The') AS starts_the FROM documents")
def pattern_and_heading_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select("doc_id", X.full_match(F.col("source"), "src[0-9]").alias("short_source"), F.contains("text", F.lit("License")).alias("has_license"), X.is_blank(F.col("text")).alias("is_blank"), F.startswith("text", F.lit("The")).alias("starts_the"))


LEAKS = {"mail": r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+", "token": r"token = \"", "license": r"mit license"}


@query(r"""SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9]+\.[a-z]+') THEN 'mail' END, CASE WHEN regexp_matches(text, '(?i)token = "') THEN 'token' END, CASE WHEN regexp_matches(text, '(?i)mit license') THEN 'license' END) AS leaks
FROM documents WHERE regexp_matches(text, '(?i)([a-z0-9._]+@[a-z0-9]+\.[a-z]+|token = "|mit license)')""")
def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.leaks(F.col("text"), LEAKS).alias("found"))
    return rows.where("size(found) > 0").select("doc_id", F.array_join("found", "|").alias("leaks"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", file_sha256(F.encode("text", "UTF-8")).alias("text_sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS row_sha256 FROM customer""")
def canonical_row_hash(spark: SparkSession, d: str) -> DataFrame:
    unsorted = F.to_json(F.struct("c_nationkey", "c_name", "c_custkey", "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", canonical_sha256(unsorted).alias("row_sha256"))


@query("SELECT n_regionkey, sha256(string_agg(n_nationkey || ':' || n_name || ';', '' ORDER BY n_name)) AS digest FROM nation GROUP BY n_regionkey")
def ordered_digest_by_region(spark: SparkSession, d: str) -> DataFrame:
    chunk = F.encode(F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), "n_name", F.lit(";")), "UTF-8")
    return table(spark, d, "nation").groupBy("n_regionkey").agg(ordered_digest(F.col("n_name"), chunk).alias("digest"))


@query("""WITH a AS (SELECT o_orderkey AS name, md5(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey AS name, md5(CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END || o_orderpriority) AS h FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'EXTRA' WHEN b.name IS NULL THEN 'MISSING' WHEN a.h <> b.h THEN 'STALE' ELSE 'OK' END AS status FROM a FULL JOIN b ON a.name = b.name""")
def artifact_drift(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.artifacts import drift

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    want = o.where("o_orderpriority <> '5-LOW'").select("name", F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("sha256"))
    have = o.where("o_orderpriority <> '1-URGENT'").select("name", F.md5(F.concat(F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority")).alias("sha256"))
    return drift(want, have)


@query("SELECT 'duplicate_key' AS rule, CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS locus FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 1) x")
def first_violation(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.rules import Rule, first, violation

    rules = [
        Rule("unknown_part", lambda t: violation(not_in(t["lineitem"], {"l_partkey": "p_partkey"}, t["part"]), F.lpad(F.col("l_orderkey").cast("string"), 20, "0"), F.col("l_linenumber"), "part is unknown")),
        Rule("duplicate_key", lambda t: violation(graph.repeated(t["lineitem"], "l_orderkey", "l_linenumber"), F.lpad(F.col("l_orderkey").cast("string"), 20, "0"), F.col("l_linenumber"), "line item is repeated")),
    ]
    found = first(rules, {"lineitem": table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "part": table(spark, d, "part").select("p_partkey")})
    return found.select(F.col("rule_id").alias("rule"), F.concat(F.col("path").cast("bigint").cast("string"), F.lit(":"), "locus").alias("locus"))


# ---- suites, reviewers, citations, audits


@query("""SELECT b.item_id, CAST(count(d.doc_id) AS BIGINT) AS documents FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0 GROUP BY b.item_id""")
def leaked_passages(spark: SparkSession, d: str) -> DataFrame:
    """Suite passages that stand whole in documents."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return passage_counts(table(spark, d, "documents"), items)


@query("""WITH asked AS (SELECT o_orderkey AS case_id, l_partkey AS claim_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), lack AS (SELECT DISTINCT case_id, claim_id FROM asked WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = claim_id AND p_size > 3))
SELECT o_orderkey AS case_id, coalesce(m.missing, '') AS missing, CASE WHEN m.missing IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM orders LEFT JOIN (SELECT case_id, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY CAST(claim_id AS VARCHAR)) AS missing FROM lack GROUP BY 1) m ON m.case_id = o_orderkey""")
def case_missing_claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases that need their parts as claims; parts up to size 3 are no claims."""
    needs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("required_claim_ids"))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("ANSWER").alias("expected_disposition")).join(needs, "case_id", "left")
    claims = table(spark, d, "part").where("p_size > 3").select(F.col("p_partkey").cast("string").alias("claim_id"))
    return evaluate.regression(cases, claims).select("case_id", F.array_join("missing", ",").alias("missing"), "status")


@query("SELECT p_partkey AS id, 'missing' AS side FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def suite_coverage(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "lineitem").where("l_quantity >= 45").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    return evaluate.suite_coverage(cases, table(spark, d, "part").select(F.col("p_partkey").alias("id")), "ids")


@query("""SELECT CAST(count(*) AS BIGINT) AS responses, CAST(count(*) FILTER (WHERE o_orderstatus = ls) AS BIGINT) AS disposition_matches, CAST(count(*) FILTER (WHERE cited) AS BIGINT) AS provenance_matches, CAST(count(*) FILTER (WHERE o_orderstatus = ls AND o_orderstatus = 'F') AS BIGINT) AS boundary_abstentions
FROM orders JOIN (SELECT l_orderkey, min(l_linestatus) AS ls, bool_and(l_returnflag <> 'N' OR l_discount < 0.05) AS cited FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey""")
def run_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases that need their line items as claims; an item is cited unless it is neither returned nor sold below 5 % off."""
    disposition = lambda c: F.when(F.col(c) == "F", "ABSTAIN").otherwise(F.col(c))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount").alias("atom"), ((F.col("l_returnflag") != "N") | (F.col("l_discount") < 0.05)).alias("cited"))
    per = items.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min("l_linestatus").alias("status"), F.collect_list("atom").alias("used_relation_atom_ids"), F.collect_list(F.when(F.col("cited"), F.col("atom"))).alias("cited_source_ids"))
    responses = per.select("case_id", disposition("status").alias("disposition"), "used_relation_atom_ids", "cited_source_ids")
    cases = table(spark, d, "orders").join(per.select("case_id", "used_relation_atom_ids"), F.col("case_id") == F.col("o_orderkey"))
    cases = cases.select("case_id", disposition("o_orderstatus").alias("expected_disposition"), F.col("used_relation_atom_ids").alias("required_relation_atom_ids"))
    entry = F.array(F.struct(F.col("atom").alias("source_id"), F.lit("line").alias("locator"), F.lit("item").alias("evidence_type")))
    edges = items.select(F.concat(F.lit('{"source_atom_id":"'), "atom", F.lit('"}')).alias("qualifiers"), entry.alias("evidence"))
    return evaluate.score_run(responses, cases, edges)


@query("SELECT d.doc_id, l.quality IS NOT NULL AS reviewed, coalesce(l.quality = 1 AND l.toxic = 0 AND d.lang IN ('en', 'de') AND d.n_chars >= 100, FALSE) AS eligible FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def reviewer_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Labels as reviewers' records: toxic ones have an open disagreement, short texts lack scores, other languages a conclusion."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    records = rows.select(
        "doc_id", F.col("quality").isNotNull().alias("reviewed"), F.when(F.col("quality") == 1, "COMPLETE").otherwise("IN_PROGRESS").alias("completion_status"), F.col("toxic").isNotNull().alias("all_required_case_scores_present"),
        F.when(F.col("lang").isin("en", "de"), "PASS").otherwise("PENDING").alias("top_level_conclusion"), F.lit("RECOMMEND_RELEASE").alias("release_recommendation"), F.col("n_chars").isNotNull().alias("metadata_valid"),
        F.when(F.col("n_chars") < 100, F.array(F.lit(integrity.BARRED_DEFECTS[0]))).alias("defects"), F.when(F.col("toxic") == 1, F.struct(F.lit(integrity.OPEN_DISAGREEMENTS[0]).alias("status"))).alias("critical_disagreement"),
    )
    return records.select("doc_id", "reviewed", integrity.eligible().alias("eligible"))


@query("SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS all_true, bool_or(o_totalprice > 300000) AS any_true FROM orders GROUP BY o_custkey")
def all_true_gate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    failed = integrity.all_true(o.select(F.col("o_custkey").alias("name"), (F.col("o_orderstatus") != "P").alias("value"))).distinct()
    per = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("any_true"))
    return per.join(failed, F.col("name") == F.col("o_custkey"), "left").select("o_custkey", F.col("name").isNull().alias("all_true"), "any_true")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem c WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_returnflag = 'A' AND e.l_partkey = c.l_partkey AND e.l_suppkey = c.l_suppkey AND e.l_linenumber = c.l_linenumber)""")
def composite_citation_support(spark: SparkSession, d: str) -> DataFrame:
    """Returned items as citations, accepted ones as evidence; support needs claim, source and locator."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    keys = ["l_partkey", "l_suppkey", "l_linenumber"]
    return not_in(items.where("l_returnflag = 'R'"), {k: k for k in keys}, items.where("l_returnflag = 'A'")).select("l_orderkey", *keys)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')")
def uncited_claims(spark: SparkSession, d: str) -> DataFrame:
    return not_in(table(spark, d, "orders").select("o_orderkey"), {"o_orderkey": "l_orderkey"}, table(spark, d, "lineitem").where("l_returnflag <> 'N'"))


@query("""WITH q AS (SELECT conv_id, turn, md5(text) AS h FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, q.h AS request_hash, CASE WHEN q.h IS NULL THEN 'request missing' WHEN a.n < 20 THEN 'answer short' ELSE 'bound' END AS state FROM a LEFT JOIN q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1""")
def audit_binding(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn as the audit of an answer to the turn before it; a short answer has no citation for its claim."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    requests = c.where("role = 'user'").select(turn_id().alias("request_id"), F.md5(F.encode("text", "UTF-8")).alias("sha256"), F.lit("1").alias("schema_version"))
    none = F.array().cast("array<string>")
    claim = F.array(turn_id())
    answers = c.where("role = 'assistant'").withColumn("request_id", F.concat_ws(":", "conv_id", F.col("turn") - 1)).join(requests.select("request_id", F.col("sha256").alias("request_hash")), "request_id", "left")
    audits = answers.select(
        "conv_id", "turn", "request_hash", turn_id().alias("audit_id"), "request_id", F.col("request_hash").alias("request_sha256"), F.lit("1").alias("request_schema_version"), F.lit(None).cast("string").alias("response_sha256"), F.lit(True).alias("hash_verified"),
        F.lit("b").alias("bundle_sha256"), claim.alias("candidate_claim_ids"), claim.alias("admitted_claim_ids"), F.lit("ANSWER").alias("disposition"), claim.alias("material_claim_ids"), none.alias("coverage_gaps"), F.lit("PASS").alias("result"), none.alias("hard_fail_codes"),
        F.when(F.length("text") < 20, 0).otherwise(1).alias("citation_count"),
    )
    nothing = spark.createDataFrame([], contract.RESPONSE).withColumn("sha256", F.lit(None).cast("string"))
    found = contract.audit_violations(audits.drop("conv_id", "turn", "request_hash"), requests, nothing, "1", answers.select(turn_id().alias("claim_id")))
    rules = found.groupBy("key").agg(F.collect_set("rule").alias("rules"))
    state = F.when(F.array_contains("rules", "request_known"), "request missing").when(F.array_contains("rules", "citations_cover"), "answer short").otherwise("bound")
    return audits.join(rules, F.col("key") == F.col("audit_id"), "left").select("conv_id", "turn", "request_hash", state.alias("state"))


@query("SELECT conv_id, bool_or(role = 'assistant') AS answered, CASE WHEN NOT bool_or(role = 'assistant') THEN 'ABSTAIN' WHEN bool_or(role = 'system') THEN 'PARTIAL' ELSE 'ANSWER' END AS disposition FROM conversations GROUP BY conv_id")
def disposition_state(spark: SparkSession, d: str) -> DataFrame:
    has = lambda r: F.bool_or(F.col("role") == r)
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(has("assistant").alias("answered"), has("system").alias("_s"))
    return rows.select("conv_id", "answered", evaluate.disposition_of(F.col("answered"), F.col("_s")).alias("disposition"))


@query("""SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS relations, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS sources FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus = 'F' AND l_linestatus = 'F' GROUP BY n_name""")
def reviewed_evidence_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: reviewed evidence through orders and customers to nations."""
    items = table(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    # counts by nation and source first: the distinct count then reads a small table
    pairs = rows.groupBy("n_name", "l_suppkey").agg(F.count("*").alias("c"))
    return pairs.groupBy(F.col("n_name").alias("nation")).agg(F.sum("c").alias("relations"), F.count("*").alias("sources"))


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS points, CAST(count(*) AS BIGINT) AS criteria FROM lineitem GROUP BY l_orderkey")
def rubric_points(spark: SparkSession, d: str) -> DataFrame:
    points = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    return evaluate.rubric_totals(table(spark, d, "lineitem").select("l_orderkey", points.alias("points")), "l_orderkey").withColumnRenamed("total", "points")


@query("SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS variants, CAST(count(*) AS BIGINT) AS runs, count(DISTINCT event_type) = 1 AND count(*) >= 3 AS stable FROM events GROUP BY user_id")
def stable_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("run"), F.col("event_type").alias("response_sha256"))
    return evaluate.stable_runs(runs, or_more=True).withColumnRenamed("request_id", "user_id")


@query(f"WITH {WITH_RELATIONS} SELECT object AS subject, CASE predicate WHEN 'in_nation' THEN 'has_member' WHEN 'in_region' THEN 'has_nation' ELSE 'placed' END AS label, subject AS object FROM r")
def inverse_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([("in_nation", "has_member"), ("in_region", "has_nation"), ("placed_by", "placed")], "predicate string, inverse_label_zh string")
    return integrity.inverse_labels(relations(spark, d), labels)


@query("SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING min(l_linestatus) = 'F' AND max(l_linestatus) = 'F' AND bool_and(l_returnflag = 'R')")
def background_only(spark: SparkSession, d: str) -> DataFrame:
    rows = integrity.background_only(contains(spark, d), "R")
    return rows.select(F.substring_index("subject", ".", -1).cast("bigint").alias("l_orderkey"), F.substring_index("object", ".", -1).cast("bigint").alias("l_partkey"))


@query("SELECT s_suppkey AS source_id, CAST(count(*) AS BIGINT) AS cited, CAST(min(l_linenumber) AS INTEGER) AS first_locator FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal >= 0 GROUP BY 1")
def source_use(spark: SparkSession, d: str) -> DataFrame:
    registered = supplier_registry(spark, d).where("s_acctbal >= 0").select("source_id")
    used = corpus.used_sources(line_edges(spark, d)).join(registered, "source_id")
    return used.select(F.substring_index("source_id", ".", -1).cast("bigint").alias("source_id"), "cited", F.array_min("locators").cast("int").alias("first_locator"))


# ---- over a document folder made of the tables


@query("""SELECT 'nation.k' || n_nationkey AS subject, 'in_region' AS predicate, 'region.k' || n_regionkey AS object, 'reviewed' AS relation_status, 'A-nation-' || n_nationkey AS source_atom_id, 'source.tables' AS evidence_source_ids,
CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS INTEGER) AS nodes FROM nation""")
def document_build(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations written as structured Markdown, read back, validated and built into triples."""
    from factloom.plans.documents import build_from_tables

    return build_from_tables(spark, d)


from factloom.plans import checks, gate_checks, ranges, trees  # noqa: E402, F401  their queries register themselves
