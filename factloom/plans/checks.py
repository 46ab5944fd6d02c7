"""Queries that run sources, sinks, rule sets and contract checks over data made of the tables, with defects planted by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import json_schema
from factloom.functions import text as X
from factloom.functions.canonical import blob_sha1, file_sha256
from factloom.operators import artifacts, contract, corpus, evaluate, gates, graph, integrity, knowledge_rules, rules
from factloom.operators.model import EVIDENCE
from factloom.plans import documents
from factloom.plans.queries import query
from factloom.plans.tables import conversation_answers, ident, line_edges, relations, supplier_registry, turn_id
from factloom.session import materialize, scratch_path, table
from factloom.sources import documents as sources


def nothing() -> Column:
    return F.lit(None).cast("string")


def tallied(findings: DataFrame) -> DataFrame:
    """(rule_id, path, locus, n) of findings."""
    return findings.groupBy("rule_id", "path", "locus").agg(F.count("*").alias("n"))


def chosen(*cases: tuple[Column, object], default: Column) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


# ---- sources and sinks

#: The documents that documents.write_documents makes, as SQL.
WITH_DOCS = """doc AS (
  SELECT 'regions/r' || r_regionkey || '.md' AS path, 'region' AS kind, r_regionkey AS k, r_name AS name, '[]' AS rel FROM region
  UNION ALL SELECT 'nations/n' || n_nationkey || '.md', 'nation', n_nationkey, n_name,
    '[{predicate: in_region, object: region.k' || n_regionkey || ', statement_zh: "' || n_name || ' lies there", relation_status: reviewed, evidence: [{source_id: source.tables, locator: nation, evidence_type: direct_statement}], qualifiers: {source_atom_id: A-nation-' || n_nationkey || '}}]'
  FROM nation
), txt AS (
  SELECT *, concat_ws(chr(10), '---', 'schema_version: "1"', 'id: ' || kind || '.k' || k, 'entity_type: ' || kind, 'name_zh: "' || name || '"', 'name_en: "' || name || '"', 'scientific_name: null', 'aliases: []', 'one_health_domains: [trade]',
    'summary: "' || name || ' is a ' || kind || '"', 'review_status: reviewed', 'admission: {batch_id: B1, source_ledger: tables, atom_ids: [A-' || kind || '-' || k || ']}', 'relations: ' || rel,
    'review: {reviewed_by: table, last_reviewed: ''2020-01-01''}', '---', '## Summary', '', '## Evidence', '', 'text', '') AS t
  FROM doc
)"""


def _folder(spark: SparkSession, d: str) -> str:
    folder = scratch_path(spark, "documents")
    documents.write_documents(spark, d, folder)
    return folder


@query(f"WITH {WITH_DOCS} SELECT path, split_part(path, '/', 2) AS name, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256, sha1('blob ' || strlen(t) || chr(0) || t) AS blob_id, CAST(2 AS INTEGER) AS depth, t AS text FROM txt")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, d)
    found = sources.files(spark, folder, "*.md").join(sources.read_texts(spark, folder, "*.md"), "path")
    return found.select("path", "name", "bytes", file_sha256(F.col("content")).alias("sha256"), blob_sha1(F.col("content")).alias("blob_id"), F.size("parts").alias("depth"), "text")


@query(f"WITH {WITH_DOCS} SELECT split_part(path, '/', 2) AS name, kind || '.k' || k AS id FROM txt WHERE kind = 'nation'")
def flat_scan(spark: SparkSession, d: str) -> DataFrame:
    """One folder without those below it, and its names as a set."""
    folder = _folder(spark, d) + "/nations"
    found = sources.read_extensions(spark, folder)
    return found.join(sources.names_in(spark, folder), "name", "left_semi").select("name", F.get_json_object("meta", "$.id").alias("id"))


@query(f"WITH {WITH_DOCS} SELECT sha256(string_agg(path || chr(0) || t || chr(0), '' ORDER BY path)) AS digest FROM txt")
def input_digest(spark: SparkSession, d: str) -> DataFrame:
    return graph.batch_digest(sources.read_documents(spark, _folder(spark, d)))


@query(f"""WITH {WITH_DOCS}, n AS (
  SELECT kind || '.k' || k AS id, '{{"admission_batch_id":"B1","aliases":[],"entity_type":"' || kind || '","id":"' || kind || '.k' || k || '","name_en":"' || name || '","name_zh":"' || name || '","one_health_domains":["trade"],"review_status":"reviewed","scientific_name":null,"source_atom_ids":["A-' || kind || '-' || k || '"],"source_file":"' || path || '","summary":"' || name || ' is a ' || kind || '"}}' || chr(10) AS line FROM txt
), e AS (
  SELECT 'nation.k' || n_nationkey AS s, '{{"evidence":[{{"evidence_type":"direct_statement","locator":"nation","source_id":"source.tables"}}],"object":"region.k' || n_regionkey || '","predicate":"in_region","qualifiers":{{"source_atom_id":"A-nation-' || n_nationkey || '"}},"relation_status":"reviewed","source_file":"nations/n' || n_nationkey || '.md","statement_zh":"' || n_name || ' lies there","subject":"nation.k' || n_nationkey || '"}}' || chr(10) AS line,
    'nation.k' || n_nationkey || ',in_region,region.k' || n_regionkey || ',reviewed,A-nation-' || n_nationkey || ',source.tables' || chr(10) AS csv FROM nation
), a AS (
  SELECT 'nodes.jsonl' AS name, string_agg(line, '' ORDER BY id) AS t FROM n UNION ALL SELECT 'edges.jsonl', string_agg(line, '' ORDER BY s) FROM e
  UNION ALL SELECT 'triples.csv', 'subject,predicate,object,relation_status,source_atom_id,evidence_source_ids' || chr(10) || string_agg(csv, '' ORDER BY s) FROM e
)
SELECT name, sha256(t) AS sha256, 'OK' AS status FROM a""")
def artifact_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The graph's files as written, and what the check says about them; the manifest names the others' hashes."""
    built = graph.build(sources.read_documents(spark, _folder(spark, d)), "B1")
    files = artifacts.graph_artifacts(built, {"title": "tables"}, {"public": True})
    folder = scratch_path(spark, "artifacts")
    artifacts.write(spark, folder, files)
    kept = artifacts.stored(spark, folder)
    return kept.join(artifacts.drift(artifacts.digests(spark, files), kept), "name").where("name <> 'manifest.yml'")


@query("SELECT 'n' || n_nationkey AS subject, 'named' AS predicate, n_name || ', \"' || n_regionkey || '\"' AS object, 'reviewed' AS relation_status, 'A' || n_nationkey AS source_atom_id, 's' AS evidence_source_ids FROM nation")
def triples_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Triples written as CSV with quotes where needed, and read back."""
    key = F.col("n_nationkey").cast("string")
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), key).alias("subject"), F.lit("named").alias("predicate"), F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("object"), F.lit("reviewed").alias("relation_status"), F.concat(F.lit("A"), key).alias("source_atom_id"), F.lit("s").alias("evidence_source_ids"))
    folder = scratch_path(spark, "triples")
    artifacts.write(spark, folder, {"triples.csv": artifacts.triples_csv(rows, ["subject", "source_atom_id"])})
    return sources.read_triples(spark, f"{folder}/triples.csv")


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) * 2 - 1 AS INTEGER) AS line, CASE WHEN n_regionkey = 0 THEN NULL ELSE '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' END AS record, CASE WHEN n_regionkey = 0 THEN 'n.jsonl:' || (row_number() OVER (ORDER BY n_nationkey) * 2 - 1) || ': line is not an object' END AS parse_error FROM nation""")
def json_lines_read(spark: SparkSession, d: str) -> DataFrame:
    """Objects with their keys in another order, blank lines between, and lists where there should be objects."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    lines = [f'[{r.n_nationkey}]' if r.n_regionkey == 0 else f'{{"name": "{r.n_name}", "key": {r.n_nationkey}}}' for r in rows]
    folder = scratch_path(spark, "lines")
    artifacts.write(spark, folder, {"n.jsonl": "\r\n\r\n".join(lines).encode()})
    return sources.read_json_lines(spark, folder).select(F.col("line").cast("int").alias("line"), "record", "parse_error")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 400000 THEN 'o' || o_orderkey END AS id, CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 400000 THEN 'body ' || o_orderkey || chr(10) END AS body,
CASE WHEN o_totalprice > 400000 THEN 'front matter is not a mapping' WHEN o_orderstatus = 'O' THEN 'front matter does not start the document' WHEN o_orderstatus <> 'F' THEN 'front matter is not terminated' END AS parse_error FROM orders""")
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as texts with metadata, some with CRLF, without opening, without end or with a list for metadata."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    good = F.concat(F.lit("---\nid: o"), key, F.lit("\nlist: [1, 2.0]\n---\nbody "), key, F.lit("\n"))
    text = chosen((F.col("o_totalprice") > 400000, F.lit("---\n- a\n---\nbody")), (F.col("o_orderstatus") == "O", F.lit("id: x\n---\n")), (F.col("o_orderstatus") != "F", F.lit("---\nid: x\n")), default=F.when(F.col("o_orderpriority") == "1-URGENT", F.replace(good, F.lit("\n"), F.lit("\r\n"))).otherwise(good))
    found = sources.parse_texts(o.select("o_orderkey", text.alias("text")))
    return found.select("o_orderkey", F.get_json_object("meta", "$.id").alias("id"), "body", "parse_error")


@query("SELECT sha256('# Parts' || string_agg(chr(10) || chr(10) || '## ' || 'part.' || p_partkey || chr(10) || chr(10) || '<!-- ' || p_brand || ' -->' || chr(10) || chr(10) || p_name, '' ORDER BY 'part.' || p_partkey) || chr(10)) AS corpus_sha256, TRUE AS clean FROM part")
def corpus_document(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of all parts, and whether no word of a later batch stands in it."""
    docs = table(spark, d, "part").select(ident("part", "p_partkey").alias("id"), F.col("p_brand").alias("path"), F.concat("p_name", F.lit(" \n\t　")).alias("body"))
    text = corpus.corpus_text(docs, "# Parts")
    found = corpus.leaked(text, spark.createDataFrame([("later-batch",), ("A-999",)], "token string")).count()
    return text.select(F.sha2(F.encode("corpus", "UTF-8"), 256).alias("corpus_sha256"), F.lit(found == 0).alias("clean"))


# ---- rules over registries and documents


@query("""WITH s AS (
  SELECT s_nationkey AS k, s_acctbal AS b, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS place, 'source.n' || s_nationkey || '_' || CAST(floor(s_acctbal / 100) + 20 AS BIGINT) AS id, 'r' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '.yml' AS path FROM supplier WHERE s_nationkey <> 7
), x AS (
  SELECT *, CASE WHEN b > 9000 THEN 'V2' WHEN b < -500 THEN 'V3' WHEN b < 0 THEN 'V4' END AS main FROM s
), f AS (
  SELECT 'V2' AS rule_id, path, 'sources[' || place || ']' AS locus FROM x WHERE main = 'V2' UNION ALL SELECT 'V3', path, 'sources[' || place || ']' FROM x WHERE main = 'V3'
  UNION ALL SELECT 'V4', path, 'sources[' || place || '].source_id' FROM x WHERE main = 'V4'
  UNION ALL SELECT 'V5', path, 'sources[' || place || '].source_type' FROM x WHERE k IN (1, 2) AND (main IS NULL OR main = 'V4') UNION ALL SELECT 'V6', path, 'sources[' || place || '].roles' FROM x WHERE k = 3 AND (main IS NULL OR main = 'V4')
  UNION ALL SELECT 'V7', path, 'sources[' || place || '].access_level' FROM x WHERE k = 4 AND (main IS NULL OR main = 'V4') UNION ALL SELECT 'V8', path, 'sources[' || place || '].full_text_status' FROM x WHERE k = 5 AND (main IS NULL OR main = 'V4')
  UNION ALL SELECT 'V4', path, 'sources[' || place || ']' FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path, place) AS nth FROM x WHERE main IS NULL) y WHERE nth > 1
  UNION ALL SELECT DISTINCT 'V1', 'r07.yml', '' FROM supplier WHERE s_nationkey = 7
)
SELECT rule_id, path, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3""")
def registry_findings(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as registered sources, one registry for each nation, with a defect of each kind."""
    v = knowledge_rules.Vocabulary(source_types=["paper"], source_roles=["primary"], access_levels=["open"], full_text_statuses=["full"])
    s, k, b = table(spark, d, "supplier"), F.col("s_nationkey"), F.col("s_acctbal")
    name = F.when(b < 0, F.lit("bad id")).otherwise(F.concat(F.lit("source.n"), k.cast("string"), F.lit("_"), (F.floor(b / 100) + 20).cast("string")))
    pick = lambda bad, good, *keys: F.when(k.isin(*keys), bad).otherwise(good)
    fields = [name.alias("source_id"), pick("film", "paper", 1, 2).alias("source_type"), F.array(pick("other", "primary", 3)).alias("roles"), pick("shut", "open", 4).alias("access_level"), pick("none", "full", 5).alias("full_text_status")]
    whole = F.to_json(F.struct(*fields, F.lit("t").alias("title")))
    entry = chosen((b > 9000, F.lit('"text"')), (b < -500, F.to_json(F.struct(*fields))), default=whole)
    rows = s.select("s_nationkey", F.struct("s_suppkey", entry.alias("e")).alias("x")).groupBy("s_nationkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    listed = F.concat(F.lit('{"sources":['), F.array_join(F.transform("xs", lambda x: x["e"]), ","), F.lit("]}"))
    path = F.concat(F.lit("r"), F.lpad(k.cast("string"), 2, "0"), F.lit(".yml"))
    registry = rows.select(path.alias("path"), F.when(k == 7, '{"sources":{}}').otherwise(listed).alias("meta"), nothing().alias("parse_error"))
    return tallied(knowledge_rules.check_registry(registry, v)[0])


WITH_CUSTOMERS = "c AS (SELECT c_custkey AS id, CAST(floor(c_acctbal / 500) AS BIGINT) AS k, 'c/' || c_custkey || '.md' AS path FROM customer)"


@query(f"""WITH {WITH_CUSTOMERS}, f AS (
  SELECT 'V11' AS rule_id, path, '' AS locus FROM c WHERE k = -2 UNION ALL SELECT 'V12', path, 'entity_type' FROM c WHERE k = -1 UNION ALL SELECT 'V13', path, 'id' FROM c WHERE k IN (0, 1)
  UNION ALL SELECT 'V14', path, 'name_zh' FROM c WHERE k = 2 UNION ALL SELECT 'V15', path, 'one_health_domains' FROM c WHERE k = 3 UNION ALL SELECT 'V16', path, 'review_status' FROM c WHERE k = 4 UNION ALL SELECT 'V17', path, '## Evidence' FROM c WHERE k = 5
  UNION ALL SELECT 'V18', path, 'relations' FROM c WHERE k = 6 UNION ALL SELECT 'V18', path, 'relations[0]' FROM c WHERE k = 7 UNION ALL SELECT 'V19', path, 'relations[0]' FROM c WHERE k = 8
  UNION ALL SELECT 'V20', path, 'relations[0]' FROM c, (VALUES (1), (2)) t(i) WHERE k = 9 UNION ALL SELECT 'V20', path, 'relations[0]' FROM c WHERE k = 10 UNION ALL SELECT 'V21', path, 'relations[0].evidence[0]' FROM c, (VALUES (1), (2)) t(i) WHERE k = 11
  UNION ALL SELECT 'V22', path, 'relations[0]' FROM c WHERE k IN (12, 13) UNION ALL SELECT 'V19', path, 'relations[1]' FROM c WHERE k = 14
  UNION ALL SELECT 'V10', path, 'id' FROM (SELECT path, row_number() OVER (ORDER BY id || '.md') AS nth FROM c WHERE k = 15) x WHERE nth > 1
  UNION ALL SELECT 'V9', path, '' FROM c WHERE k = 16
)
SELECT rule_id, path, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3""")
def document_findings(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entity documents, each band of balances with a defect of another kind; nations are the objects."""
    v = knowledge_rules.Vocabulary(
        id_prefix={"nation": "nation", "customer": "customer"}, domains=["trade"], review_statuses=["reviewed"], subject_types={"in_nation": ["customer"]}, object_types={"in_nation": ["nation"]}, relation_statuses=["reviewed"],
        evidence_types=["direct_statement"], headings=["## Summary", "## Evidence"],
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.floor(F.col("c_acctbal") / 500).alias("k"), F.col("c_nationkey").cast("string").alias("nation"), "c_name")
    k, at = F.col("k"), lambda *ks: F.col("k").isin(*ks)
    item = F.struct(F.when(at(11), "source.none").otherwise("source.tables").alias("source_id"), F.when(at(11), "　").otherwise("1").alias("locator"), F.lit("direct_statement").alias("evidence_type"))
    target = chosen((at(12), F.lit("nation.n99")), (at(13), F.concat(F.lit("customer.c"), "id")), default=F.concat(F.lit("nation.n"), "nation"))
    relation = F.to_json(F.struct(
        F.when(at(8), "eats").otherwise("in_nation").alias("predicate"), target.alias("object"), F.when(at(9), " ").otherwise("lies there").alias("statement_zh"), F.when(at(9), "x").otherwise("reviewed").alias("relation_status"),
        F.when(at(10), F.array().cast(f"array<{EVIDENCE.simpleString()}>")).otherwise(F.array(item)).alias("evidence"), F.create_map(F.lit("a"), F.lit("b")).alias("qualifiers"),
    ))
    listed = chosen((at(6), F.lit("null")), (at(7), F.lit('["x"]')), (at(14), F.concat(F.lit("["), relation, F.lit(","), relation, F.lit("]"))), default=F.concat(F.lit("["), relation, F.lit("]")))
    name = chosen((at(0), F.concat(F.lit("Customer "), "id")), (at(1), F.concat(F.lit("nation.x"), "id")), (at(15), F.lit("customer.twin")), default=F.concat(F.lit("customer.c"), "id"))
    head = F.to_json(F.struct(
        F.lit("1").alias("schema_version"), name.alias("id"), F.when(at(-1), "virus").otherwise("customer").alias("entity_type"), F.when(at(2), "　").otherwise(F.col("c_name")).alias("name_zh"), F.array().cast("array<string>").alias("aliases"),
        F.array(F.when(at(3), "moon").otherwise("trade")).alias("one_health_domains"), F.when(at(-2), nothing()).otherwise("s").alias("summary"), F.when(at(4), "done").otherwise("reviewed").alias("review_status"), F.create_map(F.lit("a"), F.lit("b")).alias("review"),
    ))
    meta = F.concat(F.substring(head, 1, 1_000_000).substr(F.lit(1), F.length(head) - 1), F.lit(',"relations":'), listed, F.lit("}"))
    path = F.concat(F.lit("c/"), "id", F.lit(".md"))
    body = F.when(at(5), "## Summary").otherwise("## Summary\n## Evidence")
    broken = F.when(k == 16, "front matter is not terminated")
    docs = c.select(path.alias("path"), F.array(F.lit("c"), F.concat("id", F.lit(".md"))).alias("parts"), F.when(broken.isNull(), meta).alias("meta"), F.when(broken.isNull(), body).alias("body"), broken.alias("parse_error"))
    plain = F.to_json(F.struct(
        F.lit("1").alias("schema_version"), F.concat(F.lit("nation.n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("name_zh"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("trade")).alias("one_health_domains"),
        F.lit("s").alias("summary"), F.lit("reviewed").alias("review_status"), F.array().cast("array<string>").alias("relations"), F.create_map(F.lit("a"), F.lit("b")).alias("review"),
    ))
    there = F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(".md"))
    nations = table(spark, d, "nation").select(there.alias("path"), F.split(there, "/").alias("parts"), plain.alias("meta"), F.lit("## Summary\n## Evidence").alias("body"), nothing().alias("parse_error"))
    return tallied(knowledge_rules.check_documents(docs.unionByName(nations), v, spark.createDataFrame([("source.tables",)], "source_id string")))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS k, s_suppkey || '.md' AS path FROM supplier), f AS (
  SELECT path, 'extension_id' AS locus FROM s WHERE k = 1 UNION ALL SELECT path, 'review_status' FROM s WHERE k = 2 UNION ALL SELECT path, 'admission' FROM s WHERE k = 3 UNION ALL SELECT path, 'review' FROM s WHERE k IN (4, 5)
  UNION ALL SELECT path, 'extends_entity' FROM s WHERE k = 6 UNION ALL SELECT path, 'relations' FROM s WHERE k = 7 UNION ALL SELECT path, 'relations[0]' FROM s WHERE k IN (8, 9, 10) UNION ALL SELECT path, '' FROM s WHERE k = 11
  UNION ALL SELECT path, 'extension_id' FROM (SELECT path, row_number() OVER (ORDER BY path) AS nth FROM s WHERE k = 12) x WHERE nth > 1
)
SELECT 'V23' AS rule_id, path, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3""")
def extension_findings(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as extension documents; the suppliers of some nations have a defect."""
    v = knowledge_rules.Vocabulary(id_prefix={"nation": "nation", "supplier": "supplier"}, subject_types={"in_nation": ["supplier"]}, object_types={"in_nation": ["nation"]}, relation_statuses=["reviewed", "draft"], evidence_types=["direct_statement"])
    at = lambda *ks: F.col("s_nationkey").isin(*ks)
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    name = chosen((at(1), F.concat(F.lit("supplement."), key)), (at(12), F.lit("extension.twin")), default=F.concat(F.lit("extension."), key))
    item = F.array(F.struct(F.lit("source.tables").alias("source_id"), F.lit("1").alias("locator"), F.lit("direct_statement").alias("evidence_type")))
    atom = F.struct(F.when(at(10), "A-none").otherwise(F.concat(F.lit("A-"), key)).alias("source_atom_id"))
    relation = F.struct(F.when(at(8), "eats").otherwise("in_nation").alias("predicate"), F.concat(F.lit("nation.n"), nation).alias("object"), F.lit("lies there").alias("statement_zh"), F.when(at(9), "draft").otherwise("reviewed").alias("relation_status"), item.alias("evidence"), atom.alias("qualifiers"))
    review = F.struct(F.when(at(4), "someone").otherwise("course_lead").alias("reviewed_by"), F.when(at(5), nothing()).otherwise("2020").alias("last_reviewed"))
    meta = F.to_json(F.struct(
        F.lit("1").alias("schema_version"), name.alias("extension_id"), F.when(at(6), F.lit("supplier.none")).otherwise(F.concat(F.lit("supplier.s"), key)).alias("extends_entity"), F.when(at(2), "draft").otherwise("reviewed").alias("review_status"),
        F.struct(F.when(at(3), "B1").otherwise("B2").alias("batch_id"), F.array(F.concat(F.lit("A-"), key)).alias("atom_ids")).alias("admission"), F.when(at(7), F.filter(F.array(relation), lambda r: F.lit(False))).otherwise(F.array(relation)).alias("relations"), F.when(~at(11), review).alias("review"),
    ))
    s = table(spark, d, "supplier")
    docs = s.select(F.concat(key, F.lit(".md")).alias("path"), meta.alias("meta"), nothing().alias("parse_error"))
    nodes = s.select(F.concat(F.lit("supplier.s"), key).alias("id"), F.lit("supplier").alias("entity_type"))
    return tallied(knowledge_rules.check_extensions(docs, nodes, v, spark.createDataFrame([("source.tables",)], "source_id string"), "B2"))


@query("""WITH e AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), f AS (
  SELECT event_id, '/k' AS path, 'maximum' AS keyword FROM e WHERE k > 50 UNION ALL SELECT event_id, '/k', 'minimum' FROM e WHERE k < 3 UNION ALL SELECT event_id, '/type', 'enum' FROM e WHERE t = (SELECT max(event_type) FROM events)
)
SELECT event_id, string_agg(path || ' ' || keyword, ',' ORDER BY path, keyword) AS problems FROM f GROUP BY event_id""")
def schema_findings(spark: SparkSession, d: str) -> DataFrame:
    """Events against a schema: numbers from 3 to 50, and of every type but the last."""
    e = table(spark, d, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    schema = {"type": "object", "required": ["k", "type"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 3, "maximum": 50}, "type": {"enum": kinds[:-1]}}}
    record = F.concat(F.lit('{"type":"'), "event_type", F.lit('",'), F.substring("props", 2, 1_000_000))
    found = e.select("event_id", json_schema.schema_problems(record, schema).alias("p")).where("size(p) > 0")
    return found.select("event_id", F.array_join(F.transform("p", lambda x: F.concat(x["path"], F.lit(" "), x["keyword"])), ",").alias("problems"))


# ---- answers, audits, bundles


@query("""WITH u AS (SELECT *, length(text) < 20 AS brief FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text || CASE WHEN brief THEN chr(10) || 'brief' ELSE '' END WHEN role = 'user' THEN 'asked' ELSE 'told' END, chr(10) ORDER BY turn) AS rendered FROM u GROUP BY conv_id""")
def unit_rendering(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns are claims, brief ones with a notice; other turns are gaps with a text for each role."""
    turns = table(spark, d, "conversations")
    claims = turns.where("role = 'assistant'").select(turn_id().alias("claim_id"), F.col("text").alias("render_text"))
    notices = claims.where("length(render_text) < 20").select("claim_id", F.lit("brief").alias("notice"))
    gaps = turns.where("role <> 'assistant'").select(F.col("role").alias("gap_code")).distinct().withColumn("text", F.when(F.col("gap_code") == "user", "asked").otherwise("told"))
    answers = conversation_answers(turns, F.when(F.col("role") == "assistant", contract.CLAIM_UNIT).otherwise(contract.GAP_UNIT))
    told = contract.render_answers(answers, claims, gaps, notices)
    return told.select(F.col("request_id").cast("bigint").alias("conv_id"), "rendered")


#: Orders as answers: parts are claims, their first line items the citations; what is wrong goes by priority, status and balance.
WITH_ANSWERS = """l AS (
  SELECT l_orderkey AS o, l_partkey AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2
), a AS (
  SELECT l.o, l.p, l.s, o_orderpriority AS pr, o_orderstatus AS st, s_acctbal AS b FROM l JOIN orders ON o_orderkey = l.o JOIN supplier ON s_suppkey = l.s
), h AS (
  SELECT DISTINCT o, pr, st FROM a
)"""


@query(f"""WITH {WITH_ANSWERS}, f AS (
  SELECT o, 'claim_known' AS rule FROM a WHERE p > (SELECT max(p_partkey) * 0.9 FROM part) UNION ALL SELECT o, 'claim_entities' FROM a WHERE pr = '1-URGENT' AND p <= (SELECT max(p_partkey) * 0.9 FROM part) UNION ALL SELECT o, 'claim_qualifiers' FROM a WHERE pr = '2-HIGH'
  UNION ALL SELECT o, 'citation_label' FROM a WHERE b < 0 UNION ALL SELECT o, 'citation_evidence' FROM a WHERE pr = '3-MEDIUM' OR p > (SELECT max(p_partkey) * 0.9 FROM part) UNION ALL SELECT o, 'citation_visible' FROM a WHERE b > 9000
  UNION ALL SELECT o, 'units_gaps' FROM h WHERE st = 'O' UNION ALL SELECT o, 'answer_text' FROM h WHERE st = 'F' AND pr = '5-LOW' UNION ALL SELECT o, 'contract' FROM h WHERE st = 'P'
  UNION ALL SELECT o, 'knowledge_version' FROM h WHERE pr = '4-NOT SPECIFIED' UNION ALL SELECT o, 'request_known' FROM h JOIN orders ON o_orderkey = o WHERE o_totalprice > 300000
)
SELECT o AS o_orderkey, rule, CAST(count(*) AS BIGINT) AS n FROM f WHERE NOT (rule = 'knowledge_version' AND o IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)) GROUP BY 1, 2""")
def response_findings(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("s"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("st"), "o_totalprice")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), "s_name", "s_acctbal")
    # only narrow rows are dealt and stored; answers and claims are made of them where they are read
    item = F.struct("p", "s", "s_name", "s_acctbal")
    per = items.join(suppliers, "s").repartition("o").groupBy("o").agg(F.array_sort(F.collect_list(item)).alias("es")).join(orders, "o")
    per = materialize(per, "answers")  # each rule reads it
    rows = per.select("o", F.explode("es").alias("e")).select("o", "e.*")
    key, part, source = F.col("o").cast("string"), ident("part", "p"), ident("supplier", "s")
    place = lambda x: F.concat_ws("/", "o", "p", x)
    claim = F.concat_ws("/", key, part)  # a claim is of one order
    qualifiers = '{"n": 1.0, "a": "x"}'

    def each(make):
        """An array of what make gives for each part of the order: of its part, source, claim and places."""

        def one(x: Column, i: Column) -> Column:
            of = F.concat(F.lit("part."), x["p"].cast("string"))
            at = lambda y: F.concat_ws("/", F.col("o").cast("string"), x["p"].cast("string"), F.lit(y))
            return make(x, i, of, F.concat(F.lit("supplier."), x["s"].cast("string")), F.concat_ws("/", key, of), at)

        return F.transform("es", one)

    units = each(lambda x, i, part, source, claim, at: F.struct(i.cast("string").alias("unit_id"), F.lit(contract.CLAIM_UNIT).alias("unit_type"), claim.alias("claim_id"), F.array(at("c")).alias("citation_ids"), nothing().alias("gap_code")))
    made = each(lambda x, i, part, source, claim, at: F.struct(claim.alias("claim_id"), F.array(F.when(F.col("pr") == "1-URGENT", F.lit("other")).otherwise(source), part).alias("entity_ids"), F.when(F.col("pr") == "2-HIGH", "{}").otherwise('{"a":"x","n":1}').alias("qualifiers")))
    cites = each(
        lambda x, i, part, source, claim, at: F.struct(
            at("c").alias("citation_id"), claim.alias("claim_id"), source.alias("source_id"), F.when(x["s_acctbal"] < 0, "other").otherwise(x["s_name"]).alias("source_label"), F.when(F.col("pr") == "3-MEDIUM", "none").otherwise(at("x")).alias("locator"), (x["s_acctbal"] <= 9000).alias("visible_to_student"),
        )
    )
    text = F.array_join(each(lambda x, i, part, source, claim, at: F.concat(F.lit("text of "), claim)), "\n")
    gap = F.struct(F.lit("g").alias("gap_code"))
    none = F.filter(F.array(gap), lambda g: F.lit(False))
    responses = per.select(
        key.alias("request_id"), F.lit("k1").alias("knowledge_version"), units.alias("answer_units"), made.alias("material_claims"), cites.alias("citations"), F.when(F.col("st") == "O", F.array(gap)).otherwise(none).alias("coverage_gaps"),
        F.when((F.col("st") == "F") & (F.col("pr") == "5-LOW"), "wrong").otherwise(text).alias("answer_text"), F.struct(F.when(F.col("st") == "P", "L").otherwise("K").alias("checked_contract_id")).alias("validation"),
    )
    last = table(spark, d, "part").agg(F.max("p_partkey")).first()[0] or 0
    known = rows.where(F.col("p") <= 0.9 * last)
    proof = F.array(F.struct(source.alias("source_id"), place(F.lit("x")).alias("locator"), F.lit("item").alias("evidence_type")))
    claims = known.select(claim.alias("claim_id"), F.array(part, source).alias("entity_ids"), proof.alias("evidence"))
    told = rows.select(claim.alias("claim_id"), F.concat(F.lit("text of "), claim).alias("render_text"))
    required = rows.select(claim.alias("claim_id"), F.lit(qualifiers).alias("qualifiers"))
    asked = orders.where("o_totalprice <= 300000").select(key.alias("request_id"), F.when(F.col("pr") == "4-NOT SPECIFIED", "k2").otherwise("k1").alias("knowledge_version"))
    empty = lambda *names: spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    rendered = contract.render_answers(responses, told, empty("gap_code", "text"), empty("claim_id", "notice"))
    titles = suppliers.select(source.alias("source_id"), F.col("s_name").alias("title"))
    found = contract.response_violations(responses, asked, claims, titles, required, rendered, "K")
    return found.groupBy(F.col("key").cast("bigint").alias("o_orderkey"), "rule").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS pr, o_orderstatus AS st, c_acctbal AS b, o_totalprice AS t FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > -500), f AS (
  SELECT id, 'request_known' AS rule FROM a WHERE b IS NULL UNION ALL SELECT id, 'request_hash' FROM a WHERE b IS NOT NULL AND b < 0 UNION ALL SELECT id, 'admitted_subset' FROM a WHERE pr = '1-URGENT' UNION ALL SELECT id, 'decided_subset' FROM a WHERE pr = '2-HIGH'
  UNION ALL SELECT id, 'admitted_known' FROM a WHERE t > 300000 AND pr <> '2-HIGH' UNION ALL SELECT id, 'citations_cover' FROM a WHERE st = 'O' UNION ALL SELECT id, 'response_needed' FROM a WHERE pr = '3-MEDIUM' UNION ALL SELECT id, 'response_hash' FROM a WHERE pr = '4-NOT SPECIFIED'
  UNION ALL SELECT id, 'disposition' FROM a WHERE pr <> '3-MEDIUM' AND st = 'P' UNION ALL SELECT id, 'citations' FROM a WHERE pr <> '3-MEDIUM' AND st = 'O' UNION ALL SELECT id, 'unverified' FROM a WHERE b > 9000
  UNION ALL SELECT id, 'bundle' FROM a WHERE pr NOT IN ('3-MEDIUM') AND st = 'F' AND t < 20000
)
SELECT id AS o_orderkey, string_agg(rule, ',' ORDER BY rule) AS rules FROM f GROUP BY id""")
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as audits of an answer with one claim: what is wrong goes by priority, status, price and the customer's balance."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    key, claim = F.col("o_orderkey").cast("string"), F.concat(F.lit("claim-"), F.when(F.col("o_totalprice") > 300000, F.col("o_orderkey").cast("string")).otherwise("known"))
    none = F.array().cast("array<string>")
    priority, status, price, b = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice"), F.col("c_acctbal")
    audits = o.select(
        key.alias("audit_id"), key.alias("request_id"), F.when(b < 0, "x").otherwise("q").alias("request_sha256"), F.lit("1").alias("request_schema_version"), F.when(priority == "4-NOT SPECIFIED", "x").otherwise("a").alias("response_sha256"),
        F.coalesce(b <= 9000, F.lit(True)).alias("hash_verified"), F.when((status == "F") & (price < 20000), "x").otherwise("b").alias("bundle_sha256"), F.when(priority == "1-URGENT", none).otherwise(F.array(claim)).alias("candidate_claim_ids"),
        F.when(priority == "2-HIGH", none).otherwise(F.array(claim)).alias("admitted_claim_ids"), F.lit("ANSWER").alias("disposition"), F.array(claim).alias("material_claim_ids"), none.alias("coverage_gaps"), F.lit("PASS").alias("result"), none.alias("hard_fail_codes"),
        F.when(status == "O", 0).otherwise(1).alias("citation_count"),
    )
    requests = o.where("c_acctbal > -500").select(key.alias("request_id"), F.lit("q").alias("sha256"), F.lit("1").alias("schema_version"))
    cited = F.array(F.struct(F.lit(True).alias("visible_to_student")))
    gaps = F.filter(F.array(F.struct(F.lit("g").alias("gap_code"))), lambda g: F.lit(False))
    responses = o.where("o_orderpriority <> '3-MEDIUM'").select(
        key.alias("request_id"), F.lit("a").alias("sha256"), F.when(status == "P", "PARTIAL").otherwise("ANSWER").alias("disposition"), F.array(F.struct(claim.alias("claim_id"))).alias("material_claims"), gaps.alias("coverage_gaps"), cited.alias("citations"),
        F.lit("b").alias("runtime_bundle_sha256"), F.struct(F.lit("PASS").alias("result"), none.alias("hard_fail_codes")).alias("validation"),
    )
    found = contract.audit_violations(audits, requests, responses, "1", spark.createDataFrame([("claim-known",)], "claim_id string"))
    return found.groupBy(F.col("key").cast("bigint").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN source = 'src3' THEN 'file is missing' WHEN lang = 'fr' THEN 'size differs' WHEN lang = 'de' THEN 'sha256 differs' ELSE 'blob id differs' END AS problem FROM t WHERE source = 'src3' OR lang IN ('fr', 'de', 'es')
UNION ALL SELECT 'self', sha256('{"files":' || (SELECT count(*) FROM t) || ',"name":"bundle"}')""")
def bundle_findings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a bundle's files: those of a source are gone, those of three languages changed in another way each; and the manifest's own hash."""
    from factloom.functions.canonical import canonical_sha256

    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "lang", "source")
    files = rows.where("source IS NULL OR source <> 'src3'").select("path", F.octet_length("content").cast("bigint").alias("bytes"), "content")
    is_ = lambda x: F.coalesce(F.col("lang") == x, F.lit(False))
    manifest = rows.select("path", (F.octet_length("content") + is_("fr").cast("int")).cast("bigint").alias("size_bytes"), F.when(is_("de"), "x").otherwise(file_sha256(F.col("content"))).alias("sha256"), F.when(is_("es"), "x").otherwise(blob_sha1(F.col("content"))).alias("source_blob_sha1"))
    text = rows.agg(F.count("*").alias("n")).select(F.concat(F.lit('{"name": "bundle", "bundle_sha256": "x", "files": '), F.col("n").cast("string"), F.lit("}")).alias("t"))
    own = text.select(F.lit("self").alias("path"), canonical_sha256(F.col("t"), ("bundle_sha256",)).alias("problem"))
    return integrity.verify_bundle(manifest, files).unionByName(own)


# ---- gates


def gate(found: list[rules.Rule], tables: rules.Tables) -> DataFrame:
    """(rule_id, locus, n) of all findings of a gate."""
    return rules.accumulate(found, tables).groupBy("rule_id", "locus").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS b, p_size AS z FROM part), f AS (
  SELECT 'declared_count' AS rule_id, b AS locus FROM p WHERE b IN ('Brand#11', 'Brand#12') GROUP BY b
  UNION ALL SELECT 'partition', CAST(id AS VARCHAR) FROM p WHERE z > 45 OR z < 5
  UNION ALL SELECT 'batch_known', 'B9' UNION ALL SELECT 'documents_reviewed', CAST(id AS VARCHAR) FROM p WHERE z = 10 UNION ALL SELECT 'reviewer', CAST(id AS VARCHAR) FROM p WHERE z = 11
  UNION ALL SELECT 'entities', CAST(id AS VARCHAR) FROM p WHERE z IN (12, 13) UNION ALL SELECT 'batch_atoms', CAST(id AS VARCHAR) FROM p WHERE z = 14
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def admission_findings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as atoms classified by brand: some are in no class or in two, and the plan differs from what is there."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("class"), F.col("p_size").alias("z"))
    inside = p.where("z <= 45").unionByName(p.where("z < 5"))
    classes = p.select("class").distinct().join(inside.groupBy("class").agg(F.collect_list("id").alias("atom_ids")), "class", "left").withColumn("atom_ids", F.coalesce("atom_ids", F.array().cast("array<string>")))
    classes = classes.withColumn("count", F.size("atom_ids") + F.col("class").isin("Brand#11", "Brand#12").cast("int"))
    documents_ = p.select("id", F.when(F.col("z") == 10, "draft").otherwise("reviewed").alias("review_status"), F.when(F.col("z") == 11, " ").otherwise("r").alias("reviewed_by"))
    atoms = p.select(F.col("id").alias("atom_id"), "z")
    tables = {
        "atoms": atoms.select("atom_id"), "classes": classes, "batches": spark.createDataFrame([("B1",)], "batch_id string"), "documents": documents_, "planned_entities": p.where("z <> 12").select("id"), "implemented_entities": p.where("z <> 13").select("id"),
        "planned_atoms": atoms.select("atom_id"), "implemented_atoms": atoms.select("atom_id").unionByName(atoms.where("z = 14").select("atom_id")),
    }
    return gate(gates.admission("B9"), tables)


#: Orders as fixed cases with their customer as entity and their parts as claims.
WITH_CASES = """x AS (
  SELECT o_orderkey AS id, 'C-' || o_orderkey AS c, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS cust, o_totalprice AS t FROM orders
), w AS (
  SELECT DISTINCT 'C-' || l_orderkey AS c, l_partkey AS p FROM lineitem
)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(ident("part", "l_partkey")).alias("parts"))
    none = F.array().cast("array<string>")
    status = F.col("o_orderstatus")
    return o.join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.concat(F.lit("C-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderpriority").alias("category"), F.when(status == "F", "ANSWER").when(status == "P", "PARTIAL").otherwise("ABSTAIN").alias("expected_disposition"),
        F.when(status == "O", none).otherwise(F.array(ident("customer", "o_custkey"))).alias("required_entity_ids"), F.when(status == "O", none).otherwise(F.coalesce("parts", none)).alias("required_relation_atom_ids"),
        F.when((status != "F") & (F.col("o_totalprice") > 20000), "gap").alias("coverage_gap"), F.when(F.col("o_totalprice") > 30000, "each").alias("citation_requirement"), F.lit("high").alias("failure_severity"),
    )


@query(f"""WITH {WITH_CASES}, f AS (
  SELECT 'total' AS rule_id, CAST((SELECT count(*) FROM x) AS VARCHAR) AS locus
  UNION ALL SELECT 'case_pattern', c FROM x WHERE length(CAST(id AS VARCHAR)) > 3 UNION ALL SELECT 'dispositions', d FROM (VALUES ('ANSWER', 'F'), ('PARTIAL', 'P'), ('ABSTAIN', 'O')) v(d, s) WHERE (SELECT count(*) FROM x WHERE st = s) <> 100
  UNION ALL SELECT 'categories', pr FROM x GROUP BY pr HAVING pr <> '1-URGENT'
  UNION ALL SELECT 'contract', c FROM x WHERE (st IN ('P', 'O') AND t <= 20000) OR t <= 30000
  UNION ALL SELECT 'entities_known', c FROM x WHERE st <> 'O' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = cust AND c_acctbal >= 0)
  UNION ALL SELECT DISTINCT 'atoms_known', x.c FROM x JOIN w ON w.c = x.c JOIN part ON p_partkey = w.p WHERE st <> 'O' AND p_size <= 3
  UNION ALL SELECT 'later_batches', x.c FROM x JOIN w ON w.c = x.c JOIN part ON p_partkey = w.p WHERE st <> 'O' AND p_size = 50
  UNION ALL SELECT 'sources', 'supplier.' || l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0
  UNION ALL SELECT 'entities_covered', 'customer.' || c_custkey FROM customer WHERE c_acctbal >= 0 AND NOT EXISTS (SELECT 1 FROM x WHERE cust = c_custkey AND st <> 'O')
  UNION ALL SELECT 'entities_covered', 'customer.' || cust FROM (SELECT DISTINCT cust FROM x WHERE st <> 'O') y WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = cust AND c_acctbal >= 0)
  UNION ALL SELECT 'atoms_covered', 'part.' || p_partkey FROM part WHERE p_size > 3 AND NOT EXISTS (SELECT 1 FROM x JOIN w ON w.c = x.c WHERE st <> 'O' AND w.p = p_partkey)
  UNION ALL SELECT 'atoms_covered', 'part.' || p_partkey FROM part WHERE p_size <= 3 AND EXISTS (SELECT 1 FROM x JOIN w ON w.c = x.c WHERE st <> 'O' AND w.p = p_partkey)
  UNION ALL SELECT 'rubric', '10' UNION ALL SELECT 'private_paths', CAST(doc_id AS VARCHAR) FROM documents WHERE regexp_matches(text, '(?i)mit license')
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def protocol_findings(spark: SparkSession, d: str) -> DataFrame:
    people, parts = table(spark, d, "customer").where("c_acctbal >= 0"), table(spark, d, "part")
    priorities = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"))
    tables = {
        "cases": _cases(spark, d), "dispositions": spark.createDataFrame([(x, 100) for x in ("ANSWER", "PARTIAL", "ABSTAIN")], "key string, want bigint"), "categories": priorities.select("key", F.when(F.col("key") == "1-URGENT", F.col("n")).otherwise(0).alias("want")),
        "entities": people.select(ident("customer", "c_custkey").alias("id")), "atoms": parts.where("p_size > 3").select(ident("part", "p_partkey").alias("id")), "later": parts.where("p_size = 50").select(ident("part", "p_partkey").alias("atom_id")), "edges": line_edges(spark, d),
        "registry": supplier_registry(spark, d).where("s_acctbal >= 0"), "rubric": spark.createDataFrame([("a", 4), ("b", 6)], "criterion string, points int"), "texts": table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"),
    }
    return gate(gates.protocol(-1, r"C-\d{1,3}", 9, {"license": "mit license"}), tables)


@query(f"""WITH {WITH_CASES}, f AS (
  SELECT 'run_state' AS rule_id, 'R1' AS locus UNION ALL SELECT 'suite', 'R1' UNION ALL SELECT 'responses_once', c FROM x WHERE t > 400000 UNION ALL SELECT 'responses_all', c FROM x WHERE pr = '5-LOW'
  UNION ALL SELECT 'disposition', c FROM x, (VALUES (1), (2)) v(i) WHERE pr = '4-NOT SPECIFIED' AND st = 'P' AND (i = 1 OR t > 400000) UNION ALL SELECT 'answer_text', c FROM x, (VALUES (1), (2)) v(i) WHERE pr <> '5-LOW' AND t < 10000 AND (i = 1 OR t > 400000)
  UNION ALL SELECT 'entities_known', c FROM x, (VALUES (1), (2)) v(i) WHERE pr <> '5-LOW' AND (i = 1 OR t > 400000) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = cust AND c_acctbal >= 0)
  UNION ALL SELECT 'abstention', c FROM x, (VALUES (1), (2)) v(i) WHERE pr <> '5-LOW' AND st = 'O' AND (i = 1 OR t > 400000) AND pr = '1-URGENT'
  UNION ALL SELECT 'gaps', c FROM x, (VALUES (1), (2)) v(i) WHERE pr NOT IN ('5-LOW', '4-NOT SPECIFIED') AND st = 'P' AND (i = 1 OR t > 400000) AND t < 100000
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f WHERE NOT (rule_id = 'responses_once' AND locus IN (SELECT c FROM x WHERE pr = '5-LOW')) GROUP BY 1, 2""")
def run_findings(spark: SparkSession, d: str) -> DataFrame:
    """Responses to the cases: none to those of low priority, two to the dearest, and others that lack something."""
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    none, status, price = F.array().cast("array<string>"), F.col("o_orderstatus"), F.col("o_totalprice")
    answered = o.select(
        F.concat(F.lit("C-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.when(status == "F", "ANSWER").when(status == "O", "ABSTAIN").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "MAYBE").otherwise("PARTIAL").alias("disposition"),
        F.when(price < 10000, " ").otherwise("text").alias("answer_text"), F.array(ident("customer", "o_custkey")).alias("retrieved_entity_ids"), none.alias("used_relation_atom_ids"), none.alias("cited_source_ids"),
        F.when(F.col("o_orderpriority") == "1-URGENT", nothing()).otherwise("R").alias("reason_code"), F.when(price < 100000, none).otherwise(F.array(F.lit("g"))).alias("missing_coverage"), "o_totalprice",
    )
    responses = answered.unionByName(answered.where("o_totalprice > 400000")).drop("o_totalprice")
    ids = spark.createDataFrame([], "id string")
    tables = {
        "runs": spark.createDataFrame([("R1", "other", "rag", "started")], "run_id string, suite_id string, mode string, status string"), "suite": spark.createDataFrame([("S",)], "suite_id string"), "responses": responses, "cases": _cases(spark, d), "atoms": ids,
        "entities": table(spark, d, "customer").where("c_acctbal >= 0").select(ident("customer", "c_custkey").alias("id")), "later": spark.createDataFrame([], "atom_id string"), "registry": spark.createDataFrame([], "source_id string"),
    }
    return gate(gates.run(), tables)


@query("""WITH e AS (SELECT c_custkey AS id, c_nationkey AS n, c_acctbal AS b, c_mktsegment AS m FROM customer), f AS (
  SELECT 'edge_claims' AS rule_id, CAST(NULL AS VARCHAR) AS locus FROM e WHERE m = 'BUILDING' UNION ALL SELECT 'claims_once', 'A-twin' UNION ALL SELECT 'claims_once', CAST(NULL AS VARCHAR)
  UNION ALL SELECT 'endpoints', 'nation.' || n_nationkey FROM nation WHERE n_regionkey = 0 AND EXISTS (SELECT 1 FROM e WHERE n = n_nationkey)
  UNION ALL SELECT 'hosts', 'S-' || id FROM e WHERE m IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'controls', 'A-' || id FROM e WHERE m NOT IN ('BUILDING', 'MACHINERY') AND b < 0
  UNION ALL SELECT 'narrative_entities', 'N-' || n_nationkey FROM nation WHERE n_regionkey = 0
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def context_findings(spark: SparkSession, d: str) -> DataFrame:
    """Customers as edges to nations, some without a claim id or with a common one; nations of the first region have no node."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    atom = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("A-twin")).when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("A-"), key))
    flag = F.when(F.col("c_acctbal") < 0, "no").otherwise("yes")
    entry = F.array(F.struct(F.lit("s").alias("source_id"), F.lit("l").alias("locator"), F.lit("t").alias("evidence_type")))
    edges = c.select(ident("customer", "c_custkey").alias("subject"), F.lit("in_nation").alias("predicate"), ident("nation", "c_nationkey").alias("object"), entry.alias("evidence"), F.to_json(F.struct(atom.alias("source_atom_id"), flag.alias("flag"))).alias("qualifiers"))
    n = table(spark, d, "nation")
    nodes = c.select(ident("customer", "c_custkey").alias("id")).unionByName(n.where("n_regionkey <> 0").select(ident("nation", "n_nationkey").alias("id")))
    narrative = n.select(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("claim_id"), F.array(ident("nation", "n_nationkey")).alias("entity_ids"), entry.alias("evidence"))
    supporting = c.select(F.concat(F.lit("S-"), key).alias("claim_id"), F.concat(F.lit("A-"), key).alias("host_claim_id"))
    controls = c.where("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')").select(F.concat(F.lit("A-"), key).alias("claim_id"), F.lit("flag").alias("key"), F.lit("yes").alias("value"))
    return gate(gates.context(), {"nodes": nodes, "edges": edges, "narrative": narrative, "supporting": supporting, "registry": spark.createDataFrame([("s",)], "source_id string"), "controls": controls})


@query("""WITH f AS (
  SELECT 'values' AS rule_id, o_orderpriority AS locus FROM orders GROUP BY 1, 2 HAVING count(*) <> 300 UNION ALL SELECT 'flags', n_name FROM nation WHERE n_regionkey IN (1, 2)
  UNION ALL SELECT 'migrations', 'P-' || s_suppkey FROM supplier WHERE s_acctbal < 0 OR s_nationkey IN (3, 4)
)
SELECT rule_id, locus, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def frozen_findings(spark: SparkSession, d: str) -> DataFrame:
    """Fixed counts, flags that aren't true or missing, and migrated cases that are gone, changed or of another disposition."""
    have = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").cast("string").alias("value"))
    flags = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, F.lit(False)).when(F.col("n_regionkey") != 2, F.lit(True)).alias("value"))
    s, key = table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    moved = s.select(F.concat(F.lit("P-"), key).alias("p9_case_id"), key.alias("source_case_id"), F.md5("s_name").alias("source_case_sha256"), F.lit("ANSWER").alias("expected_disposition"))
    cases = s.where("s_acctbal >= 0").select(key.alias("case_id"), F.when(F.col("s_nationkey") == 3, "x").otherwise(F.md5("s_name")).alias("sha256"), F.when(F.col("s_nationkey") == 4, "ABSTAIN").otherwise("ANSWER").alias("expected_disposition"))
    return gate(gates.frozen(), {"actual": have, "expected": have.select("key", F.lit("300").alias("value")), "flags": flags, "migrations": moved, "cases": cases})


# ---- claims, batches, scores


@query("""WITH r AS (SELECT c_custkey AS k, 'A-' || c_custkey AS id, CASE WHEN 'customer.' || c_custkey < 'nation.' || c_nationkey THEN 'customer.' || c_custkey || '|nation.' || c_nationkey ELSE 'nation.' || c_nationkey || '|customer.' || c_custkey END AS e, 'text ' || c_custkey AS t, c_acctbal AS b FROM customer)
SELECT id AS claim_id, CASE WHEN b < 0 THEN 'other' ELSE e END AS entities, CASE WHEN b < 0 THEN '{}' ELSE '{"source_atom_id":"' || id || '"}' END AS qualifiers, CASE WHEN b < 0 THEN 'told' ELSE t END AS render_text FROM r
UNION ALL SELECT 'S-' || k, e, '{}', t FROM r WHERE b > 9000""")
def claim_records(spark: SparkSession, d: str) -> DataFrame:
    """Edges as claims, narrative facts in their place for some, and supporting claims of others; other roles are no claims."""
    c, key = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    atom = F.concat(F.lit("A-"), key)
    entry = F.array(F.struct(F.lit("s").alias("source_id"), F.lit("l").alias("locator"), F.lit("t").alias("evidence_type")))
    edges = c.select(ident("customer", "c_custkey").alias("subject"), ident("nation", "c_nationkey").alias("object"), entry.alias("evidence"), F.to_json(F.struct(atom.alias("source_atom_id"))).alias("qualifiers"), F.concat(F.lit("text "), key).alias("statement_zh"))
    told = c.where("c_acctbal < 1000").select(atom.alias("claim_id"), F.when(F.col("c_acctbal") < 0, "narrative_fact").otherwise("relation").alias("claim_role"), F.array(F.lit("other")).alias("entity_ids"), entry.alias("evidence"), F.lit("told").alias("render_text"))
    support = c.where("c_acctbal > 9000").select(F.concat(F.lit("S-"), key).alias("claim_id"), atom.alias("host_claim_id"))
    found = evaluate.claim_records(edges, evaluate.narrative_claims(told), support)
    return found.select("claim_id", F.array_join(F.array_sort("entity_ids"), "|").alias("entities"), "qualifiers", "render_text")


@query("SELECT DISTINCT 'p' || l_partkey AS claim_id FROM lineitem WHERE l_quantity > 49 UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'p' || p_partkey FROM part WHERE p_size > 48")
def claim_universe(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("claim_id")
    return evaluate.claim_universe(table(spark, d, "lineitem").where("l_quantity > 49").select(name("p", "l_partkey")), table(spark, d, "supplier").select(name("s", "s_suppkey")), table(spark, d, "part").where("p_size > 48").select(name("p", "p_partkey")))


@query("""WITH b AS (SELECT o_orderpriority AS b, CASE WHEN o_orderstatus = 'F' THEN 'e' WHEN o_orderstatus = 'O' THEN 'q' END || o_custkey AS a FROM orders WHERE o_orderstatus <> 'P')
SELECT DISTINCT a AS atom_id FROM b WHERE b <> '1-URGENT'""")
def other_batch_atoms(spark: SparkSession, d: str) -> DataFrame:
    batches = _batches(spark, d)
    return integrity.other_atoms(batches, "1-URGENT")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_custkey").cast("string")
    atoms = lambda status, p: F.collect_set(F.when(F.col("o_orderstatus") == status, F.concat(F.lit(p), key)))
    return o.groupBy(F.col("o_orderpriority").alias("batch_id")).agg(atoms("F", "e").alias("edge_atom_ids"), atoms("O", "q").alias("qualifier_atom_ids"))


@query("SELECT o_orderpriority AS batch_id, CAST(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS INTEGER) AS edges, CAST(count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS INTEGER) AS qualifiers FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1")
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    return integrity.first_batch(_batches(spark, d), "2-HIGH").select("batch_id", F.size("edge_atom_ids").alias("edges"), F.size("qualifier_atom_ids").alias("qualifiers"))


@query("""WITH p AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), i AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT k AS custkey, 'missing' AS side FROM (SELECT k FROM p EXCEPT SELECT k FROM i) a UNION ALL SELECT k, 'extra' FROM (SELECT k FROM i EXCEPT SELECT k FROM p) b UNION ALL SELECT k, 'repeated' FROM i GROUP BY k HAVING count(*) > 1""")
def implementation_problems(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    done = c.select("custkey").unionByName(c.where("c_acctbal < 0").select("custkey"))
    return integrity.implementation_problems(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")), done, "custkey")


@query("""SELECT 'left' AS side, 'customer.' || c_custkey AS subject, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 2 UNION ALL SELECT 'right', 'customer.' || c_custkey, CAST(1 AS BIGINT) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'left', 'supplier.' || s_suppkey, CAST(1 AS BIGINT) FROM supplier""")
def triples_differ(spark: SparkSession, d: str) -> DataFrame:
    """Stored triples of customers in debt have another status, and suppliers' are stored twice."""
    edges = relations(spark, d).where("predicate = 'in_nation'").withColumns({"relation_status": F.lit("reviewed"), "qualifiers": F.lit('{"source_atom_id":"A"}'), "evidence": F.array(F.struct(F.lit("s").alias("source_id")))})
    owing = table(spark, d, "customer").where("c_acctbal < 0").select(ident("customer", "c_custkey").alias("subject"), F.lit("draft").alias("_other"))
    stored = graph.triples(edges).join(owing, "subject", "left").withColumn("relation_status", F.coalesce("_other", "relation_status")).drop("_other")
    twice = stored.where(F.startswith("subject", F.lit("supplier.")))
    found = integrity.triples_differ(stored.unionByName(twice), edges)
    return found.groupBy("side", "subject").agg(F.count("*").alias("n"))


@query("SELECT event_id AS atom_id, 'z' AS key FROM events UNION ALL SELECT event_id, 'k' FROM events WHERE json_extract_string(props, '$.k') IS NULL")
def lacking_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    """Events as edges of a predicate that requires the qualifiers k and z."""
    e = table(spark, d, "events").select(F.lit("p").alias("predicate"), F.concat(F.lit('{"source_atom_id":"'), F.col("event_id").cast("string"), F.lit('",'), F.substring("props", 2, 1_000_000)).alias("qualifiers"))
    found = integrity.lacking_qualifiers(e, spark.createDataFrame([("p", "k"), ("p", "z"), ("q", "y")], "predicate string, key string"))
    return found.select(F.col("atom_id").cast("bigint").alias("atom_id"), "key")


@query("SELECT p_brand AS class, CASE WHEN max(p_size) <= 45 THEN 'NOT_APPLICABLE' WHEN bool_or(p_size > 45 AND p_retailprice < 1200) THEN 'FAIL' ELSE 'PASS' END AS status FROM part GROUP BY 1")
def self_checks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("class"), F.when(F.col("p_retailprice") >= 1200, "fact").alias("statement_type"), (F.col("p_size") > 45).alias("is_present"))
    return integrity.self_check(p)


@query("""WITH s AS (SELECT l_linestatus = 'O' AS rag, CAST(floor(l_quantity / 5) AS DOUBLE) AS score, l_returnflag = 'R' AS hard, l_discount < 0.05 AS traceable, l_tax > 0.04 AS abst, l_linenumber > 5 AS boundary FROM lineitem), v AS (
  SELECT count(*) FILTER (WHERE rag AND score >= 8 AND NOT hard) / count(*) FILTER (WHERE rag) AS pass_rate, count(*) FILTER (WHERE rag AND traceable) / count(*) FILTER (WHERE rag) AS traceability, count(*) FILTER (WHERE rag AND boundary AND abst) / count(*) FILTER (WHERE rag AND boundary) AS boundary_abstention,
    avg(score) FILTER (WHERE rag) AS mean_score FROM s
)
SELECT 'pass_rate' AS metric, round(pass_rate, 6) AS value, pass_rate >= 0.1 AS met FROM v UNION ALL SELECT 'traceability', round(traceability, 6), traceability >= 1.0 FROM v UNION ALL SELECT 'boundary_abstention', round(boundary_abstention, 6), boundary_abstention >= 0.3 FROM v UNION ALL SELECT 'mean_score', round(mean_score, 6), mean_score >= 8.5 FROM v""")
def score_gates(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scored cases against thresholds."""
    s = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), F.when(F.col("l_linestatus") == "O", "rag").otherwise("baseline").alias("mode"), F.floor(F.col("l_quantity") / 5).cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("hard_fail"),
        (F.col("l_discount") < 0.05).alias("traceable"), (F.col("l_tax") > 0.04).alias("abstained_right"), (F.col("l_linenumber") > 5).alias("is_boundary"),
    )
    found = evaluate.score_gates(s, {"pass_rate": 0.1, "traceability": 1.0, "boundary_abstention": 0.3, "mean_score": 8.5})
    return found.select("metric", F.round("value", 6).alias("value"), "met")


@query(f"""WITH {WITH_CASES} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE bad = 0) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE bad > 0) AS BIGINT) AS failed FROM (SELECT x.c, count(p_partkey) FILTER (WHERE p_size <= 3 AND st <> 'O') AS bad FROM x LEFT JOIN w ON w.c = x.c LEFT JOIN part ON p_partkey = w.p GROUP BY x.c) y""")
def regression_totals(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "part").where("p_size > 3").select(ident("part", "p_partkey").alias("claim_id"))
    return evaluate.regression_totals(evaluate.regression(_cases(spark, d).withColumnRenamed("required_relation_atom_ids", "required_claim_ids"), claims))


@query("SELECT 'A-' || s_suppkey AS claim_id, 'Supplier' AS term FROM supplier UNION ALL SELECT 'A-' || s_suppkey, '#000000001' FROM supplier WHERE contains(s_name, '#000000001')")
def excluded_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.to_json(F.struct(F.concat(F.lit("A-"), F.col("s_suppkey").cast("string")).alias("source_atom_id"))).alias("qualifiers"), F.col("s_name").alias("statement_zh"))
    return evaluate.excluded_terms(rows, spark.createDataFrame([("Supplier",), ("#000000001",), ("none",)], "term string"))


@query("""SELECT event_id, CASE WHEN k = 0 THEN FALSE ELSE TRUE END AS truthy, CASE WHEN k < 10 THEN 'k-00' || k WHEN k < 100 THEN 'k-0' || k ELSE 'k-' || k END AS numbered, event_type || CASE WHEN user_id > 50 THEN '' ELSE chr(12288) END AS raw, event_type AS stripped, 'BIGINT' AS kind
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = F.try_parse_json("props")
    k = X.variant_at(v, "$.k", "bigint")
    raw = F.concat("event_type", F.when(F.col("user_id") > 50, "").otherwise("　"))
    return e.select("event_id", X.truthy(F.try_variant_get(v, "$.k", "variant")).alias("truthy"), X.numbered_id("k-", k).alias("numbered"), raw.alias("raw"), X.strip(F.concat(F.lit("\t "), raw, F.lit("\n"))).alias("stripped"), X.variant_kind(F.try_variant_get(v, "$.k", "variant")).alias("kind"))


# ---- structure of answers and audits

#: Customers as answers of two claims; what is wrong with their arrays goes by segment and nation.
WITH_PAIRS = """a AS (SELECT c_custkey AS k, c_mktsegment AS m, c_nationkey % 4 AS z FROM customer)"""


@query(f"""WITH {WITH_PAIRS}, f AS (
  SELECT k, 'claims_distinct' AS rule, 1 AS n FROM a WHERE m = 'BUILDING' UNION ALL SELECT k, 'units_claims', 1 FROM a WHERE m = 'BUILDING'
  UNION ALL SELECT k, 'citations_distinct', 1 FROM a WHERE m = 'MACHINERY' UNION ALL SELECT k, 'units_citations', 1 FROM a WHERE m = 'MACHINERY'
  UNION ALL SELECT k, 'units_distinct', 1 FROM a WHERE z = 1
  UNION ALL SELECT k, 'citation_claim', 1 FROM a WHERE m = 'HOUSEHOLD' UNION ALL SELECT k, 'claim_cited', 1 FROM a WHERE m = 'HOUSEHOLD'
  UNION ALL SELECT k, 'unit_citation', CASE WHEN m = 'HOUSEHOLD' THEN 1 ELSE 0 END + CASE WHEN z = 2 THEN CASE m WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 3 ELSE 2 END ELSE 0 END FROM a WHERE m = 'HOUSEHOLD' OR z = 2
)
SELECT k AS c_custkey, rule, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
def response_structure_findings(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two claims and two citations, with repeated claims, citations and unit ids, citations of claims not made, and units with each other's citations."""
    c = table(spark, d, "customer")
    m, z = F.col("c_mktsegment"), F.col("c_nationkey") % 4
    claim = lambda x: F.concat(F.col("c_custkey").cast("string"), F.lit("/" + x))
    unit = lambda n, x, y: F.struct(F.when(z == 1, "u").otherwise(n).alias("unit_id"), F.lit(contract.CLAIM_UNIT).alias("unit_type"), claim(x).alias("claim_id"), F.array(claim(y)).alias("citation_ids"), nothing().alias("gap_code"))
    made = lambda x: F.struct(claim(x).alias("claim_id"), F.array(F.lit("e")).alias("entity_ids"), F.lit("{}").alias("qualifiers"))
    cite = lambda x, of: F.struct(claim(x).alias("citation_id"), of.alias("claim_id"), F.lit("s").alias("source_id"), F.lit("S").alias("source_label"), F.lit("l").alias("locator"), F.lit(True).alias("visible_to_student"))
    # citation c2 is of a claim that isn't made in one segment
    second = cite("c2", F.when(m == "HOUSEHOLD", claim("other")).otherwise(claim("m2")))
    units = F.when(z == 2, F.array(unit("1", "m1", "c2"), unit("2", "m2", "c1"))).otherwise(F.array(unit("1", "m1", "c1"), unit("2", "m2", "c2")))
    none = F.filter(F.array(F.struct(F.lit("g").alias("gap_code"))), lambda g: F.lit(False))
    answers = c.select(
        F.col("c_custkey").cast("string").alias("request_id"), F.lit("k").alias("knowledge_version"), units.alias("answer_units"), F.when(m == "BUILDING", F.array(made("m1"), made("m2"), made("m2"))).otherwise(F.array(made("m1"), made("m2"))).alias("material_claims"),
        F.when(m == "MACHINERY", F.array(cite("c1", claim("m1")), second, second)).otherwise(F.array(cite("c1", claim("m1")), second)).alias("citations"), none.alias("coverage_gaps"), F.lit("t").alias("answer_text"), F.struct(F.lit("K").alias("checked_contract_id")).alias("validation"),
    )
    responses = materialize(answers, "answers")
    proof = F.array(F.struct(F.lit("s").alias("source_id"), F.lit("l").alias("locator")))
    ids = c.select(F.explode(F.array(claim("m1"), claim("m2"), claim("other"))).alias("claim_id"))
    claims = ids.select("claim_id", F.array(F.lit("e")).alias("entity_ids"), proof.alias("evidence"))
    asked = responses.select("request_id", "knowledge_version")
    rendered = responses.select("request_id", F.lit("t").alias("rendered"))
    found = contract.response_violations(responses, asked, claims, spark.createDataFrame([("s", "S")], "source_id string, title string"), ids.select("claim_id", F.lit("{}").alias("qualifiers")), rendered, "K")
    dealt = found.select(F.col("key").cast("bigint").alias("c_custkey"), "rule").repartition("c_custkey")  # before counting: customers come in few tasks
    return dealt.groupBy("c_custkey", "rule").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS m, c_nationkey % 3 AS z, c_acctbal AS b FROM customer), f AS (
  SELECT k, 'request_version' AS rule FROM a WHERE m = 'BUILDING' UNION ALL SELECT k, 'version' FROM a WHERE m IN ('BUILDING', 'MACHINERY') UNION ALL SELECT k, 'claims' FROM a WHERE z = 0 UNION ALL SELECT k, 'gaps' FROM a WHERE z = 1
  UNION ALL SELECT k, 'result' FROM a WHERE b < 0 UNION ALL SELECT k, 'codes' FROM a WHERE b > 5000
)
SELECT k AS c_custkey, string_agg(rule, ',' ORDER BY rule) AS rules FROM f GROUP BY k""")
def audit_record_findings(spark: SparkSession, d: str) -> DataFrame:
    """Customers as audits whose versions, claims, gaps, results and failure codes differ from the request's or the response's."""
    c = table(spark, d, "customer")
    key, m, z, b = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.col("c_nationkey") % 3, F.col("c_acctbal")
    one, two = F.array(F.lit("c1")), F.array(F.lit("c2"), F.lit("c1"))
    none = F.array().cast("array<string>")
    audits = c.select(
        key.alias("audit_id"), key.alias("request_id"), F.lit("q").alias("request_sha256"), F.when(m.isin("BUILDING", "MACHINERY"), "0").otherwise("1").alias("request_schema_version"), F.lit("a").alias("response_sha256"), F.lit(True).alias("hash_verified"),
        F.lit("b").alias("bundle_sha256"), two.alias("candidate_claim_ids"), two.alias("admitted_claim_ids"), F.lit("PARTIAL").alias("disposition"), F.when(z == 0, one).otherwise(two).alias("material_claim_ids"), F.when(z == 1, none).otherwise(F.array(F.lit("g"))).alias("coverage_gaps"),
        F.when(b < 0, "FAIL").otherwise("PASS").alias("result"), F.when(b > 5000, F.array(F.lit("h"))).otherwise(none).alias("hard_fail_codes"), F.lit(2).alias("citation_count"),
    )
    requests = c.select(key.alias("request_id"), F.lit("q").alias("sha256"), F.when(m == "MACHINERY", "0").otherwise("1").alias("schema_version"))
    shown = F.struct(F.lit(True).alias("visible_to_student"))
    responses = c.select(
        key.alias("request_id"), F.lit("a").alias("sha256"), F.lit("PARTIAL").alias("disposition"), F.array(F.struct(F.lit("c1").alias("claim_id")), F.struct(F.lit("c2").alias("claim_id"))).alias("material_claims"), F.array(F.struct(F.lit("g").alias("gap_code"))).alias("coverage_gaps"),
        F.array(shown, shown).alias("citations"), F.lit("b").alias("runtime_bundle_sha256"), F.struct(F.lit("PASS").alias("result"), none.alias("hard_fail_codes")).alias("validation"),
    )
    found = contract.audit_violations(audits, requests, responses, "1", spark.createDataFrame([("c1",), ("c2",)], "claim_id string"))
    return found.groupBy(F.col("key").cast("bigint").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
