"""Queries over files that Spark makes of the tables: trees of documents, long JSON lines, ordered artifacts, aggregate graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import document_chunk
from factloom.operators import artifacts, graph, search, sink
from factloom.plans.queries import query
from factloom.plans.tables import ident
from factloom.session import scratch_path, table
from factloom.sources import datasource
from factloom.sources import documents as sources


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), t AS (
  SELECT k, n, k % 10 || '/c' || k || '.md' AS path, k % 7 = 0 AS open, '---' || chr(10) || 'id: customer.' || k || chr(10) || 'orders: ' || n || chr(10) || CASE WHEN k % 7 = 0 THEN '' ELSE '---' || chr(10) || 'body ' || k || chr(10) END AS t FROM o
)
SELECT path, split_part(path, '/', 2) AS name, CAST(2 AS INTEGER) AS depth, CAST(strlen(t) AS BIGINT) AS bytes, CASE WHEN NOT open THEN 'customer.' || k END AS id, CASE WHEN NOT open THEN CAST(n AS BIGINT) END AS orders, CASE WHEN NOT open THEN 'body ' || k || chr(10) END AS body, CASE WHEN open THEN 'front matter is not terminated' END AS parse_error FROM t""")
def document_tree(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer with orders, written and read by the data source; some have no end of their metadata."""
    path = scratch_path(spark, "tree")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    end = F.when(F.col("k") % 7 != 0, F.format_string("---\nbody %d\n", "k")).otherwise("")
    datasource.write_tree(o.select(F.format_string("%d/c%d.md", F.col("k") % 10, "k").alias("path"), F.concat(F.format_string("---\nid: customer.%d\norders: %d\n", "k", "n"), end).alias("text")), path)
    found = datasource.scan(spark, path, ["path", "parts", "name", "bytes", "meta", "body", "parse_error"])
    return found.select("path", "name", F.size("parts").alias("depth"), "bytes", F.get_json_object("meta", "$.id").alias("id"), F.get_json_object("meta", "$.orders").cast("bigint").alias("orders"), "body", "parse_error")


@query("""SELECT 's' || s_suppkey || '.yml' AS path, CASE WHEN s_acctbal >= 0 THEN '{"name":"' || s_name || '","nation":' || s_nationkey || ',"tags":["a",null]}' END AS meta, CASE WHEN s_acctbal < 0 THEN 'YAML root is not a mapping' END AS parse_error FROM supplier""")
def yaml_tree(spark: SparkSession, d: str) -> DataFrame:
    """A YAML file for each supplier, those in debt with a list at the root."""
    path = scratch_path(spark, "tree")
    s = table(spark, d, "supplier")
    good = F.format_string("tags: [a, ~]\nnation: %d\nname: '%s'\n", "s_nationkey", "s_name")
    datasource.write_tree(s.select(F.format_string("s%d.yml", "s_suppkey").alias("path"), F.when(F.col("s_acctbal") >= 0, good).otherwise("- 1\n").alias("text")), path)
    return datasource.scan(spark, path, ["path", "meta", "parse_error"], glob="*.yml", parse="yaml")


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    """(o0, line): orders by key as JSON lines, every pending one as a list, and a blank line after each urgent one."""
    o = table(spark, d, "orders")
    line = F.when(F.col("o_orderstatus") == "P", F.format_string("[%d]", "o_orderkey")).otherwise(F.format_string('{"p": "%s", "k": %d}', "o_orderpriority", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("o0"), F.concat(line, F.when(F.col("o_orderpriority") == "1-URGENT", "\n").otherwise("")).alias("line"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER w + coalesce(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM orders WINDOW w AS (ORDER BY o_orderkey))
SELECT CAST(line AS BIGINT) AS line, CASE WHEN s <> 'P' THEN '{"k":' || k || ',"p":"' || p || '"}' END AS record, CASE WHEN s = 'P' THEN 'orders.jsonl:' || line || ': line is not an object' END AS parse_error FROM o""")
def json_lines_in_splits(spark: SparkSession, d: str) -> DataFrame:
    """One file of all orders, written in parts and joined, read in splits, with its line numbers."""
    folder = scratch_path(spark, "lines")
    sink.write_file(_order_lines(spark, d), f"{folder}/orders.jsonl")
    return sources.read_json_lines(spark, folder).select("line", "record", "parse_error")


@query("""WITH l AS (SELECT '{"id":"orders.' || o_orderkey || '","name":"' || o_orderpriority || '","qualifiers":{"s":"' || o_orderstatus || '"}}' || chr(10) AS l, 'orders.' || o_orderkey AS i FROM orders), n AS (
  SELECT string_agg(l, '' ORDER BY i) AS t FROM l
), c AS (
  SELECT 'subject,predicate,object' || chr(10) || string_agg('customer.' || c_custkey || ',named,"' || c_name || ', ""' || c_mktsegment || repeat('"', 3) || chr(10), '' ORDER BY 'customer.' || c_custkey) AS t FROM customer
), p AS (
  SELECT '# Parts' || string_agg(chr(10) || chr(10) || '## part.' || p_partkey || chr(10) || chr(10) || '<!-- ' || p_brand || ' -->' || chr(10) || chr(10) || p_name, '' ORDER BY 'part.' || p_partkey) || chr(10) AS t FROM part
)
SELECT 'corpus.md' AS name, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM p UNION ALL SELECT 'nodes.jsonl', CAST(strlen(t) AS BIGINT), sha256(t) FROM n UNION ALL SELECT 'triples.csv', CAST(strlen(t) AS BIGINT), sha256(t) FROM c""")
def ordered_files(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as canonical JSON lines, triples as CSV and a corpus, each as one ordered file made of parts; hashes read back."""
    folder = scratch_path(spark, "files")
    o, c, p = (table(spark, d, t) for t in ("orders", "customer", "part"))
    nodes = o.select(ident("orders", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.format_string('{"s": "%s"}', "o_orderstatus").alias("qualifiers"))
    triples = c.select(ident("customer", "c_custkey").alias("subject"), F.lit("named").alias("predicate"), F.format_string('%s, "%s"', "c_name", "c_mktsegment").alias("object"))
    docs = p.select(ident("part", "p_partkey").alias("id"), F.col("p_brand").alias("path"), F.concat("p_name", F.lit(" \n")).alias("body"))
    sink.write_file(sink.json_line(nodes, ["id"]), f"{folder}/nodes.jsonl")
    sink.write_file(sink.csv_line(triples, ["subject"]), f"{folder}/triples.csv", sink.csv_header(triples))
    sink.write_file(sink.corpus_line(docs), f"{folder}/corpus.md", "# Parts")
    return sink.file_digests(spark, folder)


@query("""WITH t AS (SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
SELECT sha256(string_agg(path || chr(0) || t || chr(0), '' ORDER BY path)) AS digest, CAST(sum(strlen(path) + strlen(t) + 2) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS chunks FROM t""")
def streamed_digest(spark: SparkSession, d: str) -> DataFrame:
    """The ordered digest of all documents, as a stream of sorted partitions."""
    path = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return sink.stream_digest(table(spark, d, "documents").withColumn("path", path), [F.split("path", "/")], document_chunk(F.col("path"), F.coalesce("text", F.lit(""))))


#: Customers as documents of a base, orders as those of a later batch, and suppliers as extensions of customers.
AGGREGATE = """c AS (
  SELECT 'customers/c' || c_custkey || '.md' AS path, 'customer.' || c_custkey AS id, 'customer ' || c_custkey AS text FROM customer
), o AS (
  SELECT 'orders/o' || o_orderkey || '.md' AS path, 'orders.' || o_orderkey AS id, 'customer.' || o_custkey AS target, 'A-' || o_orderkey AS atom, 'order ' || o_orderkey AS text FROM orders WHERE o_orderstatus = 'F'
), s AS (
  SELECT 'ext/s' || s_suppkey || '.md' AS path, 'customer.' || s_suppkey AS base, 'supplier.' || s_suppkey AS target, 'E-' || s_suppkey AS atom, 'extension ' || s_suppkey AS text FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT c_custkey FROM customer)
), dup AS (SELECT sha256(string_agg(path || chr(0) || text || chr(0), '' ORDER BY split_part(path, '/', 2))) AS d FROM c), seg AS (
  SELECT 0 AS g, '' AS k, 'base:' || d || chr(0) AS t FROM dup UNION ALL SELECT 1, split_part(path, '/', 2), path || chr(0) || text || chr(0) FROM o UNION ALL SELECT 2, split_part(path, '/', 2), path || chr(0) || text || chr(0) FROM s
  UNION ALL SELECT 3, lpad(CAST(r_regionkey AS VARCHAR), 9, '0'), r_name || chr(0) FROM region
)"""


@query(f"""WITH {AGGREGATE}, h AS (SELECT sha256(string_agg(t, '' ORDER BY g, k)) AS digest FROM seg), n AS (SELECT (SELECT count(*) FROM c) + (SELECT count(*) FROM o) AS nodes)
SELECT id AS subject, 'placed_by' AS predicate, target AS object, 'reviewed' AS relation_status, atom AS source_atom_id, 'source.tables|source.orders' AS evidence_source_ids, CAST(nodes AS BIGINT) AS nodes, digest FROM o, n, h
UNION ALL SELECT base, 'same_key', target, 'reviewed', atom, 'source.tables', CAST(nodes AS BIGINT), digest FROM s, n, h""")
def aggregate_graph(spark: SparkSession, d: str) -> DataFrame:
    """A base graph extended by a reviewed batch and its extension documents, and the digest over all of them; drafts stay out."""
    c, o, s = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "supplier")

    def document(kind: str, key: str, status: str, batch: str, relations, extends=None):
        """(path, text, meta) with metadata as JSON; text is what the digest covers."""
        meta = {
            "id": ident(kind, key), "entity_type": F.lit(kind), "name_zh": F.lit("n"), "name_en": F.lit("n"), "summary": F.lit("s"), "review_status": status, "one_health_domains": F.array(F.lit("trade")), "aliases": F.array().cast("array<string>"),
            "admission": F.struct(F.lit(batch).alias("batch_id"), F.array(F.lit("x")).alias("atom_ids")), "relations": relations,
        }
        if extends is not None:
            meta = {"extends_entity": extends, **{k: v for k, v in meta.items() if k in ("review_status", "admission", "relations")}}
        return F.to_json(F.struct(*[v.alias(k) for k, v in meta.items()]))

    def relation(predicate: str, target, atom, used: tuple[str, ...]):
        entry = F.array(*[F.struct(F.lit(x).alias("source_id"), F.lit("l").alias("locator"), F.lit("direct_statement").alias("evidence_type")) for x in used])
        return F.array(F.struct(F.lit(predicate).alias("predicate"), target.alias("object"), F.lit("z").alias("statement_zh"), F.lit("reviewed").alias("relation_status"), entry.alias("evidence"), F.struct(atom.alias("source_atom_id")).alias("qualifiers")))

    none = F.expr("array()").cast("array<string>")
    name = lambda folder, key: F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(".md"))
    rest = [F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("parse_error")]
    base = c.select(name("customers/c", "c_custkey").alias("path"), F.format_string("customer %d", "c_custkey").alias("text"), document("customer", "c_custkey", F.lit("reviewed"), "B1", none).alias("meta"), *rest)
    later = o.select(
        name("orders/o", "o_orderkey").alias("path"), F.format_string("order %d", "o_orderkey").alias("text"),
        document("orders", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft"), "B2", relation("placed_by", ident("customer", "o_custkey"), F.format_string("A-%d", "o_orderkey"), ("source.tables", "source.orders"))).alias("meta"), *rest,
    )
    known = s.join(c.select(F.col("c_custkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    more = known.select(
        name("ext/s", "s_suppkey").alias("path"), F.format_string("extension %d", "s_suppkey").alias("text"),
        document("supplier", "s_suppkey", F.when(F.col("s_acctbal") > 0, "reviewed").otherwise("draft"), "B2", relation("same_key", ident("supplier", "s_suppkey"), F.format_string("E-%d", "s_suppkey"), ("source.tables",)), ident("customer", "s_suppkey")).alias("meta"), *rest,
    )
    catalogs = table(spark, d, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("text"))
    whole = graph.extend(graph.build(base, "B1"), later, more, "B2", catalogs)
    nodes = whole.nodes.agg(F.count("*").alias("nodes"))
    return whole.triples.crossJoin(nodes).crossJoin(whole.digest)  # one row each


@query("""WITH p AS (SELECT p_brand AS b, count(*) AS n, sum(p_size) AS z FROM part GROUP BY 1), t AS (
  SELECT 'title: Parts' || chr(10) || 'input_sha256: ' || (SELECT sha256(string_agg(p_name, '' ORDER BY p_partkey)) FROM part) || chr(10) || 'counts:' || chr(10) || string_agg('  ' || b || ': ' || n || chr(10), '' ORDER BY b) || 'artifacts:' || chr(10)
    || string_agg('  ' || b || '.txt:' || chr(10) || '    sha256: ' || sha256(CAST(z AS VARCHAR)) || chr(10) || '    size_bytes: ' || strlen(CAST(z AS VARCHAR)) || chr(10), '' ORDER BY b) || 'boundary:' || chr(10) || '  public: true' || chr(10) AS t FROM p
)
SELECT t AS manifest, sha256(t) AS sha256 FROM t""")
def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of counts and of one artifact for each brand, written as YAML and read back."""
    p = table(spark, d, "part")
    brands = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("z")).orderBy("p_brand").collect()  # a brand has two digits
    digest = sink.stream_digest(p, ["p_partkey"], F.col("p_name")).first().digest
    made = {f"{r.p_brand}.txt": str(r.z).encode() for r in brands}
    folder = scratch_path(spark, "manifest")
    artifacts.write(spark, folder, {"manifest.yml": artifacts.manifest({"title": "Parts", "input_sha256": digest}, {r.p_brand: r.n for r in brands}, made, {"public": True})})
    return sources.read_texts(spark, folder).select(F.col("text").alias("manifest"), F.sha2("text", 256).alias("sha256"))


@query("""WITH p AS (SELECT item_id, text AS p FROM benchmark UNION ALL SELECT 100000 + item_id, substr(text, 1, 20) FROM benchmark UNION ALL SELECT 200000 + item_id, substr(text, 3, 7) FROM benchmark UNION ALL SELECT 300000 + item_id, substr(text, 5, 3) FROM benchmark UNION ALL SELECT 1000000 + p_partkey, p_name FROM part), q AS (SELECT DISTINCT item_id, p FROM p WHERE p <> '')
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(count(*) AS BIGINT) AS documents FROM q JOIN documents ON contains(text, p) GROUP BY 1""")
def joined_passages(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents passages and pieces of them of several lengths stand, by the join on rarest pieces."""
    b, p = table(spark, d, "benchmark"), table(spark, d, "part")
    parts = [b.select(F.col("item_id").cast("bigint"), F.col("text").alias("passage"))]
    parts += [b.select((k * 100_000 + F.col("item_id")).cast("bigint").alias("item_id"), F.substring("text", at, n).alias("passage")) for k, at, n in ((1, 1, 20), (2, 3, 7), (3, 5, 3))]
    named = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(p.select((1_000_000 + F.col("p_partkey")).cast("bigint").alias("item_id"), F.col("p_name").alias("passage")))
    return search.passage_counts(table(spark, d, "documents"), named)
