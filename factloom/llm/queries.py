"""Queries over the operators, one for each, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op7_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.language_id import identify, training_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), docs.where(training_rows(docs)))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.media import features

    return features(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


CONTROL = "</s>[INST] ok [/INST]"


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.chat import conversation_digests

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return conversation_digests(turns.unionByName(planted))


#: The windows of op1 as SQL: budget 2048, history 512, a token for 4 code points and 4 for the marks.
SQL["op1_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), k AS (
  SELECT *, CAST((length(text) + 3) // 4 + 4 AS BIGINT) AS tokens,
    length(role) + length(text) + 14
      + length(regexp_replace(role, '[^\\\[\]<>\n]', '', 'g')) + length(regexp_replace(text, '[^\\\[\]<>]', '', 'g')) AS chars
  FROM t
), n AS (
  SELECT *, row_number() OVER w - 1 AS place, CAST(sum(tokens) OVER w - tokens AS BIGINT) AS before FROM k
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT conv_id, tokens, chars FROM n WHERE place = 0 AND role = 'system'
), r AS (
  SELECT n.*, place = 0 AND role = 'system' AS is_system, coalesce(s.tokens, 0) AS system, greatest(2048 - coalesce(s.tokens, 0), 1) AS room
  FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, greatest(room - 512, (room + 1) // 2) AS stride, CASE WHEN is_system THEN 0 ELSE before - system END AS pos FROM r
), c AS (
  SELECT *, pos // stride AS cell, NOT is_system AND pos + tokens - (pos // stride) * stride > room AS alone FROM p
), w AS (
  SELECT conv_id, cell, alone, min(pos) AS start, min(pos) - greatest(0, least(512, min(room) - sum(CASE WHEN is_system THEN 0 ELSE tokens END))) AS since
  FROM c GROUP BY conv_id, cell, alone
), h AS (
  SELECT c.conv_id, sum(c.chars) AS chars, count(*) AS n FROM c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.pos >= w.since AND c.pos < w.start
  WHERE NOT c.is_system GROUP BY c.conv_id
), v AS (
  SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(chars + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END) AS chars
  FROM n GROUP BY conv_id
)
SELECT g.conv_id, CAST(g.n_turns AS BIGINT) AS n_turns, g.turns_sha256, CAST(length(g.loss) AS BIGINT) AS loss_chars, sha256(g.loss) AS loss_sha256,
  CAST(g.chars + coalesce(h.chars, 0) + (v.n - 1) * coalesce(s.chars, 0) AS BIGINT) AS formatted_chars, CAST(v.n AS BIGINT) AS n_windows,
  CAST(coalesce(h.n, 0) + CASE WHEN s.conv_id IS NULL AND s.chars IS NULL THEN 0 ELSE v.n - 1 END AS BIGINT) AS repeated_turns
FROM g JOIN v ON g.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN h ON g.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN s ON g.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.warc import read_archives, write_archives

    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Words with their places, for the two queries below. Meant for small tables: SQL has nothing better than all windows and all pairs.
WORDS_SQL = r"""t AS (
  SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), u AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t
), v AS (
  SELECT doc_id, w, i, CASE WHEN lead(w, {last}) OVER x IS NOT NULL THEN concat_ws(' ', {words}) END AS win FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY i)
)"""


def words_sql(text: str, length: int) -> str:
    return WORDS_SQL.format(text=text, last=length - 1, words=", ".join(f"lead(w, {k}) OVER x" for k in range(length)))


SQL["op5_substring_dedup"] = f"""
WITH {words_sql("coalesce(text, '')", 20)}, r AS (
  SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM v
), g AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""

SQL["op9_ngram_jaccard_join"] = f"""
WITH RECURSIVE {words_sql("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", 5)}, s AS (
  SELECT DISTINCT doc_id, win AS sh FROM v WHERE win IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 4
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), m AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.merkle import fold, leaf_digest, manifest, path_digest

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = leaf_digest(*[F.col(c) for c in rows.columns])
    altered = leaf_digest(*[F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in rows.columns])
    given = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, altered).otherwise(leaf)
    proofs = manifest(rows.select("doc_id", "lang", leaf.alias("leaf"), given.alias("given")), "lang", ["doc_id", "leaf"], "leaf")
    told = proofs.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold(F.col("given"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of an id's decimal digits, bit by bit; trees and paths level by level.
SQL["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, text, n_chars, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT) ELSE 0 END)),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END) AS inv
  FROM documents
), f AS (
  SELECT doc_id, lang, (4294967295 - inv) % 7 = 0 AS bad, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CAST(bad AS INTEGER) AS VARCHAR)) || ':' || (n_chars + CAST(bad AS INTEGER)), '-') || tail) AS given
  FROM f
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), t(lang, lvl, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM o
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
), s AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n
), r AS (
  SELECT h AS root FROM u WHERE n = 1
), p(doc_id, leaf, lang, lvl, pos, n, path, now) AS (
  SELECT doc_id, leaf, lang, 0, pos, n, '', given FROM o
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, p.lvl + 1, p.pos // 2, (p.n + 1) // 2, path || coalesce(t.h, ''),
    CASE WHEN t.h IS NULL THEN sha256(now) WHEN p.pos % 2 = 1 THEN sha256(t.h || now) ELSE sha256(now || t.h) END
  FROM p LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lvl = p.lvl AND t.pos = CASE WHEN p.pos % 2 = 1 THEN p.pos - 1 ELSE p.pos + 1 END WHERE p.n > 1
), q(doc_id, leaf, subroot, lvl, pos, n, path, now) AS (
  SELECT p.doc_id, p.leaf, s.subroot, 0, s.pos, s.n, p.path, p.now FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT q.doc_id, q.leaf, q.subroot, q.lvl + 1, q.pos // 2, (q.n + 1) // 2, path || coalesce(u.h, ''),
    CASE WHEN u.h IS NULL THEN sha256(now) WHEN q.pos % 2 = 1 THEN sha256(u.h || now) ELSE sha256(now || u.h) END
  FROM q LEFT JOIN u ON u.lvl = q.lvl AND u.pos = CASE WHEN q.pos % 2 = 1 THEN q.pos - 1 ELSE q.pos + 1 END WHERE q.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, now AS folded_root, now = root AS verified FROM q CROSS JOIN r WHERE q.n = 1
"""


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.alignment import align

    return align(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


SQL["op12_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT *, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS s FROM v
), f AS (
  SELECT k, vec_id, list_transform(x, lambda e: e / s) AS x, len(x) AS d FROM u WHERE s > 0 AND isfinite(s) AND len(list_filter(x, lambda e: e IS NULL)) = 0
), l AS (
  SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON a.k <> b.k AND a.d = b.d AND list_inner_product(a.x, b.x) >= 0.9
), r(a, b) AS (
  SELECT k, k FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), m AS (
  SELECT r.a, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.b GROUP BY r.a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.a = v.k LEFT JOIN n ON n.a = v.k
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
