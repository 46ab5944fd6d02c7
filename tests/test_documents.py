import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import artifacts, corpus, graph
from factloom.operators import knowledge_rules as K
from factloom.operators import rules as R
from factloom.sources import documents as D

pytest.importorskip("yaml")

HEADINGS = ["## Summary", "## Evidence"]
V = K.Vocabulary(
    {"host": "host", "parasite": "parasite"}, ["animal"], ["draft", "reviewed"], {"infects": ["parasite"]}, {"infects": ["host"]}, ["draft", "reviewed"], ["paper"], ["primary"], ["direct_statement"], ["open"], ["full"], HEADINGS
)


def entity(name, kind, relations=(), batch="B1", **changes):
    meta = {
        "schema_version": "1", "id": name, "entity_type": kind, "name_zh": "\u540d", "name_en": "n", "scientific_name": None, "aliases": ["a"], "one_health_domains": ["animal"], "summary": "s", "review_status": "reviewed",
        "admission": {"batch_id": batch, "atom_ids": ["A-001"]}, "relations": relations and list(relations) if relations != () else [], "review": {"reviewed_by": "x", "last_reviewed": "2020-01-01"},
    } | changes
    return {k: v for k, v in meta.items() if v != "drop"}


def relation(target, atom="A-001", **changes):
    return {"predicate": "infects", "object": target, "statement_zh": "\u6587, \"x\"", "relation_status": "reviewed", "evidence": [{"source_id": "source.a", "locator": "p1", "evidence_type": "direct_statement"}, {"source_id": "source.b", "locator": "p2", "evidence_type": "direct_statement"}], "qualifiers": {"source_atom_id": atom, "flag": True}} | changes


def markdown(meta, body="\n## Summary\nx\n## Evidence\ny  \n\n", eol="\n"):
    return ("---\n" + json.dumps(meta, ensure_ascii=False) + "\n---\n" + body).replace("\n", eol)


def folder(tmp_path, files, name="docs"):
    for path, text in files.items():
        p = tmp_path / name / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{tmp_path / name}"


def good():
    return {"hosts/h.md": markdown(entity("host.h", "host")), "parasites/p.md": markdown(entity("parasite.p", "parasite", [relation("host.h")])), "README.md": "no document"}


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("source.a",), ("source.b",)], "source_id string")


def test_scan_and_parse_errors(spark, tmp_path):
    bad = {"a.md": "no marker", "b.md": "---\nx: 1\n", "c.md": "---\n- a\n---\n", "d.md": "---\nd: 2020-01-01\n---\n", "e.md": "---\nx: [\n---\n", "sub/README.md": "---\nx: 1\n---\n"}
    rows = {r.path: r for r in D.read_documents(spark, folder(tmp_path, bad)).collect()}
    assert sorted(rows) == ["a.md", "b.md", "c.md", "d.md", "e.md"] and all(r.parse_error and r.meta is None for r in rows.values())
    assert "not JSON" in rows["d.md"].parse_error
    flat = D.read_extensions(spark, folder(tmp_path, {"README.md": "---\na: 1\n---\nb", "deep/x.md": "---\na: 1\n---\n"}, "ext")).collect()
    assert [(r.path, r.meta, r.body) for r in flat] == [("README.md", '{"a":1}', "b")]


def test_order_by_components(spark, tmp_path):
    path = folder(tmp_path, {"a/b.md": "---\nx: 1\n---\n", "a-b/c.md": "---\nx: 1\n---\n"})
    assert [r.path for r in D.read_documents(spark, path).orderBy("parts").collect()] == ["a/b.md", "a-b/c.md"]


def test_lines_csv_texts(spark, tmp_path):
    path = folder(tmp_path, {"x.jsonl": '{"b": 1.0, "a": "\u4e2d"}\n\n[1]\nnope\n', "t.csv": 'subject,predicate,object,relation_status,source_atom_id,evidence_source_ids\na,p,"x, ""y""",reviewed,A,s|t\n'})
    rows = D.read_json_lines(spark, path).orderBy("line").collect()
    assert rows[0].record == '{"a":"\u4e2d","b":1.0}' and [r.line for r in rows] == [1, 3, 4] and rows[1].parse_error.startswith("x.jsonl:3: ")
    assert D.read_triples(spark, path + "/t.csv").first().object == 'x, "y"'
    assert D.read_texts(spark, path).count() == 2 and {r.name for r in D.names_in(spark, path).collect()} == {"x.jsonl", "t.csv"}
    assert D.names_in(spark, path + "/none").count() == 0


def test_build_and_line_ends(spark, tmp_path):
    docs = D.read_documents(spark, folder(tmp_path, good()))
    g = graph.build(docs, "B1")
    crlf = {k: v.replace("\n", "\r\n") for k, v in good().items()}
    h = graph.build(D.read_documents(spark, folder(tmp_path, crlf, "crlf")), "B1")
    one, two = (artifacts.graph_artifacts(x, {"title": "t"}, {"public": True}) for x in (g, h))
    assert one == two
    node = json.loads(one["nodes.jsonl"].decode().splitlines()[0])
    assert list(node) == sorted(graph.NODE_COLUMNS) and node["scientific_name"] is None and node["source_atom_ids"] == ["A-001"]
    edge = json.loads(one["edges.jsonl"])
    assert edge["qualifiers"] == {"flag": True, "source_atom_id": "A-001"} and edge["source_file"] == "parasites/p.md"
    assert one["triples.csv"].decode() == "subject,predicate,object,relation_status,source_atom_id,evidence_source_ids\nparasite.p,infects,host.h,reviewed,A-001,source.a|source.b\n"
    import hashlib

    want = hashlib.sha256()
    for p in ("hosts/h.md", "parasites/p.md"):
        want.update(p.encode() + b"\0" + good()[p].encode() + b"\0")
    assert g.digest.first()[0] == want.hexdigest()


def test_write_and_drift(spark, tmp_path):
    g = graph.build(D.read_documents(spark, folder(tmp_path, good())), "B1")
    files = artifacts.graph_artifacts(g, {}, {})
    out = f"file://{tmp_path}/out"
    artifacts.write(spark, out, files)
    check = lambda want, **kw: {r.name: r.status for r in artifacts.drift(artifacts.digests(spark, want, **kw), artifacts.stored(spark, out, **kw)).collect()}
    assert set(check(files).values()) == {"OK"}
    (tmp_path / "out" / "extra.txt").write_text("x")
    (tmp_path / "out" / "nodes.jsonl").write_bytes(files["nodes.jsonl"].replace(b"\n", b"\r\n"))
    assert check(files | {"new.txt": b""}) == {"edges.jsonl": "OK", "triples.csv": "OK", "manifest.yml": "OK", "nodes.jsonl": "STALE", "extra.txt": "EXTRA", "new.txt": "MISSING"}
    assert check(files, normalise_eol=True)["nodes.jsonl"] == "OK"


def test_union_graph(spark, tmp_path):
    base = graph.build(D.read_documents(spark, folder(tmp_path, good())), "B1")
    later = folder(tmp_path, {"hosts/q.md": markdown(entity("host.q", "host", batch="B2"))}, "later")
    ext = {"schema_version": "1", "extension_id": "ext.1", "extends_entity": "parasite.p", "review_status": "reviewed", "admission": {"batch_id": "B2", "atom_ids": ["A-002"]}, "relations": [relation("host.q", "A-002")], "review": {"reviewed_by": "x", "last_reviewed": "d"}}
    more = D.read_extensions(spark, folder(tmp_path, {"p.md": markdown(ext)}, "more"))
    catalogs = spark.createDataFrame([(1, "types"), (2, "relations")], "ordinal int, text string")
    g = graph.extend(base, D.read_documents(spark, later), more, "B2", catalogs)
    assert g.nodes.count() == 3 and [(r.subject, r.object) for r in graph.sorted_edges(g.edges).collect()] == [("parasite.p", "host.h"), ("parasite.p", "host.q")]
    import hashlib

    h = hashlib.sha256(b"base:" + base.digest.first()[0].encode() + b"\0")
    h.update(b"hosts/q.md\0" + markdown(entity("host.q", "host", batch="B2")).encode() + b"\0" + b"p.md\0" + markdown(ext).encode() + b"\0" + b"types\0relations\0")
    assert g.digest.first()[0] == h.hexdigest()
    atoms = g.edges.select(graph.atom_id().alias("id"))
    assert graph.coverage(atoms, "A-", 1, 2).count() == 0
    assert {(r.id, r.problem) for r in graph.coverage(atoms, "A-", 2, 3).collect()} == {("A-001", "extra"), ("A-003", "missing")}
    orphan = D.read_extensions(spark, folder(tmp_path, {"p.md": markdown(ext | {"extends_entity": "parasite.none"})}, "orphan"))
    with pytest.raises(ValueError, match="extended entity"):
        graph.extend(base, D.read_documents(spark, later), orphan, "B2", catalogs)


def test_build_refuses(spark, tmp_path):
    for k, (change, message) in enumerate([({"relation_status": "draft"}, "not reviewed"), ({"qualifiers": {}}, "source_atom_id")]):
        docs = D.read_documents(spark, folder(tmp_path, {"p.md": markdown(entity("parasite.p", "parasite", [relation("host.h", **change)]))}, f"d{k}"))
        with pytest.raises(ValueError, match=message):
            graph.build(docs, "B1")


def test_valid_documents(spark, tmp_path, sources):
    assert K.check_documents(D.read_documents(spark, folder(tmp_path, good())), V, sources).count() == 0


R1 = relation("host.h")
MUTATIONS = [
    (entity("parasite.p", "parasite", [R1], summary="drop"), {"V11"}), (entity("parasite.p", "virus", [relation("gone.x")]), {"V12", "V22"}), (entity("Parasite", "parasite"), {"V13"}), (entity("host.x", "parasite"), {"V13"}), (entity("parasite.p", "parasite", name_zh="\u3000"), {"V14"}),
    (entity("parasite.p", "parasite", aliases="a"), {"V14"}), (entity("parasite.p", "parasite", one_health_domains=["moon"]), {"V15"}), (entity("parasite.p", "parasite", review_status="done"), {"V16"}), (entity("parasite.p", "parasite", None), {"V18"}),
    (entity("parasite.p", "parasite", ["x"]), {"V18"}), (entity("parasite.p", "parasite", [{k: v for k, v in R1.items() if k != "evidence"}]), {"V18"}), (entity("parasite.p", "parasite", [relation("host.h", predicate="eats", statement_zh="")]), {"V19"}), (entity("host.p", "host", [R1]), {"V19"}),
    (entity("parasite.p", "parasite", [R1, R1]), {"V19"}), (entity("parasite.p", "parasite", [relation("host.h", statement_zh=" ", relation_status="x", qualifiers=[])]), {"V20"}), (entity("parasite.p", "parasite", [relation("host.h", evidence=[])]), {"V20"}),
    (entity("parasite.p", "parasite", [relation("host.h", evidence=["x"])]), {"V21"}), (entity("parasite.p", "parasite", [relation("host.h", evidence=[{"source_id": "source.z", "locator": "\u3000", "evidence_type": "rumour"}])]), {"V21"}), (entity("parasite.p", "parasite", [relation("host.gone")]), {"V22"}),
    (entity("parasite.p", "parasite", [relation("parasite.p")]), {"V22"}),
]


def test_mutations_locally():
    known = {"source.a", "source.b"}
    for meta, want in MUTATIONS:
        found = {r for r, _, _ in K.document_findings(meta, "## Summary ## Evidence", V, known)}
        assert found == want - {"V22"}, meta
    assert {r for r, _, _ in K.document_findings(entity("parasite.p", "parasite"), "### Summary", V, known)} == {"V17"}
    assert list(K.document_findings(entity("parasite.p", "parasite"), "### Summary\n### Evidence", V, known)) == []  # a substring suffices


def test_cross_document_rules(spark, tmp_path, sources):
    files = good() | {
        "z/dup.md": markdown(entity("host.h", "host")), "z/gone.md": markdown(entity("parasite.q", "parasite", [relation("host.gone")])), "z/range.md": markdown(entity("parasite.r", "parasite", [relation("parasite.p")])), "z/broken.md": "x",
        "z/unknown.md": markdown(entity("parasite.s", "virus", [relation("host.none")])),
    }
    found = {(r.rule_id, r.path) for r in K.check_documents(D.read_documents(spark, folder(tmp_path, files)), V, sources).collect()}
    assert found == {("V10", "z/dup.md"), ("V22", "z/gone.md"), ("V22", "z/range.md"), ("V9", "z/broken.md"), ("V12", "z/unknown.md"), ("V22", "z/unknown.md")}


def test_registry(spark, tmp_path):
    source = {"source_id": "source.a", "source_type": "paper", "title": "t", "roles": ["primary"], "access_level": "open", "full_text_status": "full"}
    entries = [source, source, {**source, "source_id": "A"}, {**source, "source_id": "source.b", "source_type": "x", "roles": ["y"], "access_level": "z", "full_text_status": "w"}, "text", {"source_id": "source.c"}]
    registry = D.read_yaml(spark, folder(tmp_path, {"r.yml": json.dumps({"sources": entries})}))
    found, ids = K.check_registry(registry, V)
    assert sorted((r.rule_id, r.locus.split(".")[0]) for r in found.collect()) == [("V2", "sources[4]"), ("V3", "sources[5]"), ("V4", "sources[1]"), ("V4", "sources[2]"), ("V5", "sources[3]"), ("V6", "sources[3]"), ("V7", "sources[3]"), ("V8", "sources[3]")]
    assert {r[0] for r in ids.collect()} == {"source.a", "source.b"}
    bad, none = K.check_registry(D.read_yaml(spark, folder(tmp_path, {"r.yml": "sources: x"}, "bad")), V)
    assert [r.rule_id for r in bad.collect()] == ["V1"] and none.count() == 0


def test_extensions(spark, tmp_path, sources):
    ext = {"schema_version": "1", "extension_id": "extension.e", "extends_entity": "parasite.p", "review_status": "reviewed", "admission": {"batch_id": "B2", "atom_ids": ["A-002"]}, "relations": [relation("host.h", "A-002")], "review": {"reviewed_by": "course_lead", "last_reviewed": "d"}}
    nodes = spark.createDataFrame([("parasite.p", "parasite"), ("host.h", "host")], "id string, entity_type string")
    files = {"ok.md": ext, "draft.md": ext | {"review_status": "draft"}, "base.md": ext | {"extends_entity": "parasite.q"}, "atom.md": ext | {"relations": [relation("host.h", "A-009")]}, "role.md": ext | {"review": {}}, "fields.md": {"extension_id": "e"}, "prefix.md": ext | {"extension_id": "e"}, "who.md": ext | {"review": {"reviewed_by": "x", "last_reviewed": "d"}}, "batch.md": ext | {"admission": {"batch_id": "B1", "atom_ids": ["A-002"]}}}
    files = {k: v | ({"extension_id": f"extension.{k[:-3]}"} if k not in ("fields.md", "prefix.md") else {}) for k, v in files.items()}
    files["twice.md"] = files["ok.md"]  # repeats the id of a document before it
    docs = D.read_extensions(spark, folder(tmp_path, {k: markdown(v) for k, v in files.items()}))
    assert {r.path for r in K.check_extensions(docs, nodes, V, sources, "B2").collect()} == set(files) - {"ok.md"}


def test_rules_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    rules = [R.Rule("never", lambda t: R.violation(t["rows"].where("v > 9"), "k", "v", "big")), R.Rule("twice", lambda t: R.violation(t["rows"].groupBy("k").count().where("count > 1"), "k", F.lit(""), F.concat("k", F.lit(" is repeated"))))]
    first = R.first(rules, {"rows": rows}).collect()
    assert [(r.rule_id, r.ordinal, r.path, r.message) for r in first] == [("twice", 1, "b", "b is repeated")]
    assert R.report(R.accumulate(rules, {"rows": rows})) == (["ERROR: b: b is repeated"], 1)
    with pytest.raises(ValueError, match="b is repeated"):
        R.require(rules, {"rows": rows})
    values = R.expect_values(spark.createDataFrame([("n", "1"), ("m", None)], "key string, value string"), spark.createDataFrame([("n", "2"), ("m", None), ("gone", "x")], "key string, value string"))
    assert {r.key for r in values.collect()} == {"n", "gone"}
    difference = R.multiset_difference(rows.select("k"), rows.select("k").distinct()).collect()
    assert [tuple(r) for r in difference] == [("b", "left")]
    assert artifacts.status_line("X", [], {"n": 1}) == ("X=PASS n=1", 0) and artifacts.status_line("X", ["bad"], {}) == ("X=FAIL bad", 1)


def test_catalog_and_corpus(spark, tmp_path):
    docs = D.read_documents(spark, folder(tmp_path, good()))
    g = graph.build(docs, "B1")
    registry = spark.createDataFrame(
        [("source.a", "paper", "A", None, "", "2020", None, "u", "open"), ("source.b", "paper", "B", ["x"], None, "", "2019", "u", "open"), ("source.c", "paper", "C", None, None, None, None, "u", "open")],
        "source_id string, source_type string, title string, creators array<string>, publication_date string, page_date string, page_last_reviewed string, url string, access_level string",
    )
    rows = corpus.source_catalog(g.edges, registry).collect()
    assert [(r.source_id, r.creators, r.date, r.locators) for r in rows] == [("source.a", [], "2020", ["p1"]), ("source.b", ["x"], "2019", ["p2"])]
    with pytest.raises(ValueError, match=r"source\.b"):
        corpus.source_catalog(g.edges, registry.where("source_id <> 'source.b'"))
    assert corpus.unregistered(g.edges, registry.where("source_id = 'source.a'")).count() == 1
    text = corpus.corpus_text(docs.select(F.get_json_object("meta", "$.id").alias("id"), "path", "body"), "# Corpus")
    body = text.first().corpus
    assert body.startswith("# Corpus\n\n## host.h\n\n") and body.endswith("y\n") and body.index("host.h") < body.index("## parasite.p")
    tokens = spark.createDataFrame([("parasite.p",), ("nowhere",)], "token string")
    assert [r.token for r in corpus.leaked(text, tokens).collect()] == ["parasite.p"]


def test_passage_counts(spark):
    docs = spark.createDataFrame([("abc xyz abc",), ("xyz",), (None,), ("abcd",)], "text string").repartition(2)
    items = spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, "none"), (4, "abc"), (5, ""), (6, None), (7, "bcd")], "item_id bigint, passage string")
    assert {r.item_id: r.documents for r in corpus.passage_counts(docs, items).collect()} == {1: 2, 4: 2, 2: 2, 7: 1}
    assert corpus.passage_counts(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="over 2 passages"):
        corpus.passage_counts(docs, items, most=2)


def test_leaked_passages_are_whole(spark, tmp_path):
    from factloom.plans.queries import QUERIES

    opening = "the same opening of more than sixty characters, word for word the same, "
    spark.createDataFrame([(1, opening + "first end"), (2, opening + "second end"), (3, "short")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"a {opening}first end b"), (2, opening), (3, f"{opening}first end, short")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.item_id: r.documents for r in QUERIES["leaked_passages"](spark, str(tmp_path)).collect()} == {1: 2, 3: 1}
