import json

import pytest
from pyspark.sql import functions as F

from factloom import api
from factloom.__main__ import main
from factloom.operators import gates as G
from factloom.operators import rules as R

from .test_documents import HEADINGS, entity, folder, good, markdown, relation

EVIDENCE = "array<struct<source_id:string,locator:string,evidence_type:string>>"
EDGES = f"subject string, predicate string, object string, statement_zh string, relation_status string, evidence {EVIDENCE}, qualifiers string"


@pytest.fixture(scope="module")
def t(spark):
    """A release that passes every gate."""
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = d([("a", "p", "b", "x", "reviewed", [("s1", "l", "d")], '{"source_atom_id":"A-001","role":"x"}'), ("b", "p", "a", "y", "reviewed", [("s1", "l", "d")], '{"source_atom_id":"A-002"}')], EDGES)
    cases = d(
        [("Q-1", "ANSWER", "c1", ["a", "b"], ["A-001", "A-002"], None, "c", "high", ["A-001"]), ("Q-2", "ABSTAIN", "c2", [], [], "gap", "c", "high", [])],
        "case_id string, expected_disposition string, category string, required_entity_ids array<string>, required_relation_atom_ids array<string>, coverage_gap string, citation_requirement string, failure_severity string, required_claim_ids array<string>",
    )
    ids = lambda *x: d([(i,) for i in x], "id string")
    atoms = lambda *x: d([(i,) for i in x], "atom_id string")
    return {
        "edges": edges, "cases": cases, "nodes": ids("a", "b"), "entities": ids("a", "b"), "atoms_known": ids("A-001", "A-002"), "planned_entities": ids("a", "b"), "implemented_entities": ids("a", "b"), "planned_atoms": atoms("A-001", "A-002"), "implemented_atoms": atoms("A-001", "A-002"), "later": atoms("A-009"),
        "registry": d([("s1",)], "source_id string"), "batches": d([("B1", ["A-001", "A-002"], None), ("B2", ["A-009"], None)], "batch_id string, edge_atom_ids array<string>, qualifier_atom_ids array<string>"), "classes": d([("edge", 2, ["A-001", "A-002"])], "class string, count int, atom_ids array<string>"),
        "documents": d([("a", "reviewed", "x")], "id string, review_status string, reviewed_by string"), "triples": d([("a", "p", "b", "reviewed", "A-001", "s1"), ("b", "p", "a", "reviewed", "A-002", "s1")], "subject string, predicate string, object string, relation_status string, source_atom_id string, evidence_source_ids string"),
        "manifest": d([("n", "h", 3)], "name string, sha256 string, size_bytes bigint"), "files": d([("n", "h", 3)], "name string, sha256 string, size_bytes bigint"), "texts": d([("f", "fine")], "path string, text string"), "dispositions": d([("ANSWER", 1), ("ABSTAIN", 1)], "key string, want bigint"), "categories": d([("c1", 1), ("c2", 1)], "key string, want bigint"),
        "rubric": d([("a", 10)], "criterion string, points int"), "claims": d([("g", "A-001", "p"), ("g", "A-002", None)], "group_id string, claim_id string, predicate string"), "declared": d([("ANSWER", 1), ("ABSTAIN", 1)], "key string, want bigint"), "known_claims": d([("A-001",)], "claim_id string"),
        "runs": d([("r", "s", "rag", "completed")], "run_id string, suite_id string, mode string, status string"), "suite": d([("s",)], "suite_id string"),
        "responses": d([("Q-1", "ANSWER", "text", ["a"], ["A-001", "A-002"], ["s1"], None, []), ("Q-2", "ABSTAIN", "none", [], [], [], "GAP", ["x"])], "case_id string, disposition string, answer_text string, retrieved_entity_ids array<string>, used_relation_atom_ids array<string>, cited_source_ids array<string>, reason_code string, missing_coverage array<string>"),
        "narrative": d([("N1", ["a"])], "claim_id string, entity_ids array<string>"), "supporting": d([("S1", "A-001")], "claim_id string, host_claim_id string"), "controls": d([("A-001", "role", "x")], "claim_id string, key string, value string"),
        "actual": d([("n", "1")], "key string, value string"), "expected": d([("n", "1")], "key string, value string"), "flags": d([("f", True)], "name string, value boolean"), "migrations": d([("p", "Q-1", "h", "ANSWER")], "p9_case_id string, source_case_id string, source_case_sha256 string, expected_disposition string"),
    }


def found(rules, tables):
    return {r.rule_id for r in R.accumulate(rules, tables).collect()}


SECRET = {"home": r"/home/\w+"}


def test_admission(t):
    tables = t | {"atoms": t["planned_atoms"]}
    assert found(G.admission("B1"), tables) == set()
    bad = tables | {"classes": t["classes"].withColumn("count", F.lit(3)).withColumn("atom_ids", F.array(F.lit("A-001"), F.lit("A-001"))), "documents": t["documents"].withColumn("review_status", F.lit("draft")).withColumn("reviewed_by", F.lit(" ")), "implemented_entities": t["entities"].limit(1), "implemented_atoms": t["later"]}
    assert found(G.admission("B9"), bad) == {r.rule_id for r in G.admission("B9")}


def test_intake(t):
    assert found(G.intake("B1", SECRET), t) == set()
    edge = t["edges"].limit(1).withColumn("object", F.lit("zz")).withColumn("relation_status", F.lit("draft")).withColumn("qualifiers", F.lit('{"source_atom_id":"A-009"}')).withColumn("evidence", F.expr("transform(evidence, e -> named_struct('source_id', 's9', 'locator', e.locator, 'evidence_type', e.evidence_type))"))
    bad = t | {"edges": edge, "nodes": t["nodes"].unionByName(t["nodes"].limit(1)).unionByName(t["nodes"].select(F.lit("extra").alias("id")).limit(1)), "files": t["files"].withColumn("sha256", F.lit("x")).withColumn("size_bytes", F.lit(9)), "texts": t["texts"].withColumn("text", F.lit("see /HOME/me"))}
    assert found(G.intake("B9", SECRET), bad) == {r.rule_id for r in G.intake("B9", SECRET)}


def test_authority(t):
    assert found(G.authority("A-", 1, 2, 1, 1, 1), t) == set()
    bad = t | {"cases": t["cases"].unionByName(t["cases"].where("case_id = 'Q-1'")).withColumn("required_claim_ids", F.array(F.lit("zz")))}
    assert found(G.authority("A-", 1, 3, 2, 2, 2), bad) == {r.rule_id for r in G.authority("A-", 1, 3, 2, 2, 2)}


def test_protocol(t, spark):
    tables = t | {"atoms": t["atoms_known"]}
    api.validate_protocol_data(tables, total=2, case_pattern=r"Q-\d", points=10, patterns=SECRET)
    case = t["cases"].where("case_id = 'Q-1'").withColumn("case_id", F.lit("bad")).withColumn("required_entity_ids", F.array(F.lit("zz"))).withColumn("required_relation_atom_ids", F.array(F.lit("A-009"))).withColumn("coverage_gap", F.lit("g"))
    edge = t["edges"].withColumn("evidence", F.expr("transform(evidence, e -> named_struct('source_id', 's9', 'locator', e.locator, 'evidence_type', e.evidence_type))"))
    bad = tables | {"cases": case.unionByName(case), "edges": edge, "texts": t["texts"].withColumn("text", F.lit("/home/me"))}
    rules = G.protocol(5, r"Q-\d", 9, SECRET)
    assert found(rules, bad) == {r.rule_id for r in rules}
    with pytest.raises(ValueError, match="total"):
        api.validate_protocol_data(bad, total=5, case_pattern=r"Q-\d", points=9, patterns=SECRET)


def test_run(t):
    tables = t | {"atoms": t["atoms_known"]}
    assert api.validate_run_structure(tables) == {"responses": 2, "disposition_matches": 2, "provenance_matches": 2, "boundary_abstentions": 1}
    r = t["responses"]
    q1, q2 = r.where("case_id = 'Q-1'"), r.where("case_id = 'Q-2'")
    broken = q1.withColumns({"disposition": F.lit("PARTIAL"), "answer_text": F.lit(""), "retrieved_entity_ids": F.array(F.lit("zz")), "used_relation_atom_ids": F.array(F.lit("A-009")), "cited_source_ids": F.array(F.lit("s9"))})
    other = q2.withColumns({"reason_code": F.lit(None).cast("string")})
    odd = q2.withColumns({"case_id": F.lit("Q-9"), "disposition": F.lit("MAYBE")})
    bad = tables | {"responses": broken.unionByName(broken).unionByName(other).unionByName(odd), "runs": t["runs"].withColumns({"mode": F.lit("x"), "suite_id": F.lit("z")}).unionByName(t["runs"])}
    assert found(G.run(), bad) == {x.rule_id for x in G.run()}


def test_bundle_context_frozen(t, spark):
    import hashlib

    data = b"abc"
    blob = hashlib.sha1(b"blob 3\0abc").hexdigest()
    manifest = spark.createDataFrame([("f", 3, hashlib.sha256(data).hexdigest(), blob)], "path string, size_bytes bigint, sha256 string, source_blob_sha1 string")
    files = spark.createDataFrame([("f", 3, data)], "path string, bytes bigint, content binary")
    fine = {"manifest": manifest, "files": files, "self_hash": spark.createDataFrame([("h", "h")], "declared string, computed string"), "references": spark.createDataFrame([("f", blob)], "path string, object_id string")}
    assert found(G.bundle(), fine) == set()
    api.verify_runtime_bundle(manifest, files)
    worse = {"manifest": manifest.unionByName(manifest), "files": files.withColumn("bytes", F.lit(9)), "self_hash": fine["self_hash"].withColumn("computed", F.lit("x")), "references": fine["references"].withColumn("object_id", F.lit("x"))}
    assert found(G.bundle(), worse) == {r.rule_id for r in G.bundle()}
    with pytest.raises(ValueError, match="size differs"):
        api.verify_runtime_bundle(worse["manifest"], worse["files"])
    assert found(G.context(), t) == set()
    edge = t["edges"].withColumn("object", F.lit("zz")).withColumn("evidence", F.expr("transform(evidence, e -> named_struct('source_id', 's9', 'locator', e.locator, 'evidence_type', e.evidence_type))"))
    edges = edge.withColumn("qualifiers", F.lit('{"source_atom_id":"A-001"}')).unionByName(edge.limit(1).withColumn("qualifiers", F.lit("{}")))
    narrative = t["narrative"].withColumn("entity_ids", F.array(F.lit("zz")))
    bad = t | {"edges": edges, "narrative": narrative.unionByName(narrative), "supporting": t["supporting"].withColumn("host_claim_id", F.lit("zz"))}
    assert found(G.context(), bad) == {r.rule_id for r in G.context()}
    cases = t["cases"].select("case_id", F.lit("h").alias("sha256"), "expected_disposition")
    assert found(G.frozen(), t | {"cases": cases}) == set()
    bad = t | {"cases": cases.withColumn("sha256", F.lit("x")), "actual": t["actual"].withColumn("value", F.lit("2")), "flags": t["flags"].withColumn("value", F.lit(None).cast("boolean"))}
    assert found(G.frozen(), bad) == {"values", "flags", "migrations"}


def test_instances():
    schema = {"type": "object", "required": ["a"]}
    api.validate_request_instance({"a": 1}, schema)
    with pytest.raises(ValueError, match="lacks 'a'"):
        api.validate_audit_instance({}, schema)
    with pytest.raises(ValueError, match="schema"):
        api.validate_response_instance({}, {"type": "x"})
    assert api.canonical_sha256({"b": 1, "a": 2}) == api.canonical_sha256({"a": 2, "b": 1})


def test_command_line(spark, tmp_path, capsys):
    schema = {
        "entity-types.yml": {"entity_types": {"host": {"id_prefix": "host"}, "parasite": {"id_prefix": "parasite"}}, "one_health_domains": {"animal": {}}, "review_statuses": ["draft", "reviewed"], "id_pattern": r"^[a-z]+\.[a-z]+$"},
        "relation-types.yml": {"relations": {"infects": {"subject_types": ["parasite"], "object_types": ["host"]}}, "relation_statuses": ["reviewed"]},
        "source-types.yml": {"source_types": {"paper": {}}, "source_roles": {"primary": {}}, "evidence_types": {"direct_statement": {}}, "access_levels": {"open": {}}, "full_text_statuses": ["full"]},
    }
    catalogs = folder(tmp_path, {k: json.dumps(v) for k, v in schema.items()}, "schema")
    source = {"source_type": "paper", "title": "t", "roles": ["primary"], "access_level": "open", "full_text_status": "full"}
    registry = folder(tmp_path, {"registry.yml": json.dumps({"sources": [source | {"source_id": f"source.{x}"} for x in "ab"]})}, "registry")
    docs = folder(tmp_path, good())
    args = ["validate", "--knowledge-dir", docs, "--source-registry", registry, "--schema-dir", catalogs, *[x for h in HEADINGS for x in ("--heading", h)]]
    assert main(args, spark) == 0 and "VALIDATE=PASS findings=0" in capsys.readouterr().out
    out = f"file://{tmp_path}/out"
    build = ["--knowledge-dir", docs, "--batch-id", "B1", "--output-dir", out]
    assert main(["check", *build], spark) == 1 and "CHECK=FAIL MISSING edges.jsonl" in capsys.readouterr().out
    assert main(["build", *build], spark) == 0 and "BUILD=PASS nodes=2 edges=1 evidence=2" in capsys.readouterr().out
    assert main(["check", *build], spark) == 0
    folder(tmp_path, {"parasites/p.md": markdown(entity("parasite.p", "parasite", [relation("host.gone", relation_status="draft")]))})
    assert main(args, spark) == 1 and "VALIDATE=FAIL" in capsys.readouterr().out
    assert main(["build", *build], spark) == 1 and "BUILD=FAIL relation is not reviewed" in capsys.readouterr().out
    (tmp_path / "schema" / "entity-types.yml").unlink()
    assert main(args, spark) == 2


def test_no_batch_is_one_row(spark):
    """The plan of the intake query collects a batch's atoms by key range and never all of them into one list."""
    from factloom.plans.gate_checks import intake_findings

    plan = intake_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [collect_list" not in plan and "collect_list" in plan
