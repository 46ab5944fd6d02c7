import copy
import json

import pytest

from factloom import api
from factloom.__main__ import main
from factloom.functions.canonical import canonical_hash

from .test_contract import EVIDENCE, GOOD
from .test_documents import entity, folder, good, markdown, relation

REQUEST = {"schema_version": "1", "request_id": "r1", "knowledge_version": "k1", "locale": "en", "query_text": "?"}
AUDIT = {
    "schema_version": "1", "audit_id": "a1", "request_schema_version": "1", "request_id": "r1", "request_sha256": canonical_hash(REQUEST), "response_schema_version": "1", "response_sha256": canonical_hash(GOOD),
    "knowledge_authority": {"runtime_bundle_sha256": "b", "hash_verified": True}, "retrieval": {"candidate_claim_ids": ["C1", "C2"], "admitted_claim_ids": ["C1"], "excluded_candidates": []},
    "decision": {"disposition": "PARTIAL", "reason_codes": [], "material_claim_ids": ["C1"], "coverage_gaps": ["G1"]}, "output_validation": {"result": "PASS", "hard_fail_codes": [], "student_visible_citation_count": 1},
}
ANY = {"type": "object"}


@pytest.fixture(scope="module")
def authority(spark):
    claims = spark.createDataFrame([("C1", ["a", "b"], [("s1", "p1", "d")], "Text one"), ("C2", ["a"], [("s1", "p2", "d")], "Text two")], f"claim_id string, entity_ids array<string>, evidence {EVIDENCE}, render_text string")
    table = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return api.Authority(claims, table([("s1", "Title")], "source_id", "title"), table([("C1", '{"role": "x"}')], "claim_id", "qualifiers"), table([("G1", "Gap text")], "gap_code", "text"), table([("C1", "Note")], "claim_id", "notice"), "K", "1", {"required": ["request_id"]}, ANY)


def changed(value, path, new):
    out = copy.deepcopy(value)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = new
    return out


def test_response_instance(authority):
    api.validate_response_instance(GOOD, ANY, authority, REQUEST)
    api.validate_response_instance(GOOD, ANY, authority)
    for path, new, rule in [(("answer_text",), "x", "answer_text"), (("material_claims", 0, "claim_id"), "C9", "claim_known|citation_claim"), (("citations", 0, "source_label"), "x", "citation_label"), (("answer_units", 0, "unit_type"), "claim", "answer_text|units")]:
        with pytest.raises(ValueError, match=rule):
            api.validate_response_instance(changed(GOOD, path, new), ANY, authority, REQUEST)
    with pytest.raises(ValueError, match="lacks 'zz'"):
        api.validate_response_instance(GOOD, {"required": ["zz"]}, authority)


def test_audit_instance(authority):
    api.validate_audit_instance(AUDIT, ANY, REQUEST, GOOD, authority)
    silent = changed(changed(changed(AUDIT, ("response_sha256",), None), ("decision", "disposition"), "ABSTAIN"), ("decision", "material_claim_ids"), [])
    api.validate_audit_instance(silent, ANY, REQUEST, None, authority)
    with pytest.raises(ValueError, match="request object"):
        api.validate_audit_instance(AUDIT, ANY, None, GOOD, authority)
    with pytest.raises(ValueError, match="response object"):
        api.validate_audit_instance(AUDIT, ANY, REQUEST, None, authority)
    mutations = [
        (("request_sha256",), "x", "request_hash"), (("response_sha256",), "x", "response_hash"), (("retrieval", "candidate_claim_ids"), [], "admitted_subset"), (("retrieval", "admitted_claim_ids"), ["C1", "C2", "C9"], "admitted"), (("decision", "material_claim_ids"), ["C1", "C2"], "citations_cover|claims|decided"),
        (("output_validation", "student_visible_citation_count"), 0, "citations"), (("decision", "disposition"), "ANSWER", "disposition"), (("knowledge_authority", "hash_verified"), False, "unverified"),
    ]
    for path, new, rule in mutations:
        with pytest.raises(ValueError, match=rule):
            api.validate_audit_instance(changed(AUDIT, path, new), ANY, REQUEST, GOOD, authority)


def test_commands(spark, tmp_path, capsys):
    docs, out = folder(tmp_path, good()), f"file://{tmp_path}/out"
    source = {"source_type": "paper", "title": "t", "access_level": "open", "page_date": "2020"}
    registry = folder(tmp_path, {"registry.yml": json.dumps({"sources": [source | {"source_id": f"source.{x}"} for x in "ab"]})}, "registry")
    case = {"case_id": "1", "category": "c", "expected_disposition": "ANSWER", "required_claim_ids": ["A-001"], "required_entity_ids": ["parasite.p", "host.h"], "required_relation_atom_ids": ["A-001"], "citation_requirement": "each", "failure_severity": "high"}
    suite = {"suite_id": "S", "test_cases": [case]}
    answer = {"case_id": "1", "disposition": "ANSWER", "answer_text": "t", "retrieved_entity_ids": ["host.h"], "used_relation_atom_ids": ["A-001"], "cited_source_ids": ["source.a"]}
    record = {"run_id": "R", "suite_id": "S", "mode": "rag", "status": "completed", "responses": [answer]}
    suites = folder(tmp_path, {"suite.yml": json.dumps(suite), "bad.yml": json.dumps({"suite_id": "S", "test_cases": [case | {"required_claim_ids": ["A-009"], "coverage_gap": "g"}]}), "run.yml": json.dumps(record), "late.yml": json.dumps(record | {"status": "started"})}, "suites")
    base, fixed = ["--knowledge-dir", docs, "--batch-id", "B1"], ["--suite-dir", suites, "--suite-file", "suite.yml"]
    told = lambda *args: (main([str(x) for x in args], spark), capsys.readouterr().out)

    assert told("corpus", *base, "--source-registry", registry, "--output-dir", out)[0] == 0
    assert "## parasite.p" in (tmp_path / "out" / "corpus.md").read_text() and "source.b" in (tmp_path / "out" / "source-catalog.yml").read_text()
    assert told("corpus", *base, "--source-registry", registry, "--output-dir", out, "--check")[0] == 0
    assert told("corpus", *base, "--source-registry", registry, "--output-dir", out, "--check", "--preamble", "x")[0] == 1

    report = ["regression", *base, *fixed, "--output-dir", f"file://{tmp_path}/report", "--require", "A-001:flag=true"]
    code, line = told(*report)
    assert code == 0 and "REGRESSION=PASS cases=1 passed=1 failed=0" in line
    assert told(*report, "--check")[0] == 0 and told(*report, "--check", "--exclude", "none at all")[0] == 0
    text = (tmp_path / "report" / "report.yml").read_text()
    (tmp_path / "report" / "report.yml").write_bytes(text.replace("\n", "\r\n").encode())
    assert told(*report, "--check")[0] == 0
    (tmp_path / "report" / "report.yml").write_text(text + "#")
    assert told(*report, "--check") == (1, "REGRESSION=FAIL report is missing or stale\n")
    assert told(*report[:-1], "A-001:flag=no")[0] == 1 and told("regression", *base, "--suite-dir", suites, "--suite-file", "bad.yml", "--output-dir", out)[0] == 1

    run = ["run", *base, *fixed, "--run-dir", suites, "--source-registry", registry, "--run-file"]
    assert told(*run, "run.yml") == (0, "RUN=PASS responses=1 disposition_matches=1 provenance_matches=1 boundary_abstentions=0\n")
    assert told(*run, "late.yml")[0] == 1 and told(*run, "none.yml")[0] == 1
    assert told("protocol", *base, *fixed, "--total", 1, "--case-pattern", "[0-9]")[0] == 0
    assert told("protocol", *base, "--suite-dir", suites, "--suite-file", "bad.yml", "--total", 2)[0] == 1

    later = folder(tmp_path, {"hosts/q.md": markdown(entity("host.q", "host", batch="B2"))}, "later")
    ext = {"schema_version": "1", "extension_id": "extension.1", "extends_entity": "parasite.p", "review_status": "reviewed", "admission": {"batch_id": "B2", "atom_ids": ["A-002"]}, "relations": [relation("host.q", "A-002")], "review": {"reviewed_by": "course_lead", "last_reviewed": "d"}}
    more = folder(tmp_path, {"p.md": markdown(ext)}, "more")
    extend = ["extend", *base, "--later-dir", later, "--later-batch-id", "B2", "--extensions-dir", more, "--catalog", f"{suites}/suite.yml", "--output-dir", f"file://{tmp_path}/wide"]
    code, line = told(*extend)
    assert code == 0 and "EXTEND=PASS nodes=3 edges=2" in line and told(*extend, "--check")[0] == 0
