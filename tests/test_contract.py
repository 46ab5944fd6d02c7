import copy
import json
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_sha256
from factloom.operators import contract as C
from factloom.operators import evaluate as E
from factloom.operators import integrity as I

EVIDENCE = "array<struct<source_id:string,locator:string,evidence_type:string>>"
GOOD = {
    "schema_version": "1", "request_id": "r1", "knowledge_version": "k1", "source_commit": "c", "runtime_bundle_sha256": "b", "disposition": "PARTIAL", "answer_text": "Text one\nNote\nGap text",
    "answer_units": [{"unit_id": "u1", "unit_type": "MATERIAL_CLAIM", "claim_id": "C1", "citation_ids": ["x1"]}, {"unit_id": "u2", "unit_type": "COVERAGE_GAP", "gap_code": "G1"}],
    "material_claims": [{"claim_id": "C1", "entity_ids": ["b", "a"], "qualifiers": {"role": "x"}}], "citations": [{"citation_id": "x1", "claim_id": "C1", "source_id": "s1", "source_label": "Title", "locator": "p1", "visible_to_student": True}],
    "coverage_gaps": [{"gap_code": "G1"}], "validation": {"result": "PASS", "checked_contract_id": "K", "hard_fail_codes": []},
}


@pytest.fixture(scope="module")
def context(spark):
    claims = spark.createDataFrame([("C1", ["a", "b"], [("s1", "p1", "d")], "Text one"), ("C2", ["a"], [("s1", "p2", "d")], "Text two")], f"claim_id string, entity_ids array<string>, evidence {EVIDENCE}, render_text string")
    return {
        "claims": claims, "requests": spark.createDataFrame([("r1", "k1")], "request_id string, knowledge_version string"), "sources": spark.createDataFrame([("s1", "Title")], "source_id string, title string"),
        "required": spark.createDataFrame([("C1", '{"role":"x"}')], "claim_id string, qualifiers string"), "gaps": spark.createDataFrame([("G1", "Gap text")], "gap_code string, text string"), "notices": spark.createDataFrame([("C1", "Note")], "claim_id string, notice string"),
    }


def violations(spark, context, responses):
    df = C.responses_of(spark.createDataFrame([(json.dumps(r),) for r in responses], "record string"))
    rendered = C.render_answers(df, context["claims"], context["gaps"], context["notices"])
    found = C.response_violations(df, context["requests"], context["claims"], context["sources"], context["required"], rendered, "K")
    return {(r.key, r.rule) for r in found.collect()}


def change(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def test_good_response(spark, context):
    assert violations(spark, context, [GOOD]) == set()


MUTATIONS = [
    (("knowledge_version",), "k2", "knowledge_version"), (("answer_text",), "Text", "answer_text"), (("citations", 0, "source_label"), "T", "citation_label"), (("citations", 0, "locator"), "p9", "citation_evidence"), (("citations", 0, "visible_to_student"), False, "citation_visible"),
    (("citations", 0, "claim_id"), "C2", "citation_claim"), (("material_claims", 0, "claim_id"), "C9", "claim_known"), (("material_claims", 0, "entity_ids"), ["a"], "claim_entities"), (("material_claims", 0, "qualifiers"), {}, "claim_qualifiers"), (("citations",), [], "claim_cited"),
    (("answer_units", 0, "citation_ids"), ["x1", "x1"], "units_citations"), (("answer_units", 0, "claim_id"), "C2", "unit_citation"), (("answer_units", 1, "gap_code"), "G2", "units_gaps"), (("validation", "checked_contract_id"), "L", "contract"), (("answer_units", 1, "unit_id"), "u1", "units_distinct"),
    (("material_claims",), GOOD["material_claims"] * 2, "claims_distinct"), (("citations",), GOOD["citations"] * 2, "citations_distinct"),
]


def test_rendering_and_qualifiers(spark, context):
    """A notice is a line of its own; qualifiers are mappings; other words for unit types can be given."""
    df = C.responses_of(spark.createDataFrame([(json.dumps(GOOD),)], "record string"))
    assert C.render_answers(df, context["claims"], context["gaps"], context["notices"]).first().rendered == "Text one\nNote\nGap text"
    spaced = context | {"required": spark.createDataFrame([("C1", ' { "role" : "x" } ')], "claim_id string, qualifiers string")}
    assert violations(spark, spaced, [GOOD]) == set()
    told = json.dumps(GOOD).replace("MATERIAL_CLAIM", "claim")
    df = C.responses_of(spark.createDataFrame([(told,)], "record string"))
    assert C.render_answers(df, context["claims"], context["gaps"], context["notices"], claim_unit="claim").first().rendered == "Text one\nNote\nGap text"


def test_mutated_responses(spark, context):
    changed = [change(path, value) | {"request_id": f"r{k}"} for k, (path, value, _) in enumerate(MUTATIONS, 2)]
    wider = context | {"requests": spark.createDataFrame([(f"r{k}", "k1") for k in range(1, len(MUTATIONS) + 2)], "request_id string, knowledge_version string")}
    found = violations(spark, wider, changed)
    for k, (_, _, rule) in enumerate(MUTATIONS, 2):
        assert (f"r{k}", rule) in found, rule
    assert ("r99", "request_known") in violations(spark, context, [GOOD | {"request_id": "r99"}])


def test_audit(spark):
    request = json.dumps({"request_id": "r1", "knowledge_version": "k1"})
    requests = spark.createDataFrame([("r1", request, "1")], "request_id string, record string, schema_version string").withColumn("sha256", canonical_sha256(F.col("record")))
    responses = C.responses_of(spark.createDataFrame([(json.dumps(GOOD),)], "record string").withColumn("sha256", canonical_sha256(F.col("record"))))
    q, a = requests.first().sha256, responses.first().sha256
    good = ("a1", "r1", q, "1", a, True, "b", ["C1", "C2"], ["C1"], "PARTIAL", ["C1"], ["G1"], "PASS", [], 1)
    names = "audit_id request_id request_sha256 request_schema_version response_sha256 hash_verified bundle_sha256 candidate_claim_ids admitted_claim_ids disposition material_claim_ids coverage_gaps result hard_fail_codes citation_count".split()
    mutations = {"request_known": (1, "zz"), "request_hash": (2, "x"), "request_version": (3, "2"), "response_hash": (4, "x"), "unverified": (5, False), "bundle": (6, "z"), "admitted_subset": (7, []), "decided_subset": (8, []), "disposition": (9, "ANSWER"), "claims": (10, []), "gaps": (11, []), "result": (12, "FAIL"), "codes": (13, ["X"]), "citation_count": (14, 3)}
    rows = [good] + [(f"m_{n}", *good[1:i], v, *good[i + 1 :]) for n, (i, v) in mutations.items()]
    schema = ", ".join(f"{n} {'boolean' if n == 'hash_verified' else 'int' if n == 'citation_count' else 'array<string>' if n.endswith(('ids', 'gaps', 'codes')) else 'string'}" for n in names)
    found = {}
    for r in C.audit_violations(spark.createDataFrame(rows, schema), requests, responses, "1").collect():
        found.setdefault(r.key, set()).add(r.rule)
    assert "a1" not in found
    known = spark.createDataFrame([("C2",)], "claim_id string")
    assert ("a1", "admitted_known") in {(r.key, r.rule) for r in C.audit_violations(spark.createDataFrame(rows, schema), requests, responses, "1", known).collect()}
    few = [("few", *good[1:14], 0), ("none", *good[1:9], "ABSTAIN", *good[10:14], 0)]
    cover = {(r.key, r.rule) for r in C.audit_violations(spark.createDataFrame(few, schema), requests, responses, "1").collect() if r.rule == "citations_cover"}
    assert cover == {("few", "citations_cover")}
    for n in mutations:
        assert ("citations" if n == "citation_count" else n) in found[f"m_{n}"], n


EDGE = f"subject string, predicate string, object string, statement_zh string, relation_status string, evidence {EVIDENCE}, qualifiers string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "p", "b", "one", "reviewed", [("s1", "l", "d")], '{"source_atom_id":"A1","role":"x"}'), ("b", "p", "c", "two bad", "reviewed", [("s2", "l", "background_only")], '{"source_atom_id":"A2"}')], EDGE)


def test_regression_and_boundaries(spark, edges):
    cases = spark.createDataFrame([("1", "ANSWER", ["A1"]), ("2", "ANSWER", ["A2", "A9", "A8"]), ("3", "ABSTAIN", [])], "case_id string, expected_disposition string, required_claim_ids array<string>")
    claims = E.claim_universe(edges.select(F.get_json_object("qualifiers", "$.source_atom_id").alias("claim_id")), spark.createDataFrame([("N1",)], "claim_id string"))
    results = E.regression(cases, claims)
    assert {r.case_id: (r.status, r.missing) for r in results.collect()} == {"1": ("PASS", []), "2": ("FAIL", ["A8", "A9"]), "3": ("PASS", [])}
    assert tuple(E.regression_totals(results).first()) == (3, 2, 1)
    expected = spark.createDataFrame([("A1", "role", "x"), ("A1", "other", "y"), ("A2", "role", "x"), ("A7", "role", "x"), ("A1", "role", "z")], "claim_id string, key string, value string")
    assert sorted(tuple(r) for r in E.boundary_failures(expected, edges).collect()) == [("A1", "other", "qualifier is missing"), ("A1", "role", "qualifier differs"), ("A2", "role", "qualifier is missing"), ("A7", "role", "edge is missing")]
    assert [tuple(r) for r in E.excluded_terms(edges, spark.createDataFrame([("bad",)], "term string")).collect()] == [("A2", "bad")]


def test_claim_records(spark, edges):
    narrative = spark.createDataFrame([("A2", ["z"], [("s", "l", "d")], "told")], f"claim_id string, entity_ids array<string>, evidence {EVIDENCE}, render_text string")
    supporting = spark.createDataFrame([("S1", "A1")], "claim_id string, host_claim_id string")
    got = {r.claim_id: (r.entity_ids, r.qualifiers, r.render_text) for r in E.claim_records(edges, narrative, supporting).collect()}
    assert got == {"A1": (["a", "b"], '{"source_atom_id":"A1","role":"x"}', "one"), "A2": (["z"], "{}", "told"), "S1": (["a", "b"], "{}", "one")}


def test_protocol_and_scores(spark, edges):
    schema = "case_id string, expected_disposition string, required_entity_ids array<string>, required_relation_atom_ids array<string>, coverage_gap string, citation_requirement string, failure_severity string"
    cases = spark.createDataFrame([("1", "ANSWER", ["a"], ["A1"], None, "c", "high"), ("2", "PARTIAL", ["b"], ["A2"], "gap", "c", "high"), ("3", "ABSTAIN", [], [], "gap", "c", "high")], schema)
    assert E.disposition_contract(cases).count() == 0
    bad = spark.createDataFrame([("1", "ANSWER", [], [], None, "c", "h"), ("2", "PARTIAL", ["b"], [], None, "c", "h"), ("3", "ABSTAIN", [], [], "", "c", "h"), ("4", "X", [], [], None, "c", "h"), ("5", "ANSWER", ["a"], [], None, None, "h"), ("6", "ANSWER", ["a"], [], "g", "c", "h")], schema)
    assert E.disposition_contract(bad).count() == 6
    assert {tuple(r) for r in E.suite_coverage(cases, spark.createDataFrame([("A1",), ("A3",)], "id string"), "required_relation_atom_ids").collect()} == {("A3", "missing"), ("A2", "extra")}
    assert [tuple(r) for r in E.leakage(cases, spark.createDataFrame([("A2",)], "atom_id string")).collect()] == [("2", "A2")]
    responses = spark.createDataFrame([("1", "ANSWER", ["A1"], ["s1"]), ("2", "PARTIAL", ["A2"], ["s1"]), ("3", "ABSTAIN", [], [])], "case_id string, disposition string, used_relation_atom_ids array<string>, cited_source_ids array<string>")
    assert tuple(E.score_run(responses, cases, edges).first()) == (3, 3, 2, 1)
    scores = spark.createDataFrame([("1", "rag", 9.0, False, True, True, True), ("2", "rag", 9.0, True, False, True, False), ("1", "baseline", 6.0, False, False, False, True)], "case_id string, mode string, score double, hard_fail boolean, traceable boolean, abstained_right boolean, is_boundary boolean")
    got = {r.metric: (r.value, r.met) for r in E.score_gates(scores, {"pass_rate": 0.9, "boundary_abstention": 1.0, "mean_score": 8.5, "delta": 10}).collect()}
    assert got == {"pass_rate": (0.5, False), "boundary_abstention": (1.0, True), "mean_score": (9.0, True), "delta": (12.0, True)}
    runs = spark.createDataFrame([("a", k, "h") for k in range(3)] + [("b", k, str(k)) for k in range(3)], "request_id string, run int, response_sha256 string")
    assert {r.request_id: r.stable for r in E.stable_runs(runs).collect()} == {"a": True, "b": False}
    assert E.rubric_points(spark.createDataFrame([("a", 4), ("b", 6)], "criterion string, points int"), 10).count() == 0


def test_integrity(spark, edges):
    import hashlib

    data = b"abc"
    manifest = [("ok", 3, hashlib.sha256(data).hexdigest(), hashlib.sha1(b"blob 3\0abc").hexdigest()), ("size", 4, "", ""), ("hash", 3, "x", ""), ("blob", 3, hashlib.sha256(data).hexdigest(), "x"), ("gone", 1, "", "")]
    files = spark.createDataFrame([(n, 3, data) for n in ("ok", "size", "hash", "blob")], "path string, bytes bigint, content binary")
    got = {r.path: r.problem for r in I.verify_bundle(spark.createDataFrame(manifest, "path string, size_bytes bigint, sha256 string, source_blob_sha1 string"), files).collect()}
    assert got == {"size": "size differs", "hash": "sha256 differs", "blob": "blob id differs", "gone": "file is missing"}
    atoms, classes = spark.createDataFrame([("1",), ("2",), ("3",)], "atom_id string"), spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "b"), ("9", "a")], "atom_id string, class string")
    assert {tuple(r) for r in I.partition_problems(atoms, classes).collect()} == {("2", "repeated"), ("3", "missing"), ("9", "extra")}
    assert [r["class"] for r in I.declared_counts(spark.createDataFrame([("a", 2, ["x"]), ("b", 1, ["y"])], "class string, count int, atom_ids array<string>")).collect()] == ["a"]
    batches = spark.createDataFrame([("B1", ["1"], None), ("B2", ["2"], ["3"]), ("B3", None, None)], "batch_id string, edge_atom_ids array<string>, qualifier_atom_ids array<string>")
    assert {r[0] for r in I.other_atoms(batches, "B1").collect()} == {"2", "3"} and I.first_batch(batches, "B9").count() == 0
    assert {tuple(r) for r in I.implementation_problems(atoms, spark.createDataFrame([("1",), ("1",), ("4",)], "atom_id string"), "atom_id").collect()} == {("2", "missing"), ("3", "missing"), ("4", "extra"), ("1", "repeated")}
    stored = spark.createDataFrame([("a", "p", "b", "reviewed", "A1", "s1"), ("b", "p", "c", "reviewed", "A2", "sX")], "subject string, predicate string, object string, relation_status string, source_atom_id string, evidence_source_ids string")
    assert I.triples_differ(stored, edges).count() == 2
    assert [r.subject for r in I.background_only(edges).collect()] == ["b"]
    assert [tuple(r) for r in I.lacking_qualifiers(edges, spark.createDataFrame([("p", "role")], "predicate string, key string")).collect()] == [("A2", "p", "role")]
    assert [r.name for r in I.all_true(spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, value boolean")).orderBy("name").collect()] == ["b", "c"]
    moved = spark.createDataFrame([("p1", "c1", "h1", "ANSWER"), ("p2", "c1", "h2", "ANSWER"), ("p3", "c9", "h", "ANSWER"), ("p4", "c1", "h1", "ABSTAIN")], "p9_case_id string, source_case_id string, source_case_sha256 string, expected_disposition string")
    assert {r.p9_case_id for r in I.migration_problems(moved, spark.createDataFrame([("c1", "h1", "ANSWER")], "case_id string, sha256 string, expected_disposition string")).collect()} == {"p2", "p3", "p4"}
    candidates = spark.createDataFrame([("a", "fact", True), ("b", None, True), ("c", None, False)], "class string, statement_type string, is_present boolean")
    assert {r["class"]: r.status for r in I.self_check(candidates).collect()} == {"a": "PASS", "b": "FAIL", "c": "NOT_APPLICABLE"}


def test_reviewers(spark):
    schema = "reviewer_id string, completion_status string, metadata_valid boolean, all_required_case_scores_present boolean, top_level_conclusion string, release_recommendation string, defects array<string>, critical_disagreement struct<status:string>"
    good = ["COMPLETE", True, True, "PASS", "RECOMMEND_RELEASE", None, None]
    rows = [("ok", *good), ("settled", *good[:5], ["OTHER"], ("RESOLVED",)), ("critical", "COMPLETE", True, True, "FAIL", "DO_NOT_RELEASE", [], None)]
    for k, v in enumerate(["PARTIAL", False, None, "PENDING", "PENDING", ["ALL_REQUIRED_CASE_SCORES_MISSING"], ("UNRESOLVED_REQUIRES_ADJUDICATION",)]):
        rows.append((f"bad{k}", *good[:k], v, *good[k + 1 :]))
    records = spark.createDataFrame(rows, schema)
    assert [r.reviewer_id for r in records.where(I.eligible()).collect()] == ["ok", "settled", "critical"]
    assert [r.reviewer_id for r in I.release_blocked(records).collect()] == ["bad6"]


def test_audit_stream(spark, tmp_path):
    from factloom.streaming.audit_stream import by_window, checked, record_stream

    (tmp_path / "in").mkdir()
    lines = [json.dumps({"request_id": str(k), "started_at": f"2024-01-01T00:0{k}:00Z", "decision": {"disposition": "ANSWER"}} | ({} if k else {"extra": 1})) for k in range(6)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    schema = {"type": "object", "properties": {"request_id": {}, "started_at": {}, "decision": {}}, "additionalProperties": False}
    rows = by_window(checked(record_stream(spark, f"file://{tmp_path}/in"), schema))
    q = rows.writeStream.outputMode("complete").format("memory").queryName("audits").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.window.start.minute, r.records, r.invalid) for r in spark.table("audits").collect()}
    assert got == {(0, 5, 1), (5, 1, 0)}


def test_arrays_of_responses_are_not_joined(spark):
    """Rules within a response are told without a shuffle; only its id, version and text meet requests and renderings."""
    from factloom.plans.queries import QUERIES

    for name in ("response_findings", "response_structure_findings"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        joins, todo = [], [plan]
        while todo:
            node = todo.pop()
            joins += [node] if node.nodeName() == "Join" else []
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
        names = {a.split("#")[0] for j in joins for a in j.output().mkString(" ").split(" ")}
        assert joins and not names & {"answer_units", "material_claims", "citations", "coverage_gaps", "es"}


def test_tables_that_grow_with_responses_are_not_broadcast(spark):
    """Requests, renderings, claims and places are dealt by their keys at any size; only the list of sources may be broadcast."""
    from factloom.plans.queries import QUERIES

    df = QUERIES["response_structure_findings"](spark, "/root/testdata/sf0.001")
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()  # of the run, with what was planned anew on the way
    assert "isFinalPlan=true" in plan and plan.count("SortMergeJoin") >= 5
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan)) <= {"source_id"}
