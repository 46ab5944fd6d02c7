"""The operations as plain calls on folders and objects, for scripts and tests."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_hash, canonical_json
from factloom.functions.json_schema import check_schema
from factloom.functions.json_schema import validate as schema_validate
from factloom.operators import artifacts, contract, corpus, evaluate, gates, graph, integrity, knowledge_rules, rules
from factloom.sources import documents

canonical_sha256 = canonical_hash


def build_graph(spark: SparkSession, folder: str, batch: str) -> graph.Graph:
    """The graph of a batch of the documents below a folder."""
    return graph.build(documents.read_documents(spark, folder), batch)


def extend_graph(spark: SparkSession, base: graph.Graph, folder: str, extensions: str, batch: str, catalogs: list[str]) -> graph.Graph:
    """A base graph with a later batch; catalogs are the texts that its digest takes in, in order."""
    rows = spark.createDataFrame(list(enumerate(catalogs)), "ordinal int, text string")
    return graph.extend(base, documents.read_documents(spark, folder), documents.read_extensions(spark, extensions), batch, rows)


def render_artifacts(built: graph.Graph, title: dict[str, Any], boundary: dict[str, Any]) -> dict[str, bytes]:
    return artifacts.graph_artifacts(built, title, boundary)


def check_artifacts(spark: SparkSession, folder: str, expected: dict[str, bytes], normalise_eol: bool = False) -> DataFrame:
    """(name, status) of the names that aren't OK."""
    found = artifacts.drift(artifacts.digests(spark, expected, normalise_eol), artifacts.stored(spark, folder, normalise_eol))
    return found.where("status <> 'OK'")


def validate_knowledge(spark: SparkSession, folder: str, registry: str, vocabulary: knowledge_rules.Vocabulary) -> DataFrame:
    """All findings of a folder's documents and a source registry file's folder."""
    found, sources = knowledge_rules.check_registry(documents.read_yaml(spark, registry), vocabulary)
    return found.unionByName(knowledge_rules.check_documents(documents.read_documents(spark, folder), vocabulary, sources))


def load_vocabulary(spark: SparkSession, folder: str, headings: list[str]) -> knowledge_rules.Vocabulary:
    """From entity-types.yml, relation-types.yml and source-types.yml in a folder."""
    found = {r.name: r for r in documents.read_yaml(spark, folder, recursive=False).collect()}
    parsed = []
    for name in ("entity-types.yml", "relation-types.yml", "source-types.yml"):
        if name not in found or found[name].parse_error:
            raise ValueError(f"{name}: {found[name].parse_error if name in found else 'is missing'}")
        parsed.append(json.loads(found[name].meta))
    return knowledge_rules.Vocabulary.of(*parsed, headings)


def validate_instance(value: Any, schema: Any) -> None:
    """Raise with the first problem of a request, response, audit or adjudication object."""
    if bad := check_schema(schema):
        raise ValueError(f"schema {bad[0][0]}: {bad[0][2]}")
    if bad := schema_validate(value, schema):
        raise ValueError(f"{bad[0][0] or '/'} {bad[0][2]}")


validate_request_instance = validate_adjudication_record_instance = validate_instance


@dataclass(frozen=True)
class Authority:
    """What answers are held against; see operators.contract for the columns."""

    claims: DataFrame  # claim_id, entity_ids, evidence, render_text
    sources: DataFrame  # source_id, title
    required_qualifiers: DataFrame  # claim_id, qualifiers
    gaps: DataFrame  # gap_code, text
    notices: DataFrame  # claim_id, notice
    contract_id: str
    request_version: str
    request_schema: Any = None
    response_schema: Any = None

    def responses(self, value: Any) -> DataFrame:
        record = self.claims.sparkSession.createDataFrame([(canonical_json(value),)], "record string")
        return contract.responses_of(record.withColumn("sha256", F.lit(canonical_hash(value))))


def _raise_first(found: DataFrame) -> None:
    for r in found.orderBy("rule", "message").limit(1).collect():
        raise ValueError(f"{r.rule}: {r.message}")


def validate_response_instance(value: Any, schema: Any, authority: Authority | None = None, request: Any = None) -> None:
    """Raise with the first problem of a response: by its schema and, given an authority, by claims, citations, units and rendering."""
    validate_instance(value, schema)
    if authority is None:
        return
    asked = request if request is not None else value  # without a request only the response speaks
    requests = authority.claims.sparkSession.createDataFrame([(asked["request_id"], asked["knowledge_version"])], "request_id string, knowledge_version string")
    responses = authority.responses(value)
    rendered = contract.render_answers(responses, authority.claims, authority.gaps, authority.notices)
    _raise_first(contract.response_violations(responses, requests, authority.claims, authority.sources, authority.required_qualifiers, rendered, authority.contract_id))


AUDIT = "audit_id string, request_id string, request_sha256 string, request_schema_version string, response_sha256 string, hash_verified boolean, bundle_sha256 string, candidate_claim_ids array<string>, admitted_claim_ids array<string>, disposition string, material_claim_ids array<string>, coverage_gaps array<string>, result string, hard_fail_codes array<string>, citation_count int"


def _audit_row(a: Any) -> tuple:
    bound, found, decided, shown = a["knowledge_authority"], a["retrieval"], a["decision"], a["output_validation"]
    gaps = [g["gap_code"] if isinstance(g, dict) else g for g in decided["coverage_gaps"]]
    return (
        a["audit_id"], a["request_id"], a["request_sha256"], a["request_schema_version"], a.get("response_sha256"), bound["hash_verified"], bound.get("runtime_bundle_sha256"), found["candidate_claim_ids"], found["admitted_claim_ids"],
        decided["disposition"], decided["material_claim_ids"], gaps, shown["result"], shown["hard_fail_codes"], shown["student_visible_citation_count"],
    )


def validate_audit_instance(value: Any, schema: Any, request: Any = None, response: Any = None, authority: Authority | None = None) -> None:
    """Raise with the first problem of an audit: by its schema and, given an authority, by its binding to the request and response objects.

    An audit can't be bound without its request, nor without its response where it says that there is one.
    """
    validate_instance(value, schema)
    if authority is None:
        return
    if request is None:
        raise ValueError("the request object is needed")
    if authority.request_schema is not None:
        validate_request_instance(request, authority.request_schema)
    if response is None and (value.get("response_sha256") is not None or value["decision"]["disposition"] in contract.SERVED):
        raise ValueError("the response object is needed")
    spark = authority.claims.sparkSession
    if response is not None:
        validate_response_instance(response, authority.response_schema if authority.response_schema is not None else True, authority, request)
        responses = authority.responses(response)
    else:
        responses = spark.createDataFrame([], contract.RESPONSE).withColumn("sha256", F.lit(None).cast("string"))
    requests = spark.createDataFrame([(request["request_id"], canonical_hash(request), request["schema_version"])], "request_id string, sha256 string, schema_version string")
    _raise_first(contract.audit_violations(spark.createDataFrame([_audit_row(value)], AUDIT), requests, responses, authority.request_version, authority.claims))


def validate_protocol_data(tables: rules.Tables, **expected: Any) -> None:
    rules.require(gates.protocol(**expected), tables)


def validate_run_structure(tables: rules.Tables) -> dict[str, int]:
    """Raise on the first structural problem of a run, else its scores."""
    rules.require(gates.run(), tables)
    return evaluate.score_run(tables["responses"], tables["cases"], tables["edges"]).first().asDict()


def verify_runtime_bundle(manifest: DataFrame, files: DataFrame) -> None:
    for r in integrity.verify_bundle(manifest, files).orderBy("path").limit(1).collect():
        raise ValueError(f"{r.path}: {r.problem}")


def regression_report(suite_id: str, graph_sha256: str, cases: DataFrame, claims: DataFrame, boundaries: DataFrame, excluded: DataFrame, flags: dict[str, bool], note: str) -> dict[str, Any]:
    """The report of a fixed suite, in the order in which it is written.

    cases: (case_id, expected_disposition, required_claim_ids), in order of case_id in the report. boundaries: what
    evaluate.boundary_failures gives. excluded: what evaluate.excluded_terms gives.
    """
    rows = evaluate.regression(cases, claims).join(cases.select("case_id", "required_claim_ids"), "case_id").orderBy("case_id").collect()
    broken = [f"{r.claim_id}: {r.key}: {r.problem}" for r in boundaries.orderBy("claim_id", "key").collect()]
    entered = [f"{r.claim_id}: excluded term {r.term}" for r in excluded.orderBy("claim_id", "term").collect()]
    failures = broken + [f"{r.case_id}: missing {', '.join(r.missing)}" for r in rows if r.missing] + entered
    verdict = lambda bad: "FAIL" if bad else "PASS"
    passed = sum(r.status == "PASS" for r in rows)
    return {
        "report_version": "1.0", "suite_id": suite_id, "status": verdict(failures), "canonical_graph_sha256": graph_sha256, "counts": {"cases": len(rows), "passed": passed, "failed": len(rows) - passed},
        "case_results": [{"case_id": r.case_id, "expected_disposition": r.expected_disposition, "result": r.status, "required_claim_ids": list(r.required_claim_ids), "missing_claim_ids": list(r.missing)} for r in rows],
        "boundary_checks": {"required_qualifiers": verdict(broken), "excluded_terms": verdict(entered), **flags}, "failures": failures, "interpretation_boundary": note,
    }


def write_report(spark: SparkSession, folder: str, name: str, report: dict[str, Any]) -> None:
    artifacts.write(spark, folder, {name: artifacts.yaml_bytes(report)})


def report_is_current(spark: SparkSession, folder: str, name: str, report: dict[str, Any]) -> bool:
    """Whether the written report says the same; line ends don't count."""
    found = check_artifacts(spark, folder, {name: artifacts.yaml_bytes(report)}, normalise_eol=True)
    return found.where(F.col("name") == name).isEmpty()


CASE = "array<struct<case_id:string,category:string,expected_disposition:string,required_claim_ids:array<string>,required_entity_ids:array<string>,required_relation_atom_ids:array<string>,coverage_gap:string,citation_requirement:string,failure_severity:string>>"
RUN = "struct<run_id:string,suite_id:string,mode:string,status:string,responses:array<struct<case_id:string,disposition:string,answer_text:string,retrieved_entity_ids:array<string>,used_relation_atom_ids:array<string>,cited_source_ids:array<string>,reason_code:string,missing_coverage:array<string>>>>"


def load_one(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The one row of a YAML file in a folder: its metadata as JSON text in `meta`."""
    if not artifacts.exists(spark, f"{folder}/{name}"):
        raise ValueError(f"{name} is missing")
    rows = documents.read_yaml(spark, folder, glob=name, recursive=False)
    for r in rows.where("parse_error IS NOT NULL").limit(1).collect():
        raise ValueError(f"{name}: {r.parse_error}")
    return rows


def load_cases(spark: SparkSession, folder: str, name: str) -> tuple[str, DataFrame]:
    """A suite's id and its cases."""
    suite = load_one(spark, folder, name)
    cases = suite.select(F.inline(F.from_json(F.get_json_object("meta", "$.test_cases"), CASE)))
    return suite.select(F.get_json_object("meta", "$.suite_id")).first()[0], cases


def load_run(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(runs, responses) of a run record."""
    run = load_one(spark, folder, name).select(F.from_json("meta", RUN).alias("r"))
    return run.select("r.run_id", "r.suite_id", "r.mode", "r.status"), run.select(F.inline("r.responses"))


def corpus_files(built: graph.Graph, docs: DataFrame, batch: str, registry: DataFrame, preamble: str) -> dict[str, bytes]:
    """The retrieval corpus, the catalog of its sources and the manifest of both."""
    chosen = graph.in_batch(docs, batch)
    text = corpus.corpus_text(chosen.select(F.col("m.id").alias("id"), "path", "body"), preamble).first()[0]
    catalog = [r.asDict(recursive=True) for r in corpus.source_catalog(built.edges, registry).collect()]
    out = {"corpus.md": text.encode(), "source-catalog.yml": artifacts.yaml_bytes({"sources": catalog})}
    return out | {"manifest.yml": artifacts.manifest({"batch_id": batch, "input_sha256": built.digest.first()[0]}, {"documents": chosen.count(), "sources": len(catalog)}, out, {})}


REGISTERED = "array<struct<source_id:string,source_type:string,title:string,url:string,access_level:string,creators:array<string>,publication_date:string,page_date:string,page_last_reviewed:string>>"


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    return documents.read_yaml(spark, folder).where("parse_error IS NULL").select(F.inline(F.from_json(F.get_json_object("meta", "$.sources"), REGISTERED)))
