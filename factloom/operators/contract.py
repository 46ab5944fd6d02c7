"""Admissibility of answers and the binding of audit records.

Requests, responses and audits are typed rows after their schema check (functions.json_schema). Every rule gives rows
(response or audit id, rule, message); an empty result admits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.canonical import json_equal
from factloom.functions.text import is_subset, same_multiset, same_set
from factloom.operators.model import S, struct


#: Fixed values of the response format: the unit types.
CLAIM_UNIT, GAP_UNIT = "MATERIAL_CLAIM", "COVERAGE_GAP"
#: Dispositions that serve claims.
SERVED = ("ANSWER", "PARTIAL")

UNIT = struct(unit_id=S, unit_type=S, claim_id=S, citation_ids=T.ArrayType(S), gap_code=S)
CLAIM = struct(claim_id=S, entity_ids=T.ArrayType(S), qualifiers=S)
CITATION = struct(citation_id=S, claim_id=S, source_id=S, source_label=S, locator=S, visible_to_student=T.BooleanType())
RESPONSE = struct(
    schema_version=S, request_id=S, knowledge_version=S, source_commit=S, runtime_bundle_sha256=S, disposition=S, answer_text=S, answer_units=T.ArrayType(UNIT), material_claims=T.ArrayType(CLAIM),
    citations=T.ArrayType(CITATION), coverage_gaps=T.ArrayType(struct(gap_code=S)), validation=struct(result=S, checked_contract_id=S, hard_fail_codes=T.ArrayType(S)),
)


def responses_of(records: DataFrame, column: str = "record") -> DataFrame:
    """Typed responses from JSON text, with `sha256` if the records have one."""
    return records.withColumn("r", F.from_json(column, RESPONSE)).select("r.*", *[c for c in records.columns if c == "sha256"])


def render_answers(responses: DataFrame, claims: DataFrame, gaps: DataFrame, notices: DataFrame, claim_unit: str = CLAIM_UNIT) -> DataFrame:
    """(request_id, rendered): the lines of all units in order. A claim's line is followed by the line of its notice, if it has one.

    claims: (claim_id, render_text). gaps: (gap_code, text). notices: (claim_id, notice). Units of another type than claim_unit are gaps.
    """
    units = responses.select("request_id", F.posexplode("answer_units").alias("place", "u")).select("request_id", "place", "u.unit_type", "u.claim_id", "u.gap_code")
    told = units.join(claims.select("claim_id", "render_text"), "claim_id", "left").join(notices, "claim_id", "left").join(F.broadcast(gaps), "gap_code", "left")
    of_claim = F.array_compact(F.array(F.coalesce("render_text", F.lit("")), "notice"))
    lines = F.when(F.col("unit_type") == claim_unit, of_claim).otherwise(F.array(F.coalesce("text", F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct("place", lines.alias("lines"))))
    joined = told.groupBy("request_id").agg(F.array_join(F.flatten(F.transform(parts, lambda p: p["lines"])), "\n").alias("rendered"))
    return responses.select("request_id").join(joined, "request_id", "left").select("request_id", F.coalesce("rendered", F.lit("")).alias("rendered"))


def _findings(rows: DataFrame, key: str, checks: list[tuple[str, Column | str, Column]], many: list[tuple[str, Column]] | None = None) -> DataFrame:
    """(key, rule, message) of rows, in one pass. checks: rule, message and when it is broken; many: rule and an array of messages."""
    text = lambda m: F.lit(m) if isinstance(m, str) else m
    one = lambda rule, message: F.struct(F.lit(rule).alias("rule"), message.alias("message"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), one(rule, text(message))) for rule, message, when in checks]))
    if many:
        each = lambda rule: lambda m: one(rule, m)
        found = F.flatten(F.array(found, *[F.transform(F.coalesce(messages, F.array().cast("array<string>")), each(rule)) for rule, messages in many]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("f")).select("key", "f.rule", "f.message")


def response_violations(responses: DataFrame, requests: DataFrame, claims: DataFrame, sources: DataFrame, required_qualifiers: DataFrame, rendered: DataFrame, contract_id: str, claim_unit: str = CLAIM_UNIT, gap_unit: str = GAP_UNIT) -> DataFrame:
    """(key, rule, message) of responses that must not be served.

    claims: (claim_id, entity_ids, evidence). sources: (source_id, title). required_qualifiers: (claim_id, qualifiers JSON); other claims send {}.
    Qualifiers are compared as mappings, whatever their order and spacing. Rules within a response look at its own arrays, without a shuffle;
    claims and citations are exploded once each, for what they need from other tables, and whole responses meet no table.
    Tables that grow with the responses are dealt by their keys: sizes of compressed files say little of their rows, and a broadcast passes all of them through the driver.
    """
    r = responses
    growing = lambda t: t.hint("merge")
    ids = lambda c, f: F.transform(c, lambda x: x[f])
    has = lambda values, x: F.coalesce(F.array_contains(values, x), F.lit(False))
    claim_units = F.filter("answer_units", lambda u: u["unit_type"] == claim_unit)
    gap_units = F.filter("answer_units", lambda u: u["unit_type"] == gap_unit)

    def misplaced(unit: Column) -> Column:
        """A unit's citations that are of another claim, or of none."""

        def each(cited: Column) -> Column:
            same = F.filter("citations", lambda c: c["citation_id"] == cited)
            wrong = F.filter(same, lambda c: ~F.coalesce(c["claim_id"] == unit["claim_id"], F.lit(False)))
            return F.array_repeat(cited, F.when(F.size(same) == 0, 1).otherwise(F.size(wrong)))

        return F.flatten(F.transform(unit["citation_ids"], each))

    slim = r.select("request_id", "knowledge_version", "answer_text")  # arrays stay where they are
    asked = slim.join(growing(requests.select("request_id", F.col("knowledge_version").alias("asked_version"))), "request_id", "left").join(growing(rendered), "request_id", "left")
    of_requests = _findings(
        asked,
        "request_id",
        [
            ("request_known", "request is unknown", F.col("asked_version").isNull()),
            ("knowledge_version", "knowledge version differs from the request's", F.col("asked_version") != F.col("knowledge_version")),
            ("answer_text", "answer text is not the rendering of its units", F.col("rendered").isNotNull() & ~F.col("answer_text").eqNullSafe(F.col("rendered"))),
        ],
    )
    whole = _findings(
        r,
        "request_id",
        [
            ("claims_distinct", "claim is listed twice", F.size("material_claims") != F.size(F.array_distinct(ids("material_claims", "claim_id")))),
            ("citations_distinct", "citation id is listed twice", F.size("citations") != F.size(F.array_distinct(ids("citations", "citation_id")))),
            ("units_distinct", "unit id is listed twice", F.size("answer_units") != F.size(F.array_distinct(ids("answer_units", "unit_id")))),
            ("units_claims", "units and claims don't correspond one to one", ~same_multiset(ids(claim_units, "claim_id"), ids("material_claims", "claim_id"))),
            ("units_citations", "units and citations don't correspond one to one", ~same_multiset(F.flatten(ids(claim_units, "citation_ids")), ids("citations", "citation_id"))),
            ("units_gaps", "units and gaps don't correspond one to one", ~same_multiset(ids(gap_units, "gap_code"), ids("coverage_gaps", "gap_code"))),
            ("contract", "checked against another contract", F.coalesce(F.col("validation.checked_contract_id") != contract_id, F.lit(True))),
        ],
        [
            ("citation_claim", F.transform(F.filter("citations", lambda c: ~has(ids("material_claims", "claim_id"), c["claim_id"])), lambda c: F.concat(F.lit("citation of a claim that isn't made: "), c["citation_id"]))),
            ("claim_cited", F.transform(F.filter("material_claims", lambda m: ~has(ids("citations", "claim_id"), m["claim_id"])), lambda m: F.concat(m["claim_id"], F.lit(" has no citation")))),
            ("unit_citation", F.transform(F.flatten(F.transform(claim_units, misplaced)), lambda c: F.concat(c, F.lit(" belongs to another claim")))),
            ("citation_visible", F.transform(F.filter("citations", lambda c: ~F.coalesce(c["visible_to_student"], F.lit(False))), lambda c: F.concat(c["citation_id"], F.lit(" is hidden")))),
        ],
    )
    material = r.select("request_id", F.explode("material_claims").alias("c")).select("request_id", "c.*")
    known = claims.select("claim_id", F.col("entity_ids").alias("own"), "evidence")
    stated = material.join(growing(known.select("claim_id", "own")), "claim_id", "left").join(growing(required_qualifiers.select("claim_id", F.col("qualifiers").alias("must"))), "claim_id", "left")
    of_claims = _findings(
        stated,
        "request_id",
        [
            ("claim_known", F.concat(F.lit("unknown claim "), "claim_id"), F.col("own").isNull()),
            ("claim_entities", F.concat(F.lit("entities of "), "claim_id", F.lit(" differ")), F.col("own").isNotNull() & ~same_set(F.col("entity_ids"), F.col("own"))),
            ("claim_qualifiers", F.concat(F.lit("qualifiers of "), "claim_id", F.lit(" differ")), ~json_equal(F.coalesce("qualifiers", F.lit("{}")), F.coalesce("must", F.lit("{}")))),
        ],
    )
    # nearly all places are distinct, so they are dealt before and not held in the tasks that read them
    places = known.select("claim_id", F.explode("evidence").alias("e")).select("claim_id", "e.source_id", "e.locator")
    located = places.repartition("claim_id", "source_id", "locator").distinct().withColumn("there", F.lit(True))
    cited = r.select("request_id", F.explode("citations").alias("c")).select("request_id", "c.citation_id", "c.claim_id", "c.source_id", "c.source_label", "c.locator")
    labels = cited.join(growing(located), ["claim_id", "source_id", "locator"], "left").join(sources.select("source_id", "title"), "source_id", "left")
    of_citations = _findings(
        labels,
        "request_id",
        [
            ("citation_label", F.concat(F.lit("label of "), "citation_id", F.lit(" is not the source's title")), ~F.coalesce(F.col("source_label") == F.col("title"), F.lit(False))),
            ("citation_evidence", F.concat("citation_id", F.lit(" is not among the claim's evidence")), F.col("there").isNull()),
        ],
    )
    return of_requests.unionByName(whole).unionByName(of_claims).unionByName(of_citations)


def audit_violations(audits: DataFrame, requests: DataFrame, responses: DataFrame, contract_version: str, claims: DataFrame | None = None) -> DataFrame:
    """(key, rule, message) of audits that aren't bound to their request and response. claims: (claim_id) of the authority, where it is at hand.

    audits: audit_id, request_id, request_sha256, request_schema_version, response_sha256, hash_verified, bundle_sha256, candidate_claim_ids, admitted_claim_ids,
    disposition, material_claim_ids, coverage_gaps, result, hard_fail_codes, citation_count. requests: request_id, sha256, schema_version.
    responses: typed responses with sha256.
    """
    row = audits.join(requests.select("request_id", F.col("sha256").alias("request_hash"), F.col("schema_version").alias("request_version")), "request_id", "left")
    answer = responses.select(
        F.col("request_id"), F.col("sha256").alias("response_hash"), F.col("disposition").alias("answered"), F.transform("material_claims", lambda c: c["claim_id"]).alias("claims"), F.transform("coverage_gaps", lambda g: g["gap_code"]).alias("gaps"),
        F.size("citations").alias("all_citations"), F.col("runtime_bundle_sha256").alias("bundle"), F.col("validation.result").alias("validated"), F.col("validation.hard_fail_codes").alias("codes"),
    )
    row = row.join(answer, "request_id", "left")
    served = F.col("response_sha256").isNotNull() | F.col("disposition").isin(*SERVED)
    has = F.col("response_hash").isNotNull()
    checks = [
        ("request_known", "request is unknown", F.col("request_hash").isNull()),
        ("request_hash", "request hash differs", F.col("request_hash").isNotNull() & (F.col("request_hash") != F.col("request_sha256"))),
        ("request_version", "request schema version differs", F.col("request_version").isNotNull() & (F.col("request_version") != F.col("request_schema_version"))),
        ("admitted_subset", "a claim was admitted that wasn't retrieved", ~is_subset(F.col("admitted_claim_ids"), F.col("candidate_claim_ids"))),
        ("decided_subset", "a claim was used that wasn't admitted", ~is_subset(F.col("material_claim_ids"), F.col("admitted_claim_ids"))),
        ("citations_cover", "fewer citations than claims", F.col("disposition").isin(*SERVED) & (F.col("citation_count") < F.size(F.array_distinct("material_claim_ids")))),
        ("response_needed", "the response is missing", served & ~has),
        ("response_hash", "response hash differs", has & ~F.col("response_hash").eqNullSafe(F.col("response_sha256"))),
        ("disposition", "disposition differs", has & (F.col("answered") != F.col("disposition"))),
        ("claims", "claims differ", has & ~same_set(F.col("claims"), F.col("material_claim_ids"))),
        ("gaps", "gaps differ", has & ~same_set(F.col("gaps"), F.col("coverage_gaps"))),
        ("citations", "citation count differs", has & (F.col("all_citations") != F.col("citation_count"))),
        ("bundle", "bundle differs", has & (F.col("bundle") != F.col("bundle_sha256"))),
        ("result", "validation result differs", has & (F.col("validated") != F.col("result"))),
        ("codes", "hard failure codes differ", has & ~same_set(F.col("codes"), F.col("hard_fail_codes"))),
        ("unverified", "an unverified bundle must abstain without a response", ~F.col("hash_verified") & (F.col("response_sha256").isNotNull() | (F.col("disposition") != "ABSTAIN"))),
        ("version", "request schema version is not the contract's", F.col("request_schema_version") != contract_version),
    ]
    found = _findings(row, "audit_id", checks)
    if claims is not None:
        admitted = audits.select("audit_id", F.explode(F.array_distinct("admitted_claim_ids")).alias("claim_id"))
        unknown = admitted.join(claims.select("claim_id").distinct(), "claim_id", "left_anti")
        found = found.unionByName(unknown.select(F.col("audit_id").alias("key"), F.lit("admitted_known").alias("rule"), F.concat(F.lit("unknown claim was admitted: "), "claim_id").alias("message")))
    return found
