"""Rule sets for whole releases: admission, intake, authority, protocol, runs, bundles, context, frozen values.

Each function gives rules for operators.rules over named tables, so a gate can report everything or only
what comes first. Counts, patterns and allowed values are arguments or rows, never constants of the code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import dense_ids, full_match, is_blank, leaks
from factloom.operators import evaluate, integrity
from factloom.operators.corpus import unregistered
from factloom.operators.graph import atom_id, coverage, repeated
from factloom.operators.rules import Rule, Tables, expect_counts, expect_values, missing_and_extra, not_in, violation


def rule(name: str, find: Callable[[Tables], DataFrame], locus: str | Column, message: str | Column) -> Rule:
    return Rule(name, lambda t: violation(find(t), F.lit(name), F.col(locus) if isinstance(locus, str) else locus, message))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])


def absent(rows: DataFrame, name: str) -> DataFrame:
    """One row (key) where rows is empty."""
    return rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("key"))


def count_is(rows: DataFrame, wanted: int) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).where(F.col("n") != wanted)


def admission(batch: str) -> list[Rule]:
    """Tables: atoms (atom_id), classes (class, count, atom_ids), batches, documents (id, review_status, reviewed_by), planned_entities and implemented_entities (id), planned_atoms and implemented_atoms (atom_id).

    documents are the batch's, whatever their state: a wrong state is an error here and no reason to leave them out.
    """
    classified = lambda t: t["classes"].select("class", F.explode("atom_ids").alias("atom_id"))
    return [
        rule("declared_count", lambda t: integrity.declared_counts(t["classes"]), "class", "declared count is not the length of the list"),
        rule("partition", lambda t: integrity.partition_problems(t["atoms"], classified(t)), "atom_id", text("atom is ", F.col("problem"))),
        rule("batch_known", lambda t: absent(integrity.first_batch(t["batches"], batch), batch), "key", "batch is not in the plan"),
        rule("documents_reviewed", lambda t: t["documents"].where(~F.coalesce(F.col("review_status") == "reviewed", F.lit(False))), "id", "document of the batch is not reviewed"),
        rule("reviewer", lambda t: t["documents"].where(is_blank(F.col("reviewed_by"))), "id", "document has no reviewer"),
        rule("entities", lambda t: integrity.implementation_problems(t["planned_entities"], t["implemented_entities"], "id"), "id", text("entity is ", F.col("side"))),
        rule("batch_atoms", lambda t: integrity.implementation_problems(t["planned_atoms"], t["implemented_atoms"], "atom_id"), "atom_id", text("atom is ", F.col("side"))),
    ]


def intake(batch: str, patterns: dict[str, str]) -> list[Rule]:
    """Tables: batches, nodes, edges, registry, planned_entities (id), planned_atoms (atom_id), triples, manifest and files (name, sha256, size_bytes), texts (path, text)."""
    atoms = lambda t: t["edges"].select(atom_id().alias("atom_id"))
    both = lambda t: t["manifest"].join(t["files"].select("name", F.col("sha256").alias("have"), F.col("size_bytes").alias("bytes")), "name", "left")
    return [
        rule("batch_known", lambda t: absent(integrity.first_batch(t["batches"], batch), batch), "key", "batch is not in the plan"),
        rule("node_ids", lambda t: repeated(t["nodes"], "id"), "id", "node is repeated"),
        rule("planned_nodes", lambda t: missing_and_extra(t["planned_entities"], t["nodes"], "id"), "id", text("node is ", F.col("side"))),
        rule("planned_edges", lambda t: missing_and_extra(t["planned_atoms"], atoms(t), "atom_id"), "atom_id", text("edge is ", F.col("side"))),
        rule("endpoints", lambda t: endpoints(t["edges"], t["nodes"]), "id", "edge has an endpoint without a node"),
        rule("reviewed", lambda t: t["edges"].where(~F.coalesce(F.col("relation_status") == "reviewed", F.lit(False))), atom_id(), "edge is not reviewed"),
        rule("other_batches", lambda t: atoms(t).join(integrity.other_atoms(t["batches"], batch), "atom_id", "left_semi"), "atom_id", "atom belongs to another batch"),
        rule("sources", lambda t: unregistered(t["edges"], t["registry"]), "source_id", "source is not registered"),
        rule("triples", lambda t: integrity.triples_differ(t["triples"], t["edges"]), "source_atom_id", text("triple is only in the ", F.when(F.col("side") == "left", "file").otherwise("graph"))),
        rule("artifact_hash", lambda t: both(t).where(~F.col("have").eqNullSafe(F.col("sha256"))), "name", "artifact is missing or changed"),
        rule("artifact_size", lambda t: both(t).where("bytes IS NOT NULL AND bytes <> size_bytes"), "name", "artifact has another size"),
        rule("private_paths", lambda t: t["texts"].withColumn("found", leaks(F.col("text"), patterns)).where("size(found) > 0"), "path", text("text matches ", F.array_join("found", ", "))),
    ]


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): subjects and objects without a node."""
    ends = edges.select(F.explode(F.array("subject", "object")).alias("id"))
    return not_in(ends, {"id": "id"}, nodes).distinct()


def authority(prefix: str, first: int, last: int, relations: int, narratives: int, groups: int) -> list[Rule]:
    """Tables: claims (group_id, claim_id, predicate; predicate null where the claim has no such key), cases (case_id, expected_disposition, required_claim_ids), declared (key, want), known_claims (claim_id)."""
    return [
        rule("groups", lambda t: count_is(t["claims"].select("group_id").distinct(), groups), "n", "number of groups differs"),
        rule("claim_ids", lambda t: coverage(t["claims"].select(F.col("claim_id").alias("id")), prefix, first, last), "id", text("claim is ", F.col("problem"))),
        rule("claim_order", lambda t: t["claims"].agg(F.array_sort(F.collect_list("claim_id")).alias("have")).where(F.col("have") != dense_ids(prefix, first, last)).select(F.size("have").alias("n")), "n", "claim ids are not the dense sequence"),
        rule("relation_claims", lambda t: count_is(t["claims"].where("predicate IS NOT NULL"), relations), "n", "number of relation claims differs"),
        rule("narrative_claims", lambda t: count_is(t["claims"].where("predicate IS NULL"), narratives), "n", "number of narrative claims differs"),
        rule("case_ids", lambda t: repeated(t["cases"], "case_id"), "case_id", "case is repeated"),
        rule("dispositions", lambda t: expect_counts(t["cases"], "expected_disposition", t["declared"]), "key", text("cases: ", F.col("have"), ", declared: ", F.col("want"))),
        rule("case_claims", lambda t: evaluate.missing_claims(t["cases"], t["known_claims"]).where("size(missing) > 0"), "case_id", text("unknown claims: ", F.array_join("missing", ", "))),
    ]


def protocol(total: int, case_pattern: str, points: int, patterns: dict[str, str]) -> list[Rule]:
    """Tables: cases (a fixed question suite), dispositions and categories (key, want), entities and atoms (id), later (atom_id), edges, registry, rubric (criterion, points), texts (path, text)."""
    return [
        rule("total", lambda t: count_is(t["cases"], total), "n", "number of cases differs"),
        rule("case_ids", lambda t: repeated(t["cases"], "case_id"), "case_id", "case is repeated"),
        rule("case_pattern", lambda t: t["cases"].where(~full_match(F.col("case_id"), case_pattern)), "case_id", "case id is malformed"),
        rule("dispositions", lambda t: expect_counts(t["cases"], "expected_disposition", t["dispositions"]), "key", text("cases: ", F.col("have"), ", declared: ", F.col("want"))),
        rule("categories", lambda t: expect_counts(t["cases"], "category", t["categories"]), "key", text("cases: ", F.col("have"), ", declared: ", F.col("want"))),
        rule("contract", lambda t: evaluate.disposition_contract(t["cases"]), "case_id", F.col("problem")),
        rule("entities_known", lambda t: evaluate.missing_claims(t["cases"], t["entities"].select(F.col("id").alias("claim_id")), "required_entity_ids").where("size(missing) > 0"), "case_id", text("unknown entities: ", F.array_join("missing", ", "))),
        rule("atoms_known", lambda t: evaluate.missing_claims(t["cases"], t["atoms"].select(F.col("id").alias("claim_id")), "required_relation_atom_ids").where("size(missing) > 0"), "case_id", text("unknown atoms: ", F.array_join("missing", ", "))),
        rule("later_batches", lambda t: evaluate.leakage(t["cases"], t["later"]), "case_id", text("asks for a later atom: ", F.col("atom_id"))),
        rule("sources", lambda t: unregistered(t["edges"], t["registry"]), "source_id", "source is not registered"),
        rule("entities_covered", lambda t: evaluate.suite_coverage(t["cases"], t["entities"], "required_entity_ids"), "id", text("entity is ", F.col("side"))),
        rule("atoms_covered", lambda t: evaluate.suite_coverage(t["cases"], t["atoms"], "required_relation_atom_ids"), "id", text("atom is ", F.col("side"))),
        rule("rubric", lambda t: evaluate.rubric_points(t["rubric"], points), "total", "points don't add up"),
        rule("private_paths", lambda t: t["texts"].withColumn("found", leaks(F.col("text"), patterns)).where("size(found) > 0"), "path", text("text matches ", F.array_join("found", ", "))),
    ]


def run(modes: tuple[str, ...] = ("rag", "baseline"), statuses: tuple[str, ...] = ("completed",)) -> list[Rule]:
    """Tables: runs (run_id, suite_id, mode, status), suite (suite_id), responses (A14), cases, entities and atoms (id), later (atom_id), registry."""
    each = lambda t, c, name: t["responses"].select("case_id", F.explode(c).alias(name))
    with_case = lambda t: t["responses"].join(t["cases"].select("case_id", "expected_disposition"), "case_id")
    none = F.array().cast("array<string>")
    return [
        rule("one_run", lambda t: count_is(t["runs"], 1), "n", "there is not one run"),
        rule("run_state", lambda t: t["runs"].where(~F.coalesce(F.col("mode").isin(*modes) & F.col("status").isin(*statuses), F.lit(False))), "run_id", "mode or status is not allowed"),
        rule("suite", lambda t: not_in(t["runs"], {"suite_id": "suite_id"}, t["suite"]), "run_id", "run is of another suite"),
        rule("responses_once", lambda t: repeated(t["responses"], "case_id"), "case_id", "case is answered twice"),
        rule("responses_all", lambda t: missing_and_extra(t["cases"], t["responses"], "case_id"), "case_id", text("response is ", F.col("side"))),
        rule("disposition", lambda t: t["responses"].where(~F.coalesce(F.col("disposition").isin("ANSWER", "PARTIAL", "ABSTAIN"), F.lit(False))), "case_id", "disposition is not allowed"),
        rule("answer_text", lambda t: t["responses"].where(is_blank(F.col("answer_text"))), "case_id", "answer is blank"),
        rule("entities_known", lambda t: not_in(each(t, "retrieved_entity_ids", "id"), {"id": "id"}, t["entities"]), "case_id", text("unknown entity ", F.col("id"))),
        rule("atoms_known", lambda t: not_in(each(t, "used_relation_atom_ids", "id"), {"id": "id"}, t["atoms"]), "case_id", text("unknown atom ", F.col("id"))),
        rule("later_batches", lambda t: each(t, "used_relation_atom_ids", "atom_id").join(t["later"], "atom_id", "left_semi"), "case_id", text("uses a later atom: ", F.col("atom_id"))),
        rule("sources", lambda t: not_in(each(t, "cited_source_ids", "source_id"), {"source_id": "source_id"}, t["registry"]), "case_id", text("unregistered source ", F.col("source_id"))),
        rule("abstention", lambda t: with_case(t).where((F.col("disposition") == "ABSTAIN") & (is_blank(F.col("reason_code")) | (F.size(F.coalesce("used_relation_atom_ids", none)) > 0))), "case_id", "an abstention needs a reason and no claims"),
        rule("gaps", lambda t: t["responses"].where((F.col("disposition") == "PARTIAL") & (F.size(F.coalesce("missing_coverage", none)) == 0)), "case_id", "a partial answer names no gap"),
    ]


def bundle() -> list[Rule]:
    """Tables: manifest (path, size_bytes, sha256, source_blob_sha1), files (path, bytes, content), self_hash (declared, computed), references (path, object_id) where a repository is at hand, else empty."""
    return [
        rule("files", lambda t: integrity.verify_bundle(t["manifest"], t["files"]), "path", F.col("problem")),
        rule("paths", lambda t: repeated(t["manifest"], "path"), "path", "file is listed twice"),
        rule("self_hash", lambda t: t["self_hash"].where(~F.col("declared").eqNullSafe(F.col("computed"))), "declared", "the manifest's own hash differs"),
        rule("repository", lambda t: t["manifest"].join(t["references"], "path").where("object_id <> source_blob_sha1"), "path", "the repository has another object"),
    ]


def context() -> list[Rule]:
    """Tables: nodes, edges, narrative (claim_id, entity_ids, evidence), supporting (claim_id, host_claim_id), registry, controls (claim_id, key, value)."""
    claims = lambda t: t["edges"].select(atom_id().alias("claim_id"))
    return [
        rule("edge_claims", lambda t: claims(t).where("claim_id IS NULL"), "claim_id", "edge has no claim id"),
        rule("claims_once", lambda t: repeated(claims(t), "claim_id"), "claim_id", "claim has several edges"),
        rule("narrative_once", lambda t: repeated(t["narrative"], "claim_id"), "claim_id", "narrative claim is repeated"),
        rule("endpoints", lambda t: endpoints(t["edges"], t["nodes"]), "id", "edge has an endpoint without a node"),
        rule("narrative_entities", lambda t: not_in(t["narrative"].select("claim_id", F.explode("entity_ids").alias("id")), {"id": "id"}, t["nodes"]), "claim_id", text("unknown entity ", F.col("id"))),
        rule("hosts", lambda t: not_in(t["supporting"], {"host_claim_id": "claim_id"}, claims(t)), "claim_id", "supporting claim has no host edge"),
        rule("sources", lambda t: unregistered(t["edges"], t["registry"]), "source_id", "source is not registered"),
        rule("controls", lambda t: evaluate.boundary_failures(t["controls"], t["edges"]), "claim_id", text(F.col("key"), ": ", F.col("problem"))),
    ]


def frozen() -> list[Rule]:
    """Tables: actual and expected (key, value): counts, statuses and hashes that a release fixes; flags (name, value boolean) that must all be true; migrations, cases."""
    return [
        rule("values", lambda t: expect_values(t["actual"], t["expected"]), "key", text("is ", F.col("have"), ", not ", F.col("want"))),
        rule("flags", lambda t: integrity.all_true(t["flags"]), "name", "is not true"),
        rule("migrations", lambda t: integrity.migration_problems(t["migrations"], t["cases"]), "p9_case_id", F.col("problem")),
    ]
