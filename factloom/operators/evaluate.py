"""Fixed suites against a graph: missing claims, boundaries, coverage, and the scores of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import atom_id


def claim_universe(*claims: DataFrame) -> DataFrame:
    """Distinct claim ids of several (claim_id, ...) tables."""
    out = claims[0].select("claim_id")
    for more in claims[1:]:
        out = out.unionByName(more.select("claim_id"))
    return out.distinct()


def narrative_claims(claims: DataFrame, role: str = "narrative_fact") -> DataFrame:
    """The claims of a role, by id. claims: (claim_id, claim_role, ...)."""
    return claims.where(F.col("claim_role") == role).orderBy("claim_id")


def claim_records(edges: DataFrame, narrative: DataFrame, supporting: DataFrame) -> DataFrame:
    """One record a claim: relation claims, over which narrative and then supporting ones take precedence.

    edges: graph edges. narrative: (claim_id, entity_ids, evidence, render_text). supporting: (claim_id, host_claim_id):
    it has its host edge's entities, evidence and text, but not its qualifiers.
    """
    cols = ["claim_id", "entity_ids", "evidence", "qualifiers", "render_text", "rank"]
    relation = edges.select(atom_id().alias("claim_id"), F.array("subject", "object").alias("entity_ids"), "evidence", "qualifiers", F.col("statement_zh").alias("render_text"), F.lit(0).alias("rank"))
    told = narrative.select("claim_id", "entity_ids", "evidence", F.lit("{}").alias("qualifiers"), "render_text", F.lit(1).alias("rank"))
    hosts = relation.select(F.col("claim_id").alias("host_claim_id"), "entity_ids", "evidence", "render_text")
    support = supporting.join(hosts, "host_claim_id").select("claim_id", "entity_ids", "evidence", F.lit("{}").alias("qualifiers"), "render_text", F.lit(2).alias("rank"))
    every = relation.select(cols).unionByName(told.select(cols)).unionByName(support.select(cols))
    best = every.groupBy("claim_id").agg(F.max_by(F.struct("entity_ids", "evidence", "qualifiers", "render_text"), "rank").alias("r"))
    return best.select("claim_id", "r.*")


def missing_claims(cases: DataFrame, claims: DataFrame, wanted: str = "required_claim_ids") -> DataFrame:
    """cases with `missing`, the sorted required ids that no claim has."""
    asked = cases.select("case_id", F.explode(wanted).alias("claim_id"))
    lacking = asked.join(claims.select("claim_id").distinct(), "claim_id", "left_anti").groupBy("case_id").agg(F.array_sort(F.collect_set("claim_id")).alias("missing"))
    return cases.join(lacking, "case_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def boundary_failures(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, key, problem): qualifier expectations that fail. expected: (claim_id, key, value JSON). A missing edge fails too."""
    have = edges.select(atom_id().alias("claim_id"), "qualifiers")
    pairs = have.select("claim_id", F.explode(F.from_json("qualifiers", "map<string,string>")).alias("key", "have"))
    known = have.select("claim_id").distinct().withColumn("there", F.lit(True))
    both = expected.join(known, "claim_id", "left").join(pairs, ["claim_id", "key"], "left")
    problem = F.when(F.col("there").isNull(), "edge is missing").when(F.col("have").isNull(), "qualifier is missing").when(F.col("have") != F.col("value"), "qualifier differs")
    return both.select("claim_id", "key", problem.alias("problem")).where("problem IS NOT NULL")


def excluded_terms(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(claim_id, term): statements that contain a term they must not. terms: (term), a vocabulary's size, which is checked."""
    from factloom.operators.corpus import found_in

    return found_in(edges.select(atom_id().alias("claim_id"), "statement_zh"), "statement_zh", terms, "term").select("claim_id", "term")


def regression(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, expected_disposition, status, missing)."""
    rows = missing_claims(cases, claims)
    return rows.select("case_id", "expected_disposition", F.when(F.size("missing") == 0, "PASS").otherwise("FAIL").alias("status"), "missing")


def regression_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"))


def disposition_of(has_claims: Column, has_gaps: Column) -> Column:
    """The disposition that an answer's parts stand for: without claims it abstains, with a gap beside them it is partial."""
    return F.when(~has_claims, "ABSTAIN").when(has_gaps, "PARTIAL").otherwise("ANSWER")


def disposition_contract(cases: DataFrame) -> DataFrame:
    """(case_id, problem): cases whose fields don't fit their disposition.

    ANSWER names what it needs and has no gap; PARTIAL has both; ABSTAIN has only a gap. A citation requirement and a severity are always set.
    """
    n = F.size("required_entity_ids") + F.size("required_relation_atom_ids")
    gap = F.coalesce(F.length("coverage_gap") > 0, F.lit(False))
    d = F.col("expected_disposition")
    problem = (
        F.when(~F.coalesce(d.isin("ANSWER", "PARTIAL", "ABSTAIN"), F.lit(False)), "unknown disposition")
        .when((d == "ANSWER") & (n == 0), "ANSWER without requirements")
        .when((d == "ANSWER") & gap, "ANSWER with a gap")
        .when((d == "PARTIAL") & ((n == 0) | ~gap), "PARTIAL needs requirements and a gap")
        .when((d == "ABSTAIN") & ~gap, "ABSTAIN without a gap")
        .when(F.coalesce(F.length("citation_requirement"), F.lit(0)) == 0, "no citation requirement")
        .when(F.coalesce(F.length("failure_severity"), F.lit(0)) == 0, "no severity")
    )
    return cases.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")


def suite_coverage(cases: DataFrame, graph_ids: DataFrame, wanted: str) -> DataFrame:
    """(id, side): graph ids that no case exercises (missing), ids of cases that the graph hasn't (extra). graph_ids: (id)."""
    from factloom.operators.rules import missing_and_extra

    return missing_and_extra(graph_ids, cases.select(F.explode(wanted).alias("id")), "id")


def leakage(cases: DataFrame, later: DataFrame, wanted: str = "required_relation_atom_ids") -> DataFrame:
    """(case_id, atom_id): atoms of other batches that a case asks for. later: (atom_id)."""
    return cases.select("case_id", F.explode(wanted).alias("atom_id")).join(later.select("atom_id").distinct(), "atom_id", "left_semi").select("case_id", "atom_id")


def score_run(responses: DataFrame, cases: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: responses, disposition matches, provenance matches, boundary abstentions.

    Provenance matches when the used atoms hold the required ones, and each required atom has a cited source.
    """
    evidence = edges.select(atom_id().alias("atom_id"), F.transform("evidence", lambda e: e["source_id"]).alias("sources"))
    rows = responses.join(cases.select("case_id", "expected_disposition", "required_relation_atom_ids"), "case_id")
    need = rows.select("case_id", "cited_source_ids", F.explode("required_relation_atom_ids").alias("atom_id")).join(evidence, "atom_id", "left")
    cited = need.groupBy("case_id").agg(F.every(F.coalesce(F.arrays_overlap("sources", "cited_source_ids"), F.lit(False))).alias("cited"))
    rows = rows.join(cited, "case_id", "left")
    holds = F.size(F.array_except("required_relation_atom_ids", "used_relation_atom_ids")) == 0
    match = F.col("disposition") == F.col("expected_disposition")
    return rows.agg(
        F.count("*").alias("responses"), F.count_if(match).alias("disposition_matches"), F.count_if(holds & F.coalesce("cited", F.lit(True))).alias("provenance_matches"),
        F.count_if(match & (F.col("expected_disposition") == "ABSTAIN")).alias("boundary_abstentions"),
    )


def rubric_totals(rubric: DataFrame, *by: str) -> DataFrame:
    """(by..., total, criteria): the points of each rubric and how many criteria give them. rubric: (by..., points)."""
    return rubric.groupBy(*by).agg(F.sum("points").alias("total"), F.count("*").alias("criteria"))


def rubric_points(rubric: DataFrame, declared: int) -> DataFrame:
    """One row where criteria's points don't sum to the declared total. rubric: (criterion, points)."""
    return rubric_totals(rubric).select("total").where(~F.col("total").eqNullSafe(F.lit(declared)))


def score_gates(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, met). scores: (case_id, mode, score, hard_fail, traceable, abstained_right, is_boundary); modes rag and baseline.

    A case passes with 8 points or more and no hard failure.
    """
    rag, base = F.col("mode") == "rag", F.col("mode") == "baseline"
    passed = (F.col("score") >= 8) & ~F.col("hard_fail")
    share = lambda cond, of: F.count_if(cond & of) / F.nullif(F.count_if(of), F.lit(0))
    values = scores.agg(
        share(passed, rag).alias("pass_rate"), share(F.col("traceable"), rag).alias("traceability"), share(F.col("abstained_right"), rag & F.col("is_boundary")).alias("boundary_abstention"),
        F.avg(F.when(rag, F.col("score"))).alias("mean_score"), (F.sum(F.when(rag, F.col("score"))) - F.sum(F.when(base, F.col("score")))).alias("delta"),
    )
    names = list(thresholds)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(float(thresholds[n])).alias("threshold")) for n in names]))
    return values.select(pairs.alias("x")).select("x.*").withColumn("met", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def stable_runs(runs: DataFrame, times: int = 3, or_more: bool = False) -> DataFrame:
    """(request_id, runs, variants, stable): requests answered `times` times (or more) with one content hash. runs: (request_id, run, response_sha256)."""
    found = runs.groupBy("request_id").agg(F.count_distinct("run").alias("runs"), F.count_distinct("response_sha256").alias("variants"))
    return found.withColumn("stable", (F.col("runs") >= times if or_more else F.col("runs") == times) & (F.col("variants") == 1))
