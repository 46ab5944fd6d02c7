"""Bundles, partitions, admission plans, reviewers and migrated cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import blob_sha1, file_sha256
from factloom.functions.text import every
from factloom.operators import hash_tree
from factloom.operators.graph import atom_id, triples
from factloom.operators.rules import missing_and_extra, multiset_difference


def verify_bundle(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): manifest rows (path, size_bytes, sha256, source_blob_sha1) against files (path, bytes, content)."""
    have = files.select("path", "bytes", file_sha256(F.col("content")).alias("have256"), blob_sha1(F.col("content")).alias("have1"))
    both = manifest.join(have, "path", "left")
    problem = F.when(F.col("bytes").isNull(), "file is missing").when(F.col("bytes") != F.col("size_bytes"), "size differs").when(F.col("have256") != F.col("sha256"), "sha256 differs").when(F.col("have1") != F.col("source_blob_sha1"), "blob id differs")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def partition_problems(atoms: DataFrame, classified: DataFrame) -> DataFrame:
    """(atom_id, problem): atoms that aren't in exactly one class. atoms: (atom_id). classified: (atom_id, class)."""
    n = classified.groupBy("atom_id").agg(F.count("*").alias("n"))
    return atoms.select("atom_id").distinct().withColumn("a", F.lit(True)).join(n, "atom_id", "full_outer").select("atom_id", F.when(F.col("a").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("problem")).where("problem IS NOT NULL")


def declared_counts(classes: DataFrame) -> DataFrame:
    """Classes (class, count, atom_ids) whose declared count isn't the length of their list."""
    return classes.where(F.size("atom_ids") != F.col("count"))


def implementation_problems(planned: DataFrame, implemented: DataFrame, key: str) -> DataFrame:
    """(key, side): planned and implemented ids that don't match, and ids implemented twice."""
    twice = implemented.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("side"))
    return missing_and_extra(planned, implemented, key).unionByName(twice)


def first_batch(batches: DataFrame, batch: str) -> DataFrame:
    """A row of the batch, which may have several; an empty result is a failure for the caller to report."""
    return batches.where(F.col("batch_id") == batch).limit(1)


def other_atoms(batches: DataFrame, batch: str) -> DataFrame:
    """(atom_id): edge and qualifier atoms of all other batches; absent lists count as empty."""
    none = F.array().cast("array<string>")
    return batches.where(~F.col("batch_id").eqNullSafe(F.lit(batch))).select(F.explode(F.concat(F.coalesce("edge_atom_ids", none), F.coalesce("qualifier_atom_ids", none))).alias("atom_id")).distinct()


def triples_differ(stored: DataFrame, edges: DataFrame, by_ranges: bool = False) -> DataFrame:
    """Rows by which stored triples and the edges' own triples differ, as multisets. by_ranges: most agree, and hash trees find the ranges that don't."""
    difference = hash_tree.multiset_difference if by_ranges else multiset_difference
    return difference(stored.select("subject", "predicate", "object", "relation_status", "source_atom_id", "evidence_source_ids"), triples(edges))


#: Fixed values of the review protocol: what each field of a reviewer's record must be for it to be aggregated.
AGGREGATED = {
    "completion_status": ("COMPLETE",),
    "all_required_case_scores_present": (True,),
    "top_level_conclusion": ("PASS", "CHANGES_REQUIRED", "FAIL"),
    "release_recommendation": ("RECOMMEND_RELEASE", "DO_NOT_RELEASE"),
    "metadata_valid": (True,),
}
#: Defects and states of a critical disagreement that bar it.
BARRED_DEFECTS = ("ALL_REQUIRED_CASE_SCORES_MISSING",)
OPEN_DISAGREEMENTS = ("UNRESOLVED_REQUIRES_ADJUDICATION",)


def eligible(allowed: dict[str, tuple] = AGGREGATED, barred_defects: tuple[str, ...] = BARRED_DEFECTS, open_disagreements: tuple[str, ...] = OPEN_DISAGREEMENTS) -> Column:
    """Whether a reviewer's record may be aggregated: every field has an allowed value (null is none), no defect and no open disagreement bars it."""
    defects = F.coalesce("defects", F.array().cast("array<string>"))
    barred = F.arrays_overlap(defects, F.array(*[F.lit(x) for x in barred_defects])) | F.coalesce(F.col("critical_disagreement.status").isin(*open_disagreements), F.lit(False))
    return every(*[F.col(name).isin(*values) for name, values in allowed.items()], ~F.coalesce(barred, F.lit(False)))


def release_blocked(records: DataFrame, open_disagreements: tuple[str, ...] = OPEN_DISAGREEMENTS) -> DataFrame:
    """(reviewer_id): records whose critical disagreement is open; one is enough to block a release, whatever the scores say."""
    return records.where(F.coalesce(F.col("critical_disagreement.status").isin(*open_disagreements), F.lit(False))).select("reviewer_id")


def all_true(flags: DataFrame) -> DataFrame:
    """(name): flags that aren't exactly true. flags: (name, value boolean)."""
    return flags.where(~F.coalesce("value", F.lit(False))).select("name")


def migration_problems(migrations: DataFrame, cases: DataFrame) -> DataFrame:
    """(p9_case_id, problem). migrations: p9_case_id, source_case_id, source_case_sha256, expected_disposition. cases: case_id, sha256, expected_disposition."""
    have = cases.select(F.col("case_id").alias("source_case_id"), F.col("sha256").alias("have"), F.col("expected_disposition").alias("was"))
    both = migrations.join(have, "source_case_id", "left")
    problem = F.when(F.col("have").isNull(), "source case is unknown").when(F.col("have") != F.col("source_case_sha256"), "source case has changed").when(F.col("was") != F.col("expected_disposition"), "disposition differs")
    return both.select("p9_case_id", problem.alias("problem")).where("problem IS NOT NULL")


def background_only(edges: DataFrame, evidence_type: str = "background_only") -> DataFrame:
    """Reviewed relations that rest on background evidence alone."""
    return edges.where((F.col("relation_status") == "reviewed") & F.forall("evidence", lambda e: e["evidence_type"] == evidence_type))


def lacking_qualifiers(edges: DataFrame, required: DataFrame) -> DataFrame:
    """(atom_id, predicate, key): qualifiers that a predicate requires and an edge lacks. required: (predicate, key)."""
    wanted = edges.select(atom_id().alias("atom_id"), "predicate", F.json_object_keys("qualifiers").alias("keys")).join(F.broadcast(required), "predicate")
    return wanted.where(~F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False))).select("atom_id", "predicate", "key")


def self_check(candidates: DataFrame) -> DataFrame:
    """(class, status): NOT_APPLICABLE without candidates, FAIL where any statement type is null, else PASS. candidates: (class, statement_type, is_present)."""
    return candidates.groupBy("class").agg(
        F.when(~F.bool_or("is_present"), "NOT_APPLICABLE").when(F.bool_or(F.col("is_present") & F.col("statement_type").isNull()), "FAIL").otherwise("PASS").alias("status")
    )


def inverse_labels(edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """(subject, label, object) read from the object's side. predicates: (predicate, inverse_label_zh), a vocabulary's size."""
    return edges.join(F.broadcast(predicates), "predicate").select(F.col("object").alias("subject"), F.col("inverse_label_zh").alias("label"), F.col("subject").alias("object"))
