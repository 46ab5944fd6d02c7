"""python -m factloom COMMAND: exit code 0 passed, 1 violations, 2 catalogs can't be read."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import api
from factloom.operators import artifacts, evaluate, gates, graph, rules
from factloom.sources.documents import read_documents, repository_id


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="factloom")
    sub = parser.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="findings of documents and registry")
    v.add_argument("--knowledge-dir", required=True)
    v.add_argument("--source-registry", required=True, help="folder of the registry file")
    v.add_argument("--schema-dir", required=True, help="folder of the three catalogs")
    v.add_argument("--heading", action="append", default=[], help="a heading that every document needs")

    def batch(name: str, text: str) -> argparse.ArgumentParser:
        b = sub.add_parser(name, help=text)
        b.add_argument("--knowledge-dir", required=True)
        b.add_argument("--batch-id", required=True)
        return b

    for name in ("build", "check"):
        b = batch(name, "write a batch's artifacts" if name == "build" else "compare a batch's artifacts with those written")
        b.add_argument("--output-dir", required=True)
        b.add_argument("--public", action="store_true")
    e = batch("extend", "artifacts of a base batch with a later one and its extensions")
    e.add_argument("--later-dir", required=True)
    e.add_argument("--later-batch-id", required=True)
    e.add_argument("--extensions-dir", required=True)
    e.add_argument("--catalog", action="append", default=[], help="a catalog file that the digest takes in")
    c = batch("corpus", "retrieval corpus and source catalog of a batch")
    c.add_argument("--source-registry", required=True)
    c.add_argument("--preamble", default="# Corpus")
    r = batch("regression", "the report of a fixed suite")
    r.add_argument("--claim", action="append", default=[], help="a claim id beside those of the graph")
    r.add_argument("--require", action="append", default=[], metavar="CLAIM:KEY=VALUE", help="a qualifier that an edge must have")
    r.add_argument("--exclude", action="append", default=[], help="a term that no statement may have")
    r.add_argument("--report", default="report.yml")
    s = batch("run", "structure and scores of a run record")
    s.add_argument("--run-dir", required=True)
    s.add_argument("--run-file", required=True)
    s.add_argument("--source-registry", required=True)
    p = batch("protocol", "the contract of a fixed suite")
    p.add_argument("--total", type=int, required=True)
    p.add_argument("--case-pattern", default=".+")
    for x in (r, s, p):
        x.add_argument("--suite-dir", required=True)
        x.add_argument("--suite-file", required=True)
    for x in (e, c, r):
        x.add_argument("--output-dir", required=True)
        x.add_argument("--check", action="store_true", help="compare with what is written, and write nothing")
    return parser


def _files(spark: SparkSession, a: argparse.Namespace, files: dict[str, bytes], check: bool) -> list[str]:
    """Write the files, or give the problems of those written."""
    if not check:
        artifacts.write(spark, a.output_dir, files)
        return []
    return [f"{r.status} {r.name}" for r in api.check_artifacts(spark, a.output_dir, files).orderBy("status", "name").collect()]


def _ids(column, name: str = "id") -> DataFrame:
    return column.toDF(name).where(F.col(name).isNotNull()).distinct()


def _regression(spark: SparkSession, a: argparse.Namespace, built: graph.Graph) -> tuple[list[str], dict]:
    suite, cases = api.load_cases(spark, a.suite_dir, a.suite_file)
    claims = evaluate.claim_universe(_ids(built.edges.select(graph.atom_id()), "claim_id"), spark.createDataFrame([(c,) for c in a.claim], "claim_id string"))
    wanted = [(*x.split("=", 1)[0].split(":", 1), x.split("=", 1)[1]) for x in a.require]
    boundaries = evaluate.boundary_failures(spark.createDataFrame(wanted, "claim_id string, key string, value string"), built.edges)
    excluded = evaluate.excluded_terms(built.edges, spark.createDataFrame([(t,) for t in a.exclude], "term string"))
    report = api.regression_report(suite, built.digest.first()[0], cases, claims, boundaries, excluded, {}, "")
    if not a.check:
        api.write_report(spark, a.output_dir, a.report, report)
    elif not api.report_is_current(spark, a.output_dir, a.report, report):
        return ["report is missing or stale"], {}
    return report["failures"], report["counts"]


def _suite_tables(spark: SparkSession, a: argparse.Namespace, built: graph.Graph) -> rules.Tables:
    suite, cases = api.load_cases(spark, a.suite_dir, a.suite_file)
    return {"cases": cases, "suite": spark.createDataFrame([(suite,)], "suite_id string"), "entities": built.nodes.select("id"), "atoms": _ids(built.edges.select(graph.atom_id())), "later": spark.createDataFrame([], "atom_id string"), "edges": built.edges}


def _run(spark: SparkSession, a: argparse.Namespace, built: graph.Graph) -> tuple[list[str], dict]:
    runs, responses = api.load_run(spark, a.run_dir, a.run_file)
    tables = _suite_tables(spark, a, built) | {"runs": runs, "responses": responses, "registry": api.load_registry(spark, a.source_registry)}
    return [], api.validate_run_structure(tables)


def _protocol(spark: SparkSession, a: argparse.Namespace, built: graph.Graph) -> tuple[list[str], dict]:
    tables = _suite_tables(spark, a, built)
    kinds = {"total", "case_ids", "case_pattern", "contract", "entities_known", "atoms_known", "later_batches", "entities_covered", "atoms_covered"}
    found = rules.accumulate([r for r in gates.protocol(a.total, a.case_pattern, 0, {}) if r.rule_id in kinds], tables)
    return rules.report(found)[0], {"cases": tables["cases"].count()}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    name = a.command.upper()
    if a.command == "validate":
        try:
            vocabulary = api.load_vocabulary(spark, a.schema_dir, a.heading)
        except (ValueError, KeyError) as e:
            print(f"ERROR: {e}", file=sys.stderr)
            return 2
        lines, code = rules.report(api.validate_knowledge(spark, a.knowledge_dir, a.source_registry, vocabulary))
        print("\n".join([*lines, artifacts.status_line(name, lines if code else [], {"findings": len(lines)})[0]]))
        return code
    try:
        built = api.build_graph(spark, a.knowledge_dir, a.batch_id)
        if a.command in ("regression", "run", "protocol"):
            problems, metrics = {"regression": _regression, "run": _run, "protocol": _protocol}[a.command](spark, a, built)
        else:
            if a.command == "extend":
                texts = []
                for path in a.catalog:
                    folder, _, file = path.rpartition("/")
                    texts.append(api.load_one(spark, folder, file).first().text)
                built = api.extend_graph(spark, built, a.later_dir, a.extensions_dir, a.later_batch_id, texts)
            if a.command == "corpus":
                files = api.corpus_files(built, read_documents(spark, a.knowledge_dir), a.batch_id, api.load_registry(spark, a.source_registry), a.preamble)
            else:
                files = api.render_artifacts(built, {"batch_id": a.batch_id}, {"public": getattr(a, "public", False)})
            problems = _files(spark, a, files, a.command == "check" or getattr(a, "check", False))
            metrics = built.counts().first().asDict() | ({"revision": r} if (r := repository_id(".")) else {})
        line, code = artifacts.status_line(name, problems, metrics)
    except ValueError as e:
        line, code = artifacts.status_line(name, [str(e)], {})
    print(line)
    return code


if __name__ == "__main__":
    sys.exit(main())
