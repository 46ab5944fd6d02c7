"""Byte-exact artifacts of a graph, manifests over them, and drift between expected and stored files.

Rows are rendered to text in Spark; only the finished lines of a release-sized table come to the
driver, in order, to be written as one file.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_json

#: Rows that one artifact may have; beyond it, write Parquet tables instead.
MOST_ROWS = 1_000_000


def lines(df: DataFrame, order: list) -> list[str]:
    """Each row as JSON with sorted keys and nulls kept, in order; `qualifiers` text becomes JSON."""
    rendered = df.orderBy(*order).select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("line"))
    rows = rendered.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows for one artifact")
    out = []
    for r in rows:
        value = json.loads(r.line)
        if isinstance(value.get("qualifiers"), str):
            value["qualifiers"] = json.loads(value["qualifiers"])
        out.append(canonical_json(value))
    return out


def json_lines(df: DataFrame, order: list) -> bytes:
    return "".join(x + "\n" for x in lines(df, order)).encode()


def triples_csv(df: DataFrame, order: list) -> bytes:
    """Header, LF ends, quotes only where needed."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows for one artifact")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in r] for r in rows)
    return out.getvalue().encode()


def yaml_bytes(value: Any) -> bytes:
    """Keys in insertion order, non-ASCII kept."""
    import yaml

    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True).encode()


def manifest(title: dict[str, Any], counts: dict[str, int], artifacts: dict[str, bytes], boundary: dict[str, Any]) -> bytes:
    files = {n: {"sha256": hashlib.sha256(b).hexdigest(), "size_bytes": len(b)} for n, b in artifacts.items()}
    return yaml_bytes({**title, "counts": counts, "artifacts": files, "boundary": boundary})


def graph_artifacts(graph, title: dict[str, Any], boundary: dict[str, Any]) -> dict[str, bytes]:
    """nodes.jsonl, edges.jsonl, triples.csv and manifest.yml of a Graph."""
    from factloom.operators.graph import atom_id

    by = ["subject", "predicate", "object"]
    out = {"nodes.jsonl": json_lines(graph.nodes, ["id"]), "edges.jsonl": json_lines(graph.edges, [*by, atom_id()]), "triples.csv": triples_csv(graph.triples, [*by, "source_atom_id"])}
    counts = graph.counts().first().asDict()
    digest = graph.digest.first()[0]
    return out | {"manifest.yml": manifest({**title, "input_sha256": digest}, counts, out, boundary)}


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _hadoop(spark, path)
    return store.exists(target)


def write(spark: SparkSession, folder: str, artifacts: dict[str, bytes]) -> None:
    """Create the folder and write each file, over an old one if there is one; without checksum files beside it."""
    for name, data in artifacts.items():
        store, target = _hadoop(spark, f"{folder}/{name}")
        store.setWriteChecksum(False)
        try:
            out = store.create(target, True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
        finally:
            store.setWriteChecksum(True)


def digests(spark: SparkSession, artifacts: dict[str, bytes], normalise_eol: bool = False) -> DataFrame:
    fix = (lambda b: b.replace(b"\r\n", b"\n").replace(b"\r", b"\n")) if normalise_eol else (lambda b: b)
    return spark.createDataFrame([(n, hashlib.sha256(fix(b)).hexdigest()) for n, b in sorted(artifacts.items())], "name string, sha256 string")


def stored(spark: SparkSession, folder: str, normalise_eol: bool = False) -> DataFrame:
    from factloom.functions.text import normal_eol
    from factloom.sources.documents import files

    if not exists(spark, folder):
        return spark.createDataFrame([], "name string, sha256 string")
    content = F.encode(normal_eol(F.decode("content", "UTF-8")), "UTF-8") if normalise_eol else F.col("content")
    return files(spark, folder, recursive=False).where(~F.col("name").startswith(".")).select("name", F.sha2(content, 256).alias("sha256"))


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, status): OK, STALE, MISSING or EXTRA for each name of either side; both are (name, sha256)."""
    both = expected.withColumnRenamed("sha256", "want").join(actual.withColumnRenamed("sha256", "have"), "name", "full_outer")
    status = F.when(F.col("want").isNull(), "EXTRA").when(F.col("have").isNull(), "MISSING").when(F.col("want") != F.col("have"), "STALE").otherwise("OK")
    return both.select("name", status.alias("status"))


def status_line(name: str, problems: Iterable[str], metrics: dict[str, Any]) -> tuple[str, int]:
    """The one-line summary and the exit code."""
    for first in problems:
        return f"{name}=FAIL {first}", 1
    return f"{name}=PASS" + "".join(f" {k}={v}" for k, v in metrics.items()), 0
