"""Structured Markdown, YAML, JSON lines and CSV as DataFrames.

Files come through Spark's binary reader, so any store that Spark reads will do; they are parsed
where they are read, in Arrow batches. Metadata is canonical JSON text, ready for `parse_json` (VARIANT) or
`from_json`. A file that can't be parsed is a row with `parse_error`, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions.canonical import canonical_json
from factloom.functions.text import normal_eol
from factloom.session import ship

PARSED = T.StructType([T.StructField("meta", T.StringType()), T.StructField("body", T.StringType()), T.StructField("parse_error", T.StringType())])


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is needed to read YAML documents") from e
    return yaml


def load_yaml(text: str) -> Any:
    """By libyaml where PyYAML has it."""
    yaml = _yaml()
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def as_json(value: Any) -> str:
    """Canonical JSON of what YAML gave; a scalar that JSON hasn't (a date, say) is an error."""
    try:
        return canonical_json(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"YAML value is not JSON: {e}") from e


def split_front_matter(text: str) -> tuple[str, str]:
    """The metadata text and the body after it. The text must have LF line ends."""
    if not text.startswith("---\n"):
        raise ValueError("front matter does not start the document")
    end = text.find("\n---\n", 4)
    if end < 0:
        raise ValueError("front matter is not terminated")
    return text[4:end], text[end + 5 :]


def parse_markdown(text: str) -> tuple[str, str]:
    head, body = split_front_matter(text)
    meta = load_yaml(head)
    if not isinstance(meta, dict):
        raise ValueError("front matter is not a mapping")
    return as_json(meta), body


def parse_yaml(text: str) -> tuple[str, str]:
    root = load_yaml(text)
    if not isinstance(root, dict):
        raise ValueError("YAML root is not a mapping")
    return as_json(root), ""


def attempt(parse: Callable[[str], tuple[str, str]], text: str) -> tuple[str | None, str | None, str | None]:
    """(meta, body, parse_error) of a text."""
    try:
        return (*parse(text), None)
    except Exception as e:  # any parse failure is a finding
        return None, None, (str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}").split("\n")[0]


def _parser(parse: Callable[[str], tuple[str, str]]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([attempt(parse, text) for text in texts], columns=PARSED.names)

    return F.pandas_udf(run, PARSED)


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, parts, name, bytes, content) of files, path relative to the folder; order by parts for component order."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(path if recursive else path.rstrip("/") + "/" + glob)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.expr(f"substring_index(path, '{root}/', -1)") if root else F.col("path")
    out = rows.select(inner.alias("path"), F.col("length").alias("bytes"), "content")
    out = out.withColumn("parts", F.split("path", "/")).withColumn("name", F.element_at("parts", -1))
    if skip:
        out = out.where(~F.col("name").isin(*skip))
    return out.select("path", "parts", "name", "bytes", "content")


def read_documents(spark: SparkSession, path: str, recursive: bool = True, skip: tuple[str, ...] = ("README.md",), parse: Callable[[str], tuple[str, str]] = parse_markdown, glob: str = "*.md") -> DataFrame:
    """(path, parts, name, bytes, content, text, meta, body, parse_error) of every document."""
    return parse_texts(files(spark, path, glob, recursive, skip).withColumn("text", F.decode("content", "UTF-8")), parse)


def parse_texts(rows: DataFrame, parse: Callable[[str], tuple[str, str]] = parse_markdown) -> DataFrame:
    """rows with their `text` at LF line ends, and meta, body and parse_error of it."""
    ship(rows.sparkSession)
    rows = rows.withColumn("text", normal_eol(F.col("text")))
    return rows.withColumn("_p", _parser(parse)("text")).select("*", "_p.meta", "_p.body", "_p.parse_error").drop("_p")


def read_extensions(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one folder, its README too and no folders below it."""
    return read_documents(spark, path, recursive=False, skip=())


def read_yaml(spark: SparkSession, path: str, glob: str = "*.yml", recursive: bool = True) -> DataFrame:
    return read_documents(spark, path, recursive, (), parse_yaml, glob)


#: Whether a line of these bytes is white space only.
_SPACES = b" \t\n\r\x0b\x0c"


def _json_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, raw) in the order of the file to (path, start, at, record, problem), at counting the lines of a split from 1."""
    split, count = None, 0
    for batch in batches:
        out: list[tuple] = []
        for path, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, start) != split:
                split, count = (path, start), 0
            count += 1
            if not raw.strip(_SPACES):
                continue
            try:
                value = json.loads(raw.decode())
                out.append((path, start, count, canonical_json(value), None) if isinstance(value, dict) else (path, start, count, None, "line is not an object"))
            except UnicodeDecodeError:
                out.append((path, start, count, None, "line is not UTF-8"))
            except ValueError as e:
                out.append((path, start, count, None, f"line is not JSON: {e}"))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["file", "start", "at", "record", "problem"])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, record, parse_error): record is canonical JSON of an object; other lines carry an error with their number; blank ones give no row.

    Files are split as Spark splits text. A first pass counts the lines of each split, their sums along a file are where
    the next split's numbers go on; a second one parses and numbers within the split. Line ends are LF, CR or CRLF,
    also across the ends of splits.
    """
    ship(spark)
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy("file", "start").count().select("file", "start", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("before"))
    found = lines.mapInArrow(_json_lines, "file string, start bigint, at bigint, record string, problem string")
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.substring_index(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), root + "/", -1) if root else F.col("file")
    # every split that gives a row has been counted; one that hasn't is another plan of the same files
    told = found.join(before, ["file", "start"], "left").withColumn("line", F.when(F.col("before").isNull(), F.raise_error(F.lit("splits of a file differ between two reads")).cast("bigint")).otherwise(F.col("before") + F.col("at")))
    told = told.withColumn("path", inner)
    return told.select("path", "line", "record", F.when(F.col("problem").isNotNull(), F.format_string("%s:%d: %s", "path", "line", "problem")).alias("parse_error"))


def read_triples(spark: SparkSession, path: str, schema: str = "subject string, predicate string, object string, relation_status string, source_atom_id string, evidence_source_ids string") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, text): each file as one text, for scans by pattern."""
    return files(spark, path, glob, recursive).select("path", F.decode("content", "UTF-8").alias("text"))


def names_in(spark: SparkSession, path: str) -> DataFrame:
    """The names of the files in a folder; none where the folder isn't there."""
    from factloom.operators.artifacts import exists

    if not exists(spark, path):
        return spark.createDataFrame([], "name string")
    return files(spark, path, recursive=False).select("name")


def repository_id(path: str, revision: str = "HEAD") -> str | None:
    """The object id that git gives for a revision, on the driver; None where there is no repository."""
    import subprocess

    done = subprocess.run(["git", "-C", path, "rev-parse", "--verify", "--quiet", revision], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None if done.returncode == 0 else None
