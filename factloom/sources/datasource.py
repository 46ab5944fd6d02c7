"""Trees of structured documents as a Spark data source: batch and stream reading, and writing.

    spark.dataSource.register(EvidenceDocuments)
    spark.read.format("evidence_documents").option("glob", "*.md").load("s3://kb/docs")

A read lists names, sizes and times only and deals files to tasks by their sizes; tasks open, decode and
parse. Only the declared columns are worked out: with .schema("path string, bytes bigint") no file is opened,
and without meta, body and parse_error none is parsed. A file that can't be decoded or parsed is a row
with parse_error. `scan` does all this for a list of columns.

A stream takes files by their time of modification, oldest first; its offsets are times, so a batch is the
files of a half-open span of time, the same whenever it is planned again. Files younger than `settle`
seconds wait, so that none of the same moment is overlooked; a file that is changed comes again.

A write puts each row's file into a hidden staging folder and moves them when all tasks are done, so a task
that is lost leaves nothing that a reader sees; tasks that outlive a failed write may leave its staging
folder behind. Two rows of one path are an error.

Options: path, glob (*.md), recursive (true), skip (names, by comma), parse (markdown, yaml or none), partitionBytes (64 MiB),
openBytes (64 KiB, what a file counts besides its size), settle (2).
"""

from __future__ import annotations

import fnmatch
import posixpath
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from factloom.session import ship
from factloom.sources.documents import attempt, parse_markdown, parse_yaml

NAME = "evidence_documents"
SCHEMA = "path string, parts array<string>, name string, bytes bigint, modified timestamp, content binary, text string, meta string, body string, parse_error string"
FROM_LISTING, PARSED = {"path", "parts", "name", "bytes", "modified"}, {"meta", "body", "parse_error"}
PARSERS = {"markdown": parse_markdown, "yaml": parse_yaml, "none": None}


def store_of(path: str):
    """The file system and the path in it; any store that pyarrow knows by URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    modified: int  # nanoseconds


class Files(InputPartition):
    def __init__(self, files: list[Found]) -> None:
        self.files = files


class _Tree:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        if unknown := set(self.names) - {f.split()[0] for f in SCHEMA.split(", ")}:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.path, self.glob = options["path"].rstrip("/"), options.get("glob", "*.md")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.skip = {x for x in options.get("skip", "").split(",") if x}
        self.parse = options.get("parse", "markdown")
        if self.parse not in PARSERS:
            raise ValueError(f"parse must be one of {', '.join(PARSERS)}")
        self.most, self.opening = int(options.get("partitionbytes", 64 << 20)), int(options.get("openbytes", 64 << 10))
        self.settle = float(options.get("settle", 2))

    def listed(self) -> list[Found]:
        """The files, by path; hidden names (a leading dot or underscore) are left out, as Spark's readers do."""
        from pyarrow import fs

        store, root = store_of(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=self.recursive)):
            inner = posixpath.relpath(info.path, root)
            if info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, self.glob) and info.base_name not in self.skip and not any(p[0] in "._" for p in inner.split("/")):
                found.append(Found(inner, info.size, info.mtime_ns))
        return sorted(found, key=lambda f: f.path)

    def dealt(self, files: list[Found]) -> Sequence[InputPartition]:
        parts: list[Files] = []
        room = 0
        for f in files:
            need = f.size + self.opening
            if not parts or need > room:
                parts.append(Files([]))
                room = self.most
            parts[-1].files.append(f)
            room -= need
        return parts

    def rows(self, partition: Files) -> Iterator[tuple]:
        from datetime import UTC, datetime

        store, root = store_of(self.path)
        asked = set(self.names)
        for f in partition.files:
            row: dict[str, Any] = {"path": f.path, "parts": f.path.split("/"), "name": posixpath.basename(f.path), "bytes": f.size}
            if "modified" in asked:
                row["modified"] = datetime.fromtimestamp(f.modified / 1e9, UTC)
            if asked - FROM_LISTING:
                with store.open_input_stream(f"{root}/{f.path}") as stream:
                    data = stream.read()
                row["content"] = data
                try:
                    row["text"] = data.decode().replace("\r\n", "\n").replace("\r", "\n")
                except UnicodeDecodeError as e:
                    row["parse_error"] = f"not UTF-8 at byte {e.start}"
                parser = PARSERS[self.parse]
                if parser and "text" in row and asked & PARSED:
                    row["meta"], row["body"], row["parse_error"] = attempt(parser, row["text"])
            yield tuple(row.get(n) for n in self.names)


class Reader(DataSourceReader):
    def __init__(self, tree: _Tree) -> None:
        self.tree = tree

    def partitions(self) -> Sequence[InputPartition]:
        return self.tree.dealt(self.tree.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.tree.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, tree: _Tree) -> None:
        self.tree, self.high = tree, 0

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(self.tree.settle * 1e9)
        self.high = max([self.high, *(f.modified for f in self.tree.listed() if f.modified <= settled)])
        return {"upto": self.high}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.tree.dealt([f for f in self.tree.listed() if start["upto"] < f.modified <= end["upto"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.tree.rows(partition)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    staged: str


class Writer(DataSourceWriter):
    """Rows (path, content) or (path, text) as files."""

    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        if "path" not in names or not {"content", "text"} & set(names):
            raise ValueError("rows must have path and content or text")
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = store_of(self.path)
        staged, files = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        made = set()
        for row in iterator:
            r = row.asDict()
            inner = posixpath.normpath(r["path"])
            if inner.startswith(("/", "..")) or inner in ("", "."):
                raise ValueError(f"{r['path']} leads out of the tree")
            folder = posixpath.dirname(f"{staged}/{inner}")
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            data = r.get("content")
            with store.open_output_stream(f"{staged}/{inner}") as out:
                out.write(bytes(data) if data is not None else (r.get("text") or "").encode())
            files.append(inner)
        return Written(files, staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        done = [m for m in messages if m is not None]
        every = [f for m in done for f in m.files]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("two rows have the same path")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name != self.staging:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        folders = {posixpath.dirname(f"{root}/{f}") for f in every}
        for folder in sorted(folders):
            store.create_dir(folder, recursive=True)
        for m in done:
            for f in m.files:
                store.move(f"{m.staged}/{f}", f"{root}/{f}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class EvidenceDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(_Tree(schema, self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(_Tree(schema, self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(EvidenceDocuments)


def scan(spark: SparkSession, path: str, columns: Sequence[str] = (), stream: bool = False, **options: Any) -> DataFrame:
    """The documents of a tree with the named columns, or all; nothing else is worked out."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(NAME).options(**options)
    if columns:
        kinds = dict(f.split(" ", 1) for f in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write_tree(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows (path, content or text) as files of a tree."""
    register(rows.sparkSession)
    rows.write.format(NAME).mode("overwrite" if overwrite else "append").save(path)
