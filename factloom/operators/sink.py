"""Ordered files of any size: sorted parts that tasks write, put together by the store, and digests of ordered streams.

Rows become lines in tasks and are range-partitioned by the order, so part k holds what comes before part k + 1
and no row passes through the driver. Spark's own committer makes the parts appear all at once; a
killed task or job leaves nothing of them. The index of parts has their byte offsets in the whole. `assemble` joins the
parts by the store's own concatenation where it has one, else by a copy in bounded buffers, into a temporary
name that is renamed when complete.

Lines that are equal in the order come in the order of their text, so the bytes don't depend on the partitioning, and one
order value with very many rows is spread over several parts.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_json
from factloom.functions.resumable import Sha256, resumable
from factloom.functions.text import rstrip
from factloom.operators.artifacts import _hadoop
from factloom.session import materialize, partitions, scratch_path, ship

BUFFER = 1 << 20
#: Bytes that one task of a digest reads.
READ = 128 << 20


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, JSON text, in canonical form, its text of qualifiers as JSON."""

    def one(text: str) -> str:
        value = json.loads(text)
        if isinstance(value.get("qualifiers"), str):
            value["qualifiers"] = json.loads(value["qualifiers"])
        return canonical_json(value)

    for b in batches:
        done = pa.array([one(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], done], names=b.schema.names)


def json_line(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Columns o0, o1 and so on of the order, and `line`: each row as canonical JSON with nulls kept."""
    ship(df.sparkSession)
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)]
    plain = df.select(*keys, F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("line"))
    return plain.mapInArrow(_canonical, plain.schema)


def csv_line(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The same for CSV, with quotes only where needed; native expressions only."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)]
    cells = []
    for c in df.columns:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        needs = text.rlike('[,"\n\r]') if len(df.columns) > 1 else text.rlike('[,"\n\r]') | (text == "")
        cells.append(F.when(needs, quoted).otherwise(text))
    return df.select(*keys, F.concat_ws(",", *cells).alias("line"))


def csv_header(df: DataFrame) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(df.columns)
    return out.getvalue()


def corpus_line(docs: DataFrame) -> DataFrame:
    """Sections of (id, path, body) by id; with the preamble as head they are the corpus that `corpus.corpus_text` gives."""
    return docs.select(F.col("id").alias("o0"), F.concat(F.lit("\n## "), F.col("id"), F.lit("\n\n<!-- "), F.col("path"), F.lit(" -->\n\n"), rstrip(F.col("body"))).alias("line"))


def ordered(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """lines in sorted, range-partitioned parts."""
    keys = [F.col(c).asc_nulls_first() for c in lines.columns]
    return lines.repartitionByRange(parts or partitions(lines.sparkSession), *keys).sortWithinPartitions(*keys)


def write_parts(lines: DataFrame, folder: str, head: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes the lines as text files and gives their index, (part, bytes, offset), by name. head: a line before all others.

    The head is a row of its own before the first part and not in the index's order by name.
    """
    ordered(lines, parts).select("line").write.text(folder)
    return index(lines.sparkSession, folder, head)


def index(spark: SparkSession, folder: str, head: str | None = None) -> DataFrame:
    """(part, bytes, offset) of the parts in a folder; names are in order. offset: where the part begins in the whole."""
    store, target = _hadoop(spark, folder)
    found = sorted((f.getPath().getName(), f.getLen()) for f in store.listStatus(target) if f.getPath().getName().startswith("part-"))
    at, rows = len((head + "\n").encode()) if head is not None else 0, []
    for name, size in found:
        rows.append((name, size, at))
        at += size
    return spark.createDataFrame(rows, "part string, bytes bigint, offset bigint")


def assemble(spark: SparkSession, folder: str, target: str, head: str | None = None) -> int:
    """Joins the parts of a folder, in order, into the file target, over an old one if there is one; gives its size."""
    jvm = spark._jvm
    store, path = _hadoop(spark, target)
    parts = sorted((f.getPath() for f in store.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    temporary = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    store.setWriteChecksum(False)
    try:
        out = store.create(temporary, True)
        try:
            if head is not None:
                out.write(bytearray((head + "\n").encode()))
            joined = _concatenates(store)
            for part in [] if joined else parts:
                stream = store.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BUFFER, False)
                finally:
                    stream.close()
        finally:
            out.close()
        if joined and parts:  # takes the parts away; an empty file can't be the first in some stores, but the head's may
            names = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
            for k, part in enumerate(parts):
                names[k] = part
            store.concat(temporary, names)
        store.delete(path, False)
        if not store.rename(temporary, path):
            raise OSError(f"{target} can't be renamed into place")
        return store.getFileStatus(path).getLen()
    finally:
        store.delete(temporary, False)
        store.setWriteChecksum(True)


def _concatenates(store) -> bool:
    """Whether files are joined by name alone, as in HDFS."""
    return store.getScheme() == "hdfs"


def write_file(lines: DataFrame, target: str, head: str | None = None, parts: int | None = None) -> int:
    """The lines, in order, as one file; gives its size."""
    from factloom.session import remove

    spark = lines.sparkSession
    folder = scratch_path(spark, "sink")
    ordered(lines, parts).select("line").write.text(folder)
    try:
        return assemble(spark, folder, target, head)
    finally:
        remove(spark, folder)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk) to (at, chunks, size, block): the bytes of all chunks in blocks of BUFFER at most, at their place within the partition."""
    at = 0
    for b in batches:
        column = b.column(0)
        if not len(column):
            continue
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        first, last = int(ends[0]), int(ends[-1])
        cuts = list(range(first, last, BUFFER)) or [first]
        for k, start in enumerate(cuts):  # one by one, as a batch may be large
            size = min(BUFFER, last - start)
            row = (at + start - first, len(column) if k == 0 else 0, size, data.slice(start, size).to_pybytes() if size else b"")
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in row[:3]], pa.array([row[3]], pa.binary())], names=["at", "chunks", "size", "block"])
        at += last - first


BLOCKS = "part bigint, at bigint, chunks bigint, size bigint, block binary"


def _hasher(algorithm: str, state: bytes | None, most: int, last: bool):
    """(block) to (found): the digest if it is the last step, else the state to go on from. most: bytes to take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resumed = state is not None or not last
        h = Sha256(state) if resumed else hashlib.new(algorithm)
        left = most
        for b in batches:
            for x in b.column(0):
                data = x.as_buffer()
                data = data.slice(0, min(left, data.size))
                h.update(data)
                left -= data.size
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest().encode() if last else h.state()], pa.binary())], names=["found"])

    return run


def _steps(rows: list, limit: int) -> Iterator[list]:
    """Index rows (part, step, size) in order, in runs of limit bytes; a longer one is alone."""
    run: list = []
    for r in rows:
        if run and sum(x.size for x in run) + r.size > limit:
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _chained(blocks: DataFrame, algorithm: str, limit: int, whole: int | None = None) -> tuple[str, int, int]:
    """(digest, bytes, chunks) of BLOCKS in the order of part and at. whole: how many bytes they are, where what follows isn't to be hashed.

    Blocks are stored once. A serial hash then goes from task to task: each reads limit bytes or so, and takes its state on to the next.
    """
    from factloom.session import discard

    spark = blocks.sparkSession
    held = materialize(blocks, "digest")
    try:
        step = F.expr(f"at div {limit}L").alias("step")
        index = held.groupBy("part", step).agg(F.sum("size").alias("size"), F.sum("chunks").alias("chunks"), F.collect_set("_metadata.file_path").alias("files")).orderBy("part", "step").collect()  # a row for each part and limit bytes
        size = sum(r.size for r in index)
        left = size = size if whole is None else min(whole, size)
        state, found = None, hashlib.new(algorithm).hexdigest()
        runs = list(_steps(index, limit)) if resumable(algorithm) else [index] if index else []
        for k, run in enumerate(runs):
            at, end = F.struct("part", step), [F.struct(F.lit(r.part).cast("bigint").alias("part"), F.lit(r.step).cast("bigint").alias("step")) for r in (run[0], run[-1])]
            rows = spark.read.schema(BLOCKS).parquet(*sorted({f for r in run for f in r.files})).where((at >= end[0]) & (at <= end[1]))
            few = [F.col("part").between(run[0].part, run[-1].part)] if run[0].part != run[-1].part else [F.col("part") == run[0].part, F.col("at").between(run[0].step * limit, (run[-1].step + 1) * limit - 1)]  # for the reader's own filters
            for f in few:
                rows = rows.where(f)
            last = k == len(runs) - 1
            got = rows.coalesce(1).sortWithinPartitions("part", "at").select("block").mapInArrow(_hasher(algorithm, state, left, last), "found binary").first().found
            state, found = bytes(got), bytes(got).decode() if last else found
            left -= sum(r.size for r in run)
        return found, size, sum(r.chunks for r in index)
    finally:
        discard(held)


def stream_digest(df: DataFrame, order: list[Column | str], chunk: Column, algorithm: str = "sha256", parts: int | None = None, limit: int = READ) -> DataFrame:
    """One row (digest, bytes, chunks): the hash of all chunks in order, null ones left out.

    A serial hash has to see all bytes one after the other. The chunks are range-partitioned and sorted, and written as blocks, by tasks side by
    side; then one task after the other hashes about limit bytes and hands its state to the next, so no task reads or holds more. Without OpenSSL, or
    for another algorithm than SHA-256, the state can't be handed on and one task reads all blocks. For a digest that tasks make side by side use
    `canonical.tree_digest`. Rows equal in the order are taken by their bytes. The work is done when this is called.
    """
    ship(df.sparkSession)
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)]
    rows = df.select(*keys, chunk.cast("binary").alias("chunk")).where("chunk IS NOT NULL")
    blocks = ordered(rows, parts).select("chunk").mapInArrow(_blocks, BLOCKS.split(", ", 1)[1])
    found = _chained(blocks.select(F.spark_partition_id().cast("bigint").alias("part"), "*"), algorithm, limit)
    return df.sparkSession.createDataFrame([found], "digest string, bytes bigint, chunks bigint")


def file_digest(spark: SparkSession, path: str, algorithm: str = "sha256", limit: int = READ) -> DataFrame:
    """One row (name, bytes, digest) of a file of any size, read in splits; its lines may not be longer than a row can be."""
    ship(spark)
    store, target = _hadoop(spark, path)
    size = store.getFileStatus(target).getLen()
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("part"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("chunk"))
    # a partition has one split or several that are whole files, and there is one file: its splits are told apart by where they begin
    blocks = lines.mapInArrow(_split_blocks, BLOCKS)
    digest, have, _ = _chained(blocks, algorithm, limit, size)
    if have != size:
        raise OSError(f"{path} has {size} bytes, and {have} were read")
    return spark.createDataFrame([(target.getName(), size, digest)], "name string, bytes bigint, digest string")


def file_digests(spark: SparkSession, folder: str, limit: int = READ) -> DataFrame:
    """(name, bytes, sha256) of the files in a folder: those over limit bytes in splits, the others whole."""
    store, target = _hadoop(spark, folder)
    found = sorted((f.getPath().getName(), f.getLen()) for f in store.listStatus(target) if f.isFile())
    large = [name for name, size in found if size > limit]
    listed = spark.read.format("binaryFile").load(folder.rstrip("/") + "/*")
    small = listed.where((F.col("length") > 0) & (F.col("length") <= limit)).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame([(name, 0, hashlib.sha256(b"").hexdigest()) for name, size in found if not size], "name string, bytes bigint, sha256 string")  # Spark reads none of them
    return reduce(DataFrame.unionByName, [file_digest(spark, f"{folder}/{name}", limit=limit).withColumnRenamed("digest", "sha256") for name in large], small.unionByName(empty))


def _split_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, chunk) to BLOCKS, of one part after the other."""

    def runs() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            starts = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    yield int(starts[x]), b.slice(x, y - x).select([1])

    for part, group in itertools.groupby(runs(), key=lambda r: r[0]):
        for out in _blocks(b for _, b in group):
            yield pa.RecordBatch.from_arrays([pa.array([part] * out.num_rows, pa.int64()), *out.columns], names=["part", *out.schema.names])


def write_graph(graph, folder: str, parts: int | None = None) -> dict[str, int]:
    """nodes.jsonl, edges.jsonl and triples.csv of a Graph, the bytes that `artifacts.graph_artifacts` gives; sizes by name."""
    from factloom.operators.graph import atom_id

    by: list[Column | str] = ["subject", "predicate", "object"]
    return {
        "nodes.jsonl": write_file(json_line(graph.nodes, ["id"]), f"{folder}/nodes.jsonl", parts=parts),
        "edges.jsonl": write_file(json_line(graph.edges, [*by, atom_id()]), f"{folder}/edges.jsonl", parts=parts),
        "triples.csv": write_file(csv_line(graph.triples, [*by, "source_atom_id"]), f"{folder}/triples.csv", csv_header(graph.triples), parts),
    }
