"""WARC archives by way of a chunked record table.

Payloads become rows (record, chunk number, bytes): a task walks over each payload's UTF-8 bytes where they lie and sends a
row for every `chunk_chars` of them, so no later step holds a whole one. Digests are carried
incrementally from chunk to chunk. Of records with equal payloads the one of smallest page id is written as a
response, the others as revisits of it. Tasks stream the chunk rows into gzip members of WARC
files in the shared folder; a file counts once its task has reported it, so lost or repeated attempts leave no
records behind; files that no task has reported are deleted. Every file begins with a warcinfo record. Folders are
named as Spark names them; a pyarrow filesystem may be given for stores that it can't tell from the name. Reading streams the files back and checks every digest.

Defined results: null html is an empty payload; among equal payloads ties of the page id go to the first
row, and null ids come last; a null url is written without target; repeated rows are records of their own; an
empty table writes no file; other input columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import discard, materialize, partitions, scratch_path, ship

CHUNK_CHARS = 1 << 18
SPACE = uuid.UUID("6f1f1c1e-4a1f-5d58-9f5b-0f3f1a4ce0a1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGESTS = "record bigint, page_id bigint, url string, bytes bigint, sha1 binary, sha256 binary, block binary"
MANIFEST = "file string, records bigint, bytes bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, chunk int, payload binary"


def record_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(record, page_id, url, chunk, chunks, bytes, payload), payloads zstd-compressed chunk by chunk; written to the shared folder."""
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    return materialize(rows.mapInArrow(_cut(chunk_chars), CHUNKS), "warc-chunks")


CHUNKS = "record bigint, page_id bigint, url string, chunk int, chunks int, size bigint, payload binary"
#: Compressed bytes that a task gathers before it sends them on.
SEND = 4 << 20


def _cut(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, schema = zstandard.ZstdCompressor(level=3).compress, pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("size", pa.int64()), ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for record, page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                data = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                chunks = max(1, -(-len(data) // chunk))
                for k in range(chunks):
                    part = pack(data[k * chunk : (k + 1) * chunk])
                    rows.append((record, page, url, k, chunks, len(data), part))
                    held += len(part) + 100
                    if held > SEND:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record, page_id, url, chunk, chunks, size, payload), a record's chunks in order and together."""
    sha1 = sha256 = block = None
    n, unpack = 0, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[tuple] = []
        keys = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
        for (record, page, url, chunk, chunks, size), payload in zip(keys, batch.column(6), strict=True):
            if chunk == 0:
                sha1, sha256, block, n = hashlib.sha1(), hashlib.sha256(), hashlib.sha1(http_header(size)), 0
            data = unpack(payload.as_buffer())
            for digest in (sha1, sha256, block):
                digest.update(data)
            n += len(data)
            if chunk == chunks - 1:
                out.append((record, page, url, n, sha1.digest(), sha256.digest(), block.digest()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["record", "page_id", "url", "bytes", "sha1", "sha256", "block"])


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_types(chunks: DataFrame, least: int = 0) -> DataFrame:
    """(record, bytes, sha1, block, type, of_record, of_page, of_url) for every record; payloads under `least` bytes are all responses."""
    cols = ["record", "page_id", "url", "chunk", "chunks", "size", "payload"]
    whole = chunks.where("chunks = 1").select(cols).mapInArrow(_digests, DIGESTS)
    long = chunks.where("chunks > 1").select(cols).repartition(partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk").mapInArrow(_digests, DIGESTS)
    digests = materialize(whole.unionByName(long), "warc-digests")
    order = F.struct(F.col("page_id").isNull().alias("_last"), F.col("page_id").alias("of_page"), F.col("record").alias("of_record"), F.col("url").alias("of_url"))
    firsts = digests.where(F.col("bytes") >= least).groupBy("sha256", "bytes").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("sha256", "bytes", "_first.of_page", "_first.of_record", "_first.of_url")
    joined = digests.join(firsts, ["sha256", "bytes"], "left")
    again = F.col("of_record").isNotNull() & (F.col("of_record") != F.col("record"))
    of = [F.when(again, F.col(c)).alias(c) for c in ("of_record", "of_page", "of_url")]
    out = joined.select("record", "bytes", "sha1", "block", F.when(again, "revisit").otherwise("response").alias("type"), *of)
    out._digests = digests
    return out


def _urn(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(record))}>"


def http_header(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _uri(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&()*+,;=%~" + chr(39))


def header(record: int, page: int | None, url: str | None, kind: str, n: int, sha1: bytes, block: bytes, of_record: int | None, of_page: int | None, of_url: str | None, date: str) -> bytes:
    """The WARC header and the HTTP header of the block."""
    http = http_header(n)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{_base32(sha1)}", f"WARC-Block-Digest: sha1:{_base32(block if kind == 'response' else hashlib.sha1(http).digest())}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(of_record)}", f"WARC-Refers-To-Date: {date}"]
        if of_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(of_url)}")
        if of_page is not None:
            lines.append(f"X-Refers-To-Page: {of_page}")
    if page is not None:
        lines.append(f"X-Page: {page}")
    lines += [f"X-Payload-Length: {n}", f"Content-Length: {len(http) + (n if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def file_info(name: str, date: str) -> bytes:
    """The warcinfo record that begins a file."""
    fields = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>", "WARC-Type: warcinfo", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + fields + b"\r\n\r\n"


def store_of(uri: str, store: fs.FileSystem | None) -> tuple[fs.FileSystem, str]:
    """The filesystem of a folder or file as Spark names it, and the path there."""
    if store is not None:
        return store, urlsplit(uri).netloc + urlsplit(uri).path if urlsplit(uri).scheme not in ("", "file", "hdfs", "viewfs") else urlsplit(uri).path
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _write(folder: str, date: str, level: int, store: fs.FileSystem | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (record, page_id, url, chunk, chunks, payload, bytes, sha1, block, type, of_record, of_page, of_url), sorted by record and chunk."""
        context = TaskContext.get()
        to, base = store_of(folder, store)
        name = f"records-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out = squeeze = None
        records, size, unpack = 0, 0, zstandard.ZstdDecompressor().decompress

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                size += len(data)
                out.write(data)

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12)), strict=True)
            for (record, page, url, chunk, chunks, n, sha1, block, kind, of_record, of_page, of_url), payload in zip(keys, batch.column(5), strict=True):
                if out is None:
                    to.create_dir(base, recursive=True)
                    out = to.open_output_stream(f"{base}/{name}", compression=None)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(squeeze.compress(file_info(name, date)) + squeeze.flush())
                if chunk == 0:
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(squeeze.compress(header(record, page, url, kind, n, sha1, block, of_record, of_page, of_url, date)))
                if kind == "response":
                    put(squeeze.compress(unpack(payload.as_buffer())))
                if chunk == chunks - 1:
                    put(squeeze.compress(b"\r\n\r\n"))
                    put(squeeze.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, date: str | None = None, least: int = 0, level: int = 6, chunk_chars: int = CHUNK_CHARS, store: fs.FileSystem | None = None, **names: str) -> DataFrame:
    """Write the archives; the result is their manifest (file, records, bytes). date: of all records, now if not given."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    chunks = record_table(pages, chunk_chars=chunk_chars, **names)
    types = record_types(chunks, least)
    n = max(partitions(spark), chunks.rdd.getNumPartitions())
    # explicit partitions on both sides: a record's chunks stay in one task
    rows = chunks.repartition(n, "record").join(types.repartition(n, "record"), "record")
    rows = rows.where("type = 'response' or chunk = 0").withColumn("chunks", F.when(F.col("type") == "response", F.col("chunks")).otherwise(1))
    ordered = rows.select("record", "page_id", "url", "chunk", "chunks", F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "bytes", "sha1", "block", "type", "of_record", "of_page", "of_url").sortWithinPartitions("record", "chunk")
    done = materialize(ordered.mapInArrow(_write(folder, date, level, store), MANIFEST), "warc-manifest")
    discard(chunks)
    discard(types._digests)
    _sweep(done, folder, store)
    return done


def _sweep(manifest: DataFrame, folder: str, store: fs.FileSystem | None) -> None:
    """Delete the files of attempts that were lost or repeated: as many names as tasks come to the driver."""
    kept = {r.file.rsplit("/", 1)[-1] for r in manifest.select("file").collect()}
    to, base = store_of(folder, store)
    for info in to.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if re.fullmatch(r"records-\d{6}-\d+\.warc\.gz", info.base_name) and info.base_name not in kept:
            to.delete_file(info.path)


BUFFER = 1 << 20


class Member:
    """The bytes of a multi-member gzip stream, asked for piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.inflate, self.ready = stream, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            data = data or self.stream.read(BUFFER)
            if not data:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if got := self.inflate.decompress(data, BUFFER):
                self.ready += got
                return True

    def until(self, mark: bytes, most: int = 1 << 22) -> bytes | None:
        """Up to and with mark; None at the end of the stream."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > most:
                raise ValueError("a header without end")
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends within a header")
                return None
        at += len(mark)
        out, self.ready = self.ready[:at], self.ready[at:]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("the archive ends within a record")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def read_records(stream) -> Iterator[tuple[dict[str, str], Iterator[bytes], int]]:
    """(headers, payload pieces, payload length) of each record but warcinfo; the pieces must be used up before the next."""
    source = Member(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not re.fullmatch(r"WARC/1\.\d", lines[0]):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:] if x)
        n = int(headers["Content-Length"])
        if headers["WARC-Type"] == "warcinfo":
            for _ in source.pieces(n):
                pass
        else:
            n -= len(source.until(b"\r\n\r\n"))
            yield headers, source.pieces(n), n
        if b"".join(source.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record without its end")


def _read(with_payload: bool, store: fs.FileSystem | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "chunk", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                at, path = store_of(file, store)
                with at.open_input_stream(path, compression=None) as stream:
                    for headers, pieces, n in read_records(stream):
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        page, of_page = (int(headers[k]) if k in headers else None for k in ("X-Page", "X-Refers-To-Page"))
                        length = int(headers["X-Payload-Length"])
                        sha1, chunk = hashlib.sha1(), 0
                        for piece in pieces:
                            sha1.update(piece)
                            if with_payload:
                                rows.append((page, length, digest, kind, of_page, headers.get("WARC-Target-URI"), chunk, piece))
                                chunk, held = chunk + 1, held + len(piece)
                                if held > 8 << 20:
                                    yield out()
                                    rows, held = [], 0
                        if kind == "response" and (n != length or base64.b32encode(sha1.digest()).decode() != digest):
                            raise ValueError(f"the payload of page {page} in {file} isn't what its header says")
                        if not with_payload or not chunk:
                            rows.append((page, length, digest, kind, of_page, headers.get("WARC-Target-URI"), 0, None if not with_payload else b""))
                        if len(rows) >= 5000:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return run


def read_archives(manifest: DataFrame, with_payload: bool = False, store: fs.FileSystem | None = None) -> DataFrame:
    """Records of the files named by manifest, chunk rows when payloads are asked for; every digest is checked."""
    ship(manifest.sparkSession)
    files = manifest.select("file")
    out = files.repartition(max(1, files.count())).mapInArrow(_read(with_payload, store), READ)
    return out if with_payload else out.drop("chunk", "payload")
