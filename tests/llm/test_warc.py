import base64
import gzip
import hashlib
from urllib.parse import urlparse

from factloom.llm import warc as W

ROWS = [(1, "http://a/", "<p>x"), (2, "http://b/ c\r\nWARC-Type: evil", "<p>x"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é\r\n\r\nWARC/1.1\r\n" * 4000), (6, "http://f/", "\U0001f600" * 999), (None, "http://g/", "<p>x"), (7, "u", "solo"), (7, "u", "solo")]
SCHEMA = "page_id bigint, url string, html string"


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out += [(str(i), len(data), digest, "revisit" if k else "response", str(ids[0]) if k else "None") for k, i in enumerate(ids)]
    return sorted(out)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for chunk in (W.CHUNK_CHARS, 7):
        manifest = W.write_archives(df, chunk_chars=chunk)
        got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in W.read_archives(manifest).collect())
        assert got == expected(ROWS)
        payloads = {}
        for r in sorted(W.read_archives(manifest, with_payload=True).where("record_type = 'response'").collect(), key=lambda r: r.chunk):
            payloads.setdefault(r.page_id, b"")
            payloads[r.page_id] += bytes(r.payload)
        assert payloads == {1: b"<p>x", 3: b"", 5: ROWS[4][2].encode(), 6: ROWS[5][2].encode(), 7: b"solo"}


def test_files_are_warc(spark):
    manifest = W.write_archives(spark.createDataFrame(ROWS, SCHEMA)).collect()
    text = b"".join(gzip.open(urlparse(r.file).path).read() for r in manifest)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) and b"\r\nWARC-Type: evil" not in text
    assert sum(r.records for r in manifest) == len(ROWS)


def test_least_and_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kinds = {r.record_type for r in W.read_archives(W.write_archives(df, least=5)).where("payload_bytes < 5").collect()}
    assert kinds == {"response"}
    assert W.read_archives(W.write_archives(df.limit(0))).count() == 0


def test_headers_and_files_left_behind(spark, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "records-000000-99999.warc.gz").write_bytes(b"of a lost attempt")
    manifest = W.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2), folder=folder, date="2024-05-06T07:08:09Z")
    files = {urlparse(r.file).path for r in manifest.collect()}
    assert {str(p) for p in tmp_path.iterdir() if not p.name.startswith(".")} == files
    for name in files:
        text = gzip.open(name).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Record-ID: ") and text.count(b"WARC-Type: warcinfo") == 1
        for record in text.split(b"WARC/1.1\r\nWARC-Type: ")[1:]:
            head, http, body = record.split(b"\r\n\r\n", 2)
            headers = dict(line.split(b": ", 1) for line in (b"WARC-Type: " + head).split(b"\r\n"))
            block = (http + b"\r\n\r\n" + body)[: int(headers[b"Content-Length"])]
            assert headers[b"WARC-Block-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
            assert headers[b"WARC-Date"] == b"2024-05-06T07:08:09Z"
            assert (headers[b"WARC-Type"] == b"revisit") == (b"WARC-Refers-To" in headers)
            assert headers.get(b"X-Refers-To-Page") == b"3" or (b"WARC-Refers-To-Target-URI" in headers) == (b"WARC-Refers-To" in headers)  # page 3 has no url


def test_large_payload_is_cut_in_linear_time(spark):
    import time

    page = "é" * (8 << 20)
    began = time.perf_counter()
    manifest = W.write_archives(spark.createDataFrame([(1, "u", page)], SCHEMA), chunk_chars=1 << 12)
    r = W.read_archives(manifest).first()
    assert r.payload_digest == base64.b32encode(hashlib.sha1(page.encode()).digest()).decode() and time.perf_counter() - began < 60


def test_store_names():
    assert W.store_of("file:///tmp/x", None)[1] == "/tmp/x"
    local = W.fs.LocalFileSystem()
    assert W.store_of("s3a://bucket/a/b", local) == (local, "bucket/a/b") and W.store_of("hdfs://host:8020/a", local)[1] == "/a"
