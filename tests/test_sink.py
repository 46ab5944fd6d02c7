import hashlib
import os

import pytest
from pyspark.sql import functions as F

from factloom.functions.canonical import document_chunk
from factloom.operators import artifacts, corpus, sink
from factloom.plans.queries import QUERIES

ODD = ["plain", 'with "quotes"', "a,b", "line\nbreak", "cr\rhere", "", None, "中\u0001", " lead", "z'"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k % 97, f"k{k:04d}", ODD[k % len(ODD)], '{"b":1,"a":[%d]}' % k) for k in range(2000)], "n int, id string, text string, qualifiers string").repartition(7)


def test_same_bytes_as_the_driver(spark, rows, tmp_path):
    size = sink.write_file(sink.json_line(rows, ["id"]), f"file://{tmp_path}/x.jsonl", parts=5)
    want = artifacts.json_lines(rows, ["id"])
    assert (tmp_path / "x.jsonl").read_bytes() == want and size == len(want)
    table = rows.select("id", "text", "n")
    sink.write_file(sink.csv_line(table, ["n", "id"]), f"file://{tmp_path}/x.csv", sink.csv_header(table), 5)
    assert (tmp_path / "x.csv").read_bytes() == artifacts.triples_csv(table, ["n", "id"])
    one = rows.select("text")
    sink.write_file(sink.csv_line(one, ["text"]), f"file://{tmp_path}/one.csv", sink.csv_header(one), 3)
    assert (tmp_path / "one.csv").read_bytes() == artifacts.triples_csv(one, ["text"])
    assert sorted(os.listdir(tmp_path)) == ["one.csv", "x.csv", "x.jsonl"]  # nothing temporary stays


def test_index(spark, rows, tmp_path):
    parts = sink.write_parts(sink.json_line(rows, ["n"]), f"file://{tmp_path}/p", "head", 6).orderBy("part").collect()
    whole = b"head\n" + b"".join((tmp_path / "p" / r.part).read_bytes() for r in parts)
    sink.assemble(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/whole", "head")
    assert (tmp_path / "whole").read_bytes() == whole and len(parts) > 1
    for r in parts:
        assert whole[r.offset : r.offset + r.bytes] == (tmp_path / "p" / r.part).read_bytes()


def test_one_order_value_is_spread(spark, tmp_path):
    many = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"))
    parts = sink.write_parts(sink.csv_line(many, ["k"]), f"file://{tmp_path}/p", None, 5).collect()
    assert len(parts) == 5 and max(r.bytes for r in parts) < 0.5 * sum(r.bytes for r in parts)


def test_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select(F.col("id").alias("o0"), F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("line"))
    with pytest.raises(Exception, match="stop"):
        sink.write_file(bad, f"file://{tmp_path}/never")
    assert os.listdir(tmp_path) == []


def test_stream_digest(spark, rows):
    docs = rows.select("id", F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("x"), F.col("n"))).alias("text"))
    want = hashlib.sha256(b"".join(r.id.encode() + b"\0" + r.text.replace("\r\n", "\n").replace("\r", "\n").encode() + b"\0" for r in docs.orderBy("id").collect())).hexdigest()
    got = sink.stream_digest(docs, ["id"], document_chunk(F.col("id"), F.col("text")), parts=6).first()
    assert (got.digest, got.chunks) == (want, 2000)
    assert sink.stream_digest(docs.limit(0), ["id"], F.col("text")).first().digest == hashlib.sha256(b"").hexdigest()


def test_corpus_file(spark, rows, tmp_path):
    docs = rows.select("id", F.concat(F.col("id"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    sink.write_file(sink.corpus_line(docs), f"file://{tmp_path}/c.md", "# Title", 4)
    assert (tmp_path / "c.md").read_bytes().decode() == corpus.corpus_text(docs, "# Title").first().corpus


def test_empty(spark, rows, tmp_path):
    sink.write_file(sink.json_line(rows.limit(0), ["id"]), f"file://{tmp_path}/e")
    assert (tmp_path / "e").read_bytes() == b""


def test_no_task_reads_the_whole_stream(spark, rows):
    docs = rows.select("id", F.repeat(F.col("id"), F.col("n") * 20).alias("text"))
    whole = b"".join(r.id.encode() + b"\0" + r.text.encode() + b"\0" for r in docs.orderBy("id").collect())
    jobs = {}
    for parts, limit in ((3, 1 << 30), (3, 2_000_000), (40, 3_000_000)):
        spark.sparkContext.setJobGroup(name := f"digest-{parts}-{limit}", name)
        got = sink.stream_digest(docs, ["id"], document_chunk(F.col("id"), F.col("text")), parts=parts, limit=limit).first()
        jobs[limit] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        assert tuple(got) == (hashlib.sha256(whole).hexdigest(), len(whole), 2000)
    assert min(jobs[2_000_000], jobs[3_000_000]) >= jobs[1 << 30] + len(whole) // 3_000_000  # a job of one task for each limit bytes
    got = sink.stream_digest(docs, ["id"], document_chunk(F.col("id"), F.col("text")), "md5", limit=100_000).first()
    assert got.digest == hashlib.md5(whole).hexdigest()


def test_no_task_holds_a_sorter_for_each_partition(spark):
    sc = spark._jsc.sc()

    def most(parts: int) -> int:
        """Peak memory of one task of manifest_file with so many partitions."""
        old, (tracker, group) = spark.conf.get("spark.sql.shuffle.partitions"), (spark.sparkContext.statusTracker(), f"manifest-{parts}")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert QUERIES["manifest_file"](spark, "/root/testdata/sf0.001").count() == 1
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        sc.listenerBus().waitUntilEmpty()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        tasks = [found.apply(k).taskMetrics() for s in stages for found in [sc.statusStore().taskList(s, 0, 10_000)] for k in range(found.size())]
        return max(t.get().peakExecutionMemory() for t in tasks if t.isDefined())

    few, many = most(3), most(24)
    assert 0 < many < 1.5 * few


def test_large_chunk_is_cut(spark):
    one = spark.sql("SELECT 'k' AS k, repeat('abcdefg', 700000) AS t UNION ALL SELECT 'a', '' UNION ALL SELECT 'z', NULL")
    got = sink.stream_digest(one, ["k"], F.col("t"), limit=1_500_000).first()
    assert tuple(got) == (hashlib.sha256(b"abcdefg" * 700_000).hexdigest(), 4_900_000, 2)


def test_blocks_of_a_part_in_several_files(spark):
    one = spark.sql("SELECT 'k' AS k, repeat('abcdefg', 700000) AS t")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        for limit in (1_500_000, sink.READ):
            got = sink.stream_digest(one, ["k"], F.col("t"), limit=limit).first()
            assert tuple(got) == (hashlib.sha256(b"abcdefg" * 700_000).hexdigest(), 4_900_000, 1)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_digests_of_files_in_splits(spark, tmp_path):
    lines = b"".join(b"%d,%s\r\n\n" % (k, b"x" * (k % 300)) for k in range(30_000))
    for name, data in (("a", lines), ("b", lines[:-1]), ("c", lines + b"no end"), ("d", b"\n" * 3_000_000), ("e", b""), ("f", b"small\n")):
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700000")
    try:
        got = {r.name: (r.bytes, r.sha256) for r in sink.file_digests(spark, f"file://{tmp_path}", limit=2_000_000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n in "abcdef" for b in [(tmp_path / n).read_bytes()]}
