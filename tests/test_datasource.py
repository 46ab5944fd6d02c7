import os

import pytest
from pyspark.sql import functions as F

from factloom.sources import datasource as S
from factloom.sources import documents as D

GOOD = "---\nid: a.%d\nn: [1, 2]\n---\nbody %d\n"


def tree(tmp_path, n):
    for k in range(n):
        folder = tmp_path / f"d{k % 50}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{k}.md").write_bytes(((GOOD % (k, k)) if k % 7 else f"---\nid: {k}\nno end").replace("\n", "\r\n" if k % 5 == 0 else "\n").encode())
    (tmp_path / "README.md").write_text("skipped")
    (tmp_path / "_hidden.md").write_text("hidden")
    (tmp_path / "d0" / "x.txt").write_text("other")
    return f"file://{tmp_path}"


def test_rows_of_ten_thousand_files(spark, tmp_path):
    path = tree(tmp_path, 10_000)
    columns = ["path", "parts", "name", "bytes", "content", "text", "meta", "body", "parse_error"]
    ours = S.scan(spark, path, skip="README.md")
    theirs = D.read_documents(spark, path).select(columns)
    assert ours.count() == 10_000
    assert ours.select(columns).exceptAll(theirs).isEmpty() and theirs.exceptAll(ours.select(columns)).isEmpty()
    assert ours.where("parse_error is not null").count() == 1429
    assert ours.rdd.getNumPartitions() > 5


def test_listing_alone_opens_nothing(spark, tmp_path):
    path = tree(tmp_path, 20)
    for f in tmp_path.glob("d*/*.md"):
        f.write_bytes(b"\xff")
    listed = S.scan(spark, path, ["path", "bytes"], skip="README.md")
    os.chmod(tmp_path / "d3" / "f3.md", 0)
    assert listed.columns == ["path", "bytes"] and {r.bytes for r in listed.collect()} == {1}
    os.chmod(tmp_path / "d3" / "f3.md", 0o600)
    bad = S.scan(spark, path, ["path", "text", "parse_error"], skip="README.md").collect()
    assert {r.parse_error for r in bad} == {"not UTF-8 at byte 0"} and {r.text for r in bad} == {None}
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format(S.NAME).schema("nope string").load(path).count()


def test_planning_by_size(tmp_path):
    path = tree(tmp_path, 100)
    plan = S._Tree(S.EvidenceDocuments({}).reader.__globals__["StructType"].fromDDL("path string"), {"path": path, "partitionbytes": "1000", "openbytes": "100"})
    parts = plan.dealt(plan.listed())
    assert sum(len(p.files) for p in parts) == 101 and all(sum(f.size + 100 for f in p.files) <= 1000 for p in parts)


def test_flat_and_yaml(spark, tmp_path):
    (tmp_path / "a.yml").write_text("x: 1\n")
    (tmp_path / "b.yml").write_text("- 1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.yml").write_text("y: 2\n")
    rows = {r.name: r for r in S.scan(spark, f"file://{tmp_path}", glob="*.yml", parse="yaml").collect()}
    assert rows["a.yml"].meta == '{"x":1}' and rows["b.yml"].parse_error == "YAML root is not a mapping" and len(rows) == 3
    assert S.scan(spark, f"file://{tmp_path}", ["name"], glob="*.yml", recursive="false").count() == 2
    assert S.scan(spark, f"file://{tmp_path}", ["name"], glob="*.none").count() == 0


def test_write(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(40).select(F.format_string("p%d/f%d.md", F.col("id") % 3, "id").alias("path"), F.format_string(GOOD, "id", "id").alias("text"))
    S.write_tree(rows.repartition(4), path)
    assert S.scan(spark, path, ["meta"]).where("meta is not null").count() == 40
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]
    S.write_tree(rows.limit(2), path, overwrite=True)
    assert S.scan(spark, path, ["path"]).count() == 2
    with pytest.raises(Exception, match="same path"):
        S.write_tree(rows.limit(1).union(rows.limit(1)), path)
    with pytest.raises(Exception, match="leads out"):
        S.write_tree(spark.createDataFrame([("../x", "t")], "path string, text string"), path)
    broken = rows.withColumn("text", F.when(F.col("path") == "p0/f3.md", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        S.write_tree(broken, path)
    assert S.scan(spark, path, ["path"], glob="*").count() == 2


def test_stream(spark, tmp_path):
    path, out = f"file://{tmp_path}/in", f"{tmp_path}/out"
    (tmp_path / "in").mkdir()
    query = lambda: S.scan(spark, path, ["path", "meta"], stream=True, settle="0").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out)
    for k in range(3):
        (tmp_path / "in" / f"{k}.md").write_text(GOOD % (k, k))
        q = query()
        q.awaitTermination(120)
        assert q.exception() is None
        assert sorted(r.path for r in spark.read.schema("path string, meta string").parquet(out).collect()) == [f"{i}.md" for i in range(k + 1)]


def test_lines_across_splits(spark, tmp_path):
    """Numbers of a file in many splits, whose ends fall in lines and in CRLF, with blank lines and all line ends."""
    lines = [("" if k % 11 == 3 else '{"k":%d}' % k if k % 7 else "bad %d" % k) for k in range(5000)]
    ends = ["\r\n", "\n", "\r\n", "\r"]
    (tmp_path / "a b+c.jsonl").write_bytes("".join(x + ends[(k // 1000) % 4] for k, x in enumerate(lines)).encode())
    (tmp_path / "z.jsonl").write_bytes(b'{"z":1}\n\xff\n[1]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", "1000", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = D.read_json_lines(spark, str(tmp_path)).collect()
            own = {r.line: r for r in found if r.path == "a b+c.jsonl"}
            assert own.keys() == {k + 1 for k, x in enumerate(lines) if x}
            for k, x in enumerate(lines):
                if x.startswith("{"):
                    assert own[k + 1].record == x
                elif x:
                    assert own[k + 1].parse_error.startswith(f"a b+c.jsonl:{k + 1}: line is not JSON")
            assert [(r.line, r.record, r.parse_error) for r in sorted(found, key=lambda r: r.line) if r.path == "z.jsonl"] == [(1, '{"z":1}', None), (2, None, "z.jsonl:2: line is not UTF-8"), (3, None, "z.jsonl:3: line is not an object")]
            if size == "64":
                break
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
