import hashlib
import json
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import canonical as C
from factloom.functions import json_schema as J
from factloom.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize("text,blank", [("", True), (" \t", True), ("\u3000", True), ("\x1c\x1f", True), ("\u200b", False), ("x", False), (None, True)])
def test_blank(spark, text, blank):
    assert one(spark, X.is_blank(F.col("a")), a=text) is blank


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n", "\u3000x\x1c ", "abc\n")], "a string, b string, c string")
    r = df.select(X.normal_eol(F.col("a")), X.strip(F.col("b")), X.full_match(F.col("c"), "abc"), X.search(F.col("c"), "B", True), X.leaks(F.col("c"), {"one": "AB", "two": "zz", "three": "c"})).first()
    assert tuple(r) == ("a\nb\nc\n", "x", False, True, ["one", "three"])
    ids = df.select(X.dense_ids("A-", 7, 9)).first()[0]
    assert ids == ["A-007", "A-008", "A-009"]


def test_sets(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b", "a"], None)], "a array<string>, b array<string>, c array<string>")
    r = df.select(X.same_set("a", "b"), X.same_multiset("a", "b"), X.is_subset(F.col("a"), F.col("b")), X.missing(F.col("a"), F.col("c")), X.is_subset(F.col("c"), F.col("a"))).first()
    assert tuple(r) == (True, False, True, ["a", "b"], True)


@pytest.mark.parametrize("value,truth", [("true", True), ("false", False), ("0", False), ('""', False), ("[]", False), ("{}", False), ("null", False), ('"false"', True), ("1", True), ('{"a":null}', True)])
def test_truthy(spark, value, truth):
    assert one(spark, X.truthy(F.parse_json("a")), a=value) is truth


def test_variants(spark):
    r = spark.createDataFrame([('{"a": "true", "b": true, "c": null}',)], "j string").withColumn("v", F.parse_json("j"))
    got = r.select(X.variant_kind(F.variant_get("v", "$.a", "variant")), X.variant_kind(F.variant_get("v", "$.b", "variant")), X.all_keys(F.col("v"), ["a", "c"]), X.all_keys(F.col("v"), ["d"])).first()
    assert tuple(got) == ("STRING", "BOOLEAN", True, False)


def test_canonical(spark):
    value = {"b": [1.0, 1, True, None], "a": {"z": "\u4e2d", "y": "\x1f"}}
    text = json.dumps(value)
    want = hashlib.sha256(C.canonical_json(value).encode()).hexdigest()
    assert C.canonical_json(value) == '{"a":{"y":"\\u001f","z":"\u4e2d"},"b":[1.0,1,true,null]}'
    assert one(spark, C.canonical_sha256(F.col("a")), a=text) == want
    assert one(spark, C.canonical_sha256(F.col("a")), a="no json") is None
    assert one(spark, C.canonical_sha256(F.col("a"), ("b",)), a=text) == C.canonical_hash({"a": value["a"]})


def test_blob_sha1(spark, tmp_path):
    data = "h\u00e9llo\n".encode()
    (tmp_path / "f").write_bytes(data)
    got = spark.createDataFrame([(data,)], "c binary").select(C.blob_sha1(F.col("c")), C.file_sha256(F.col("c"))).first()
    want = subprocess.run(["git", "hash-object", str(tmp_path / "f")], capture_output=True, text=True, check=True).stdout.strip()
    assert tuple(got) == (want, hashlib.sha256(data).hexdigest())


def test_ordered_digest(spark):
    rows = [("a/b.md", "x\r\ny"), ("a-b/c.md", "z"), ("a/a.md", "w")]
    h = hashlib.sha256()
    for p, t in sorted(rows, key=lambda r: r[0].split("/")):
        h.update(p.encode() + b"\0" + t.replace("\r\n", "\n").encode() + b"\0")
    for n in (1, 3):
        df = spark.createDataFrame(rows, "p string, t string").repartition(n)
        got = df.agg(C.ordered_digest(F.split("p", "/"), C.document_chunk(F.col("p"), F.col("t")))).first()[0]
        assert got == h.hexdigest()
    tree = [spark.createDataFrame(x, "p string, t string").agg(C.tree_digest(F.col("p"), F.encode("t", "UTF-8"))).first()[0] for x in (rows, rows[::-1])]
    assert tree[0] == tree[1] != h.hexdigest()


CASES = [
    ({"type": "string"}, "a", 1), ({"type": ["string", "null"]}, None, 1), ({"type": "integer"}, 1.0, True), ({"const": 1}, 1.0, True), ({"enum": [0, "x"]}, "x", False), ({"required": ["a"]}, {"a": None}, {}),
    ({"properties": {"a": {"type": "number"}}, "additionalProperties": False}, {"a": 1}, {"b": 1}), ({"additionalProperties": {"type": "string"}}, {"k": "v"}, {"k": 1}), ({"items": {"minimum": 2}}, [2, 3], [1]), ({"minItems": 1}, [0], []), ({"maxItems": 1}, [0], [0, 1]),
    ({"uniqueItems": True}, [1, True, "1"], [1, 1.0]), ({"contains": {"const": 1}, "minContains": 2}, [1, 2, 1], [1, 2]), ({"minLength": 2}, "\U0001f600\U0001f600", "\U0001f600"), ({"maxLength": 1}, "\U0001f600", "ab"), ({"pattern": "b+"}, "abc", "ac"),
    ({"minimum": 1}, 1, 0), ({"maximum": 1}, 1, 2), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 2, 3), ({"anyOf": [{"type": "null"}, {"minimum": 5}]}, 5, 4), ({"oneOf": [{"minimum": 1}, {"minimum": 5}]}, 2, 6), ({"not": {"type": "null"}}, 0, None),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["v"]}, "else": {"required": ["w"]}}, {"w": 0}, {"k": 1}), ({"if": {"properties": {"k": {"const": 1}}}, "then": {"required": ["v"]}}, {"v": 1}, {}),
]


@pytest.mark.parametrize("schema,good,bad", CASES)
def test_keywords(schema, good, bad):
    assert J.validate(good, schema) == [] and J.validate(bad, schema) and J.check_schema(schema) == []


def test_schema_column(spark):
    schema = {"type": "object", "required": ["b", "a"], "properties": {"a": {"type": "string"}, "d": {"format": "date-time"}}}
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": 2, "d": "no"}',), ("{",)], "j string")
    rows = df.select(J.schema_problems(F.col("j"), schema).alias("p")).select("p", J.first_problem(F.col("p")).alias("f")).collect()
    assert [(p.path, p.keyword) for p in rows[0].p] == [("", "required"), ("/a", "type")] and rows[0].f.keyword == "required"
    assert rows[1].p == [] and rows[1].f is None and rows[2].f.keyword == "json"
    assert J.validate({"d": "no"}, {"properties": {"d": {"format": "date-time"}}}, strict=True)
    assert J.validate({"d": "2020-01-01T00:00:00Z"}, {"properties": {"d": {"format": "date-time"}}}, strict=True) == []
    for bad in ({"type": "text"}, {"unknownKeyword": 1}, {"pattern": "("}, {"minimum": True}, {"properties": []}, {"allOf": []}):
        with pytest.raises(ValueError):
            J.schema_problems(F.col("j"), bad)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(json_values, json_values)
def test_not_and_const_are_complements(a, b):
    same = J.key(a) == J.key(b)
    assert (J.validate(a, {"const": b}) == []) is same
    assert (J.validate(a, {"not": {"const": b}}) == []) is not same
