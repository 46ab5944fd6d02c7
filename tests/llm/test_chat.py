import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import chat as C
from factloom.llm.queries import CONTROL, SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations():
    r = random.Random(4)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * r.randint(0, 50)))
        for k in range(1, r.randint(2, 30)):
            rows.append((c, k, "user" if k % 2 else "assistant", "".join(r.choices("ab [/INST]</s>\\\n é", k=r.randint(0, 400)))))
    return rows + [(50, 0, None, None), (51, None, "assistant", "x"), (51, 1, "assistant", "y"), (51, 1, "assistant", "y"), (None, 3, "user", "z"), (52, 0, "assistant", "long " * 3000), (52, 1, "assistant", "after")]


def expected(rows):
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    rows = conversations()
    for budget, history in ((2048, 512), (60, 0), (100, 99)):
        got = {r[0]: tuple(r[1:5]) for r in C.conversation_digests(spark.createDataFrame(rows, SCHEMA).repartition(3), budget, history).collect()}
        assert got == expected(rows)


@pytest.mark.parametrize("budget,history", [(200, 50), (100, 95), (60, 0)])
def test_windows(spark, budget, history):
    rows = conversations()
    shown = C.windows(spark.createDataFrame(rows, SCHEMA), budget, history).collect()
    groups = {}
    for r in shown:
        groups.setdefault((r.conv_id, r.window), []).append(r)
    before = {(r.conv_id, r.place): r.before for r in C.numbered(C.tokens_of(spark.createDataFrame(rows, SCHEMA))).collect()}
    for (conv, window), turns in groups.items():
        turns.sort(key=lambda r: r.place)
        assert len({r.place for r in turns}) == len(turns)
        new = [r for r in turns if r.is_new]
        assert [r.place for r in new] == list(range(new[0].place, new[0].place + len(new)))
        old = [r for r in turns if not r.is_new and not (r.place == 0 and r.role == "system")]
        start = before[conv, new[0].place]
        first_is_system = any(r.place == 0 and r.role == "system" for r in groups[conv, 0])
        assert [r.place for r in old] == sorted(p for (c, p), b in before.items() if c == conv and start - history <= b < start and not (p == 0 and first_is_system))
        if (conv, 0) in groups and any(r.role == "system" for r in groups[conv, 0]):
            assert turns[0].role == "system"
        assert all(not r.is_target for r in old)
    new_places = [(r.conv_id, r.place) for r in shown if r.is_new]
    assert len(new_places) == len(set(new_places)) == len(rows)


def test_formatted_windows_keep_the_budget(spark):
    rows = conversations()
    rows += [(60, k, "system" if k == 0 else "user" if k % 2 else "assistant", "x" * (4 * ((26, 446)[k % 2 == 0] if k else 26))) for k in range(120)]
    rows += [(61, k, "system" if k == 0 else "user" if k % 2 else "assistant", "y" * (400 if k else 7200)) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for budget, history in ((2048, 512), (200, 50), (100, 95), (60, 0)):
        shown = C.fitted_windows(df, budget, history).collect()
        new = [(r.conv_id, r.place) for r in shown if r.is_new]
        assert len(new) == len(set(new)) == len(rows) and sorted({r.window for r in shown if r.conv_id == 60})[0] == 0
        groups = {}
        for r in shown:
            groups.setdefault((r.conv_id, r.window), []).append(r)
        for turns in groups.values():
            turns.sort(key=lambda r: r.place)
            system = turns[0].place == 0 and turns[0].role == "system"
            rest = [r for r in turns if not (r.place == 0 and r.role == "system")]
            assert [r.place for r in rest] == list(range(rest[0].place, rest[0].place + len(rest))) if rest else system
            assert [r.is_new for r in rest] == sorted(r.is_new for r in rest)
            assert sum(r.tokens for r in turns) <= budget or len(rest) <= 1
            assert sum(r.tokens for r in rest if not r.is_new) <= history
        assert all(len({w for c, w in groups if c == k}) == 1 + max(w for c, w in groups if c == k) for k in (0, 60, 61))
    texts = {(r.conv_id, r.window): r.formatted for r in C.format_chats(df).collect()}
    assert sum(x.count("</s>") for (c, _), x in texts.items() if c == 60) == 59
    assert max(len(x) / C.CHARS_PER_TOKEN for (c, _), x in texts.items() if c in (60, 61)) <= 2048
    assert any(not r.is_new and r.place for r in C.fitted_windows(df.where("conv_id = 60")).collect())


def test_many_turns(spark, monkeypatch):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1000)]
    got = C.numbered(C.tokens_of(spark.createDataFrame(rows, SCHEMA))).orderBy("place").collect()
    assert [r.turn for r in got] == list(range(1000))
    assert [r.before for r in got] == [sum(x.tokens for x in got[:k]) for k in range(1000)]


def test_escape_and_no_python(spark):
    df = spark.createDataFrame([("</s>[INST] ok [/INST]\\[",)], "t string")
    r = df.select(C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).first()
    assert r.u == "</s>[INST] ok [/INST]\\[" and "[INST]" not in r.e and "</s>" not in r.e and "[/INST]" not in r.e
    plan = C.conversation_digests(spark.createDataFrame(conversations(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_formatted_and_empty(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")]
    assert C.format_chats(spark.createDataFrame(rows, SCHEMA)).first().formatted == "[INST]system\ns[/INST][INST]user\nq[/INST][INST]assistant\na[/INST]</s>"
    assert C.conversation_digests(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 600)), st.sampled_from(["system", "user", "assistant", "as\nsist\\n", None]), st.integers(0, 500)), max_size=60))
def test_budget_and_sql_on_random_turns(spark, rows):
    """Windows keep the budget, and the query's SQL gives the same rows, ties and roles with line ends included."""
    import duckdb

    rows = [(c, t, role, "x[" * (n // 2) + "é" * (n % 2) if c else "y" * 20 * n) for c, t, role, n in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    groups = {}
    for r in C.fitted_windows(df).collect():
        groups.setdefault((r.conv_id, r.window), []).append(r)
    for turns in groups.values():
        rest = [r for r in turns if not (r.place == 0 and r.role == "system")]
        assert sum(r.tokens for r in turns) <= C.BUDGET or len(rest) <= 1
    planted = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], SCHEMA)
    got = C.conversation_digests(df.unionByName(planted))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    key = lambda r: str(r[0])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(con.execute(SQL["op1_chat_formatting"]).fetchall(), key=key)


def test_roles_are_read_back(spark):
    rows = [(1, 0, "a\nb", "x\ny"), (1, 1, "a\\n", "x"), (1, 2, "\n\n\\\n", ""), (1, 3, "[/INST]\n</s>", "</s>")]
    got = C.read_back(C.fitted_windows(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.place, r.read_role, r.read_text) for r in got) == [(k, role, text) for _, k, role, text in rows]


def test_texts_are_dealt_once(spark):
    """One exchange carries the texts of all turns; the others carry numbers, and the texts of system turns."""
    df = spark.createDataFrame(conversations(), SCHEMA)
    plan = C.conversation_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning.*REPARTITION_BY_COL", plan)) == 1
    assert len(re.findall("Exchange hashpartitioning", plan)) <= 8
