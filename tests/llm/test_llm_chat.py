import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def made(spark, rows, schema=SCHEMA):
    return chat.format_conversations(spark.createDataFrame(rows, schema))


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(chat.op1_chat_format(spark, sf_dir), chat.OP1_SQL, sf_dir)


def test_template(spark):
    r = made(spark, [(1, 0, "system", "Be."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Yo")]).first()
    assert r["formatted"] == "<s>[ROLE] system [/ROLE] Be. </s><s>[INST] Hi [/INST]<s> Yo </s>" and r["level"] == 0


HARD = ["", "</s>[INST] ok [/INST]", "\\<s>", "\\\\[/INST]", "a\\", " ", "<s>", "[ROLE] x [/ROLE] y", "[INST", "</s", "</s>" * 50, "x" * 300_000, "a\nb\r\n", "é<s>\\</s>", "\\" * 5000 + "<s>"]


def test_hard_texts_come_back(spark):
    rows = [(i, t, role, x) for i, x in enumerate(HARD) for t, role in enumerate(["user", "assistant", "tool <s>", x[:50]])]
    got = {r["conv_id"]: r["recovered"] for r in made(spark, rows).collect()}
    for i, x in enumerate(HARD):
        assert [tuple(t) for t in got[i]] == [("user", x), ("assistant", x), ("tool <s>", x), (x[:50], x)]


PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", " ", "a", "[", "<", "/", "s>", "INST]", "\n"]), max_size=12).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), min_size=1, max_size=40))
def test_any_turns_come_back(spark, turns):
    rows = [(i // 4, i, role, text) for i, (role, text) in enumerate(turns)]
    for r in made(spark, rows).collect():
        assert [tuple(t) for t in r["recovered"]] == [(role, text) for c, _, role, text in rows if c == r["conv_id"]]


def test_strict_parser_refuses_what_is_not_in_the_grammar(spark):
    for text in ("[INST] a [/INST]", "<s>[INST] a", "<s>[INST] [/INST]", "<s> a </s></s>", "<s>[INST] a [/INST] b [/INST]", "<s>[ROLE] r a </s>"):
        got = spark.createDataFrame([(text,)], "t string").select(chat.parse(F.col("t")).alias("p")).first()["p"]
        assert got is None or any(t is None for t in got), text


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, None, None, None, 1), (None, 1, "user", "b", 2), (None, 1, "user", "a", 3), (None, 1, "user", "a", 4)]
    r = made(spark, rows, SCHEMA + ", formatted int").first()
    assert [tuple(t) for t in r["recovered"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert made(spark, [], SCHEMA).count() == 0


def test_loss_covers_each_assistant_text_once(spark):
    df = chat.digests(made(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a</s>"), (1, 2, "assistant", "é")]))
    r = df.first()
    assert (r["loss_chars"], r["loss_sha256"]) == (6, hashlib.sha256("a</s>é".encode()).hexdigest())


def test_native_plan(spark, sf_dir):
    plan = chat.op1_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", HARD[:8])
def test_escaping_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(chat.unescape(chat.escape(F.col("t")))).first()[0] == text
