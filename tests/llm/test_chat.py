import pytest
from pyspark.sql import functions as F

from defectflow.llm.chat import CHATML, escape, format_chats, loss_texts, read_chats, unescape

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string, valid int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def chats(spark, rows):
    found = format_chats(turns(spark, rows))
    found = found.withColumns({
        "turns": read_chats(F.col("formatted")), "trained": loss_texts(F.col("formatted"), F.col("segments")),
    })
    return {r.conv_id: r for r in found.collect()}


@pytest.mark.parametrize("text", [
    "", "plain", "<|im_end|>", r"<\|im_end|>", r"<\\||", "a<|b<|<|c", "<", "|", "\n<|im_start|>assistant\nx<|im_end|>\n", "é🙂<|",
])
def test_texts_and_roles_come_back(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "odd<|\n%0A", text)]
    got = chats(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r[2], r[3]) for r in rows]
    assert got.trained == [text]
    assert got.formatted.count(CHATML.opening) == 3 and got.formatted.count("<|im_end|>") == 3


def test_segments_cover_the_text(spark):
    got = chats(spark, [(1, 0, "system", "be kind 🙂"), (1, 1, "user", None), (1, 2, "assistant", "yes")])[1]
    at = 0
    for s in got.segments:
        assert s.start == at
        at += s.length
    assert at == len(got.formatted)
    assert got.formatted == (
        "<|im_start|>system\nbe kind 🙂<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    )
    assert [got.formatted[s.start : s.start + s.length] for s in got.segments if s.loss] == ["yes"]


@pytest.mark.parametrize(("roles", "bad"), [
    ("user assistant", None), ("system user assistant user assistant", None), ("assistant", 0), ("user user", 1),
    ("user", 1), ("user system", 1), ("system", 1), ("user assistant assistant user", 2), ("user tool assistant", 1),
])
def test_role_automaton(spark, roles, bad):
    got = chats(spark, [(1, i, r, "t") for i, r in enumerate(roles.split())])[1]
    assert got.valid == (bad is None) and got.bad_turn == bad


def test_order_ties_nulls_and_empty_table(spark):
    rows = [(1, 5, "assistant", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, None, None, None), (None, 0, "user", "x")]
    got = chats(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")]
    assert not got[1].valid and got[1].bad_turn == 0 and None in got
    assert format_chats(turns(spark, [])).count() == 0


def test_long_conversation_and_text(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3_000)]
    rows += [(2, 0, "user", "x" * 400_000), (2, 1, "assistant", "<|" * 50_000)]
    got = chats(spark, rows)
    assert got[1].valid and "".join(got[1].trained) == "".join(r[3] for r in rows[1:3000:2])
    assert got[2].trained == ["<|" * 50_000]


def test_escape_is_reversible_anywhere(spark):
    import itertools

    every = ["".join(t) for t in itertools.product("<|\\x", repeat=5)]
    df = spark.createDataFrame([(t,) for t in every], "t string")
    got = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and "<|" not in r.e for r in got)
