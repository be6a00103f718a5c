import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stageflow.llm import chat_format as C

EVENTS = "conv_id long, seq long, message_id string, kind string, role string, text string"


def test_fold(spark):
    rows = [
        (1, 0, "a", "message", "user", "hi"), (1, 1, "b", "delta", "assistant", "he"), (1, 2, "b", "delta", "assistant", "llo"), (1, 3, "c", "message", "user", "gone"),
        (1, 4, "b", "regenerate", "assistant", None), (1, 5, "b", "delta", "assistant", "bye"), (1, 6, "a", "edit", "user", "HI"), (1, 7, "d", "message", "user", "later"),
        (2, 0, None, "message", "user", "x"), (2, 0, None, "message", "user", "x"), (None, None, None, None, None, None),
    ]
    out = {r.conv_id: C.parse(r.formatted) for r in C.joined(C.format_conversations(spark.createDataFrame(rows, EVENTS).repartition(3))).collect()}
    assert out == {1: [("user", "HI"), ("assistant", "bye"), ("user", "later")], 2: [("user", "x"), ("user", "x")], None: [("", "")]}


@settings(deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet='\\<>/turn "\nx\u00e9', max_size=20)), max_size=4))
def test_escape_round_trip(turns):
    esc = lambda s: s.replace("\\", "\\\\").replace("<", "\\<")
    text = "".join('<turn role="' + esc(r).replace('"', '\\"') + '">\n' + esc(t) + "</turn>\n" for r, t in turns)
    assert C.parse(text) == turns


def test_regeneration_spares_what_began_at_the_same_place(spark):
    rows = [(1, 0, "a", "message", "assistant", "x"), (1, 2, "a", "regenerate", "assistant", "y"), (1, 0, "b", "message", "user", "same place"), (1, 1, "c", "message", "user", "gone"), (1, 3, "d", "message", "user", "z")]
    out = C.joined(C.format_conversations(spark.createDataFrame(rows, EVENTS))).first().formatted
    assert C.parse(out) == [("assistant", "y"), ("user", "same place"), ("user", "z")]


@pytest.mark.parametrize("log", [C.events_of_turns, C.log_of_turns])
def test_digests(spark, log):
    trap = "\\### Assistant: </turn> ok"
    turns = [(-7, 0, "user", trap), (-7, 1, "assistant", trap), (3, 2, "assistant", None), (3, 1, "system", "s\n<"), (3, 5, "assistant", "b\\"), (4, 0, None, "u"), (3, 7, "user", "q" * 300_000), (5, 1, "user", "b"), (5, 1, "assistant", "aé"), (5, 1, "assistant", "aé"), (None, 1, "user", "n")]
    turns += [(6, k, "assistant" if k % 3 else "user", f"row {k} of a hot one") for k in range(2000)] + [(5, None, "assistant", "without a number")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("body", C.F.lit("extra"))
    pieces = C.format_conversations(log(df.repartition(4))).cache()
    whole = {r.conv_id: r.formatted for r in C.joined(pieces).collect()}
    for r in C.digests(pieces).collect():
        own = [(role or "", text or "") for c, _, role, text in sorted(turns, key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or "")) if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.formatted_chars == len(whole[r.conv_id]) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert C.parse(whole[r.conv_id]) == own


def test_odd_rows(spark, odd_docs):
    turns = odd_docs.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("source").alias("role"), "text", "key", "n", "at")
    whole = {r.conv_id: r for r in C.digests(C.format_conversations(C.log_of_turns(turns))).collect()}
    assert whole[1].n_turns == 2 and whole[None].n_turns == 2 and whole[6].formatted_chars > 1_000_000


def test_empty(spark):
    assert C.digests(C.format_conversations(C.log_of_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    assert C.digests(C.format_conversations(spark.createDataFrame([], EVENTS))).count() == 0


def test_query(spark):
    out = C.op8(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [conv_id" in plan and "min_by" in plan  # the result comes out of the fold
    raw = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    same = C.digests(C.format_conversations(C.events_of_turns(raw.select("conv_id", "turn", "role", "text"))))
    assert sorted(map(tuple, out.where("conv_id <> -7").collect())) == sorted(map(tuple, same.collect()))
    assert out.where("conv_id = -7 AND n_turns = 2 AND loss_chars = 26").count() == 1
