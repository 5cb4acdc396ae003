import hashlib

import pytest
from pyspark.sql import functions as F

from casebook.llm import chat

TEXTS = ["", None, "<|end|>", "a<|text|>b\\", "\\<s>", "[INST] x [/INST]</s>", "<<SYS>>\n<</SYS>>", "\\\\<|turn|>\\", "é<", "<|en", "d|>"]


def test_round_trip(llm):
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", None, "tool<|end|>"] * 3, TEXTS[i:] + TEXTS[:i]))]
    rows += [(9, 0, "user", "alone"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    df = llm.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("leaf", F.lit("clash"))
    out = chat.formatted(chat.conversation_messages(df))
    out = out.select("tree", "n_turns", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss")).alias("learned"), "text").collect()
    assert len(out) == 6
    for r in out:
        want = [(a or "", b or "") for i, t, a, b in sorted((x for x in rows if x[0] == r.tree), key=lambda x: x[1])]
        assert [tuple(x) for x in r.turns] == want and r.n_turns == len(want)
        assert r.learned == "".join(b for a, b in want if a == "assistant")
        assert r.text.count("<|end|>") == len(want)
    assert chat.formatted(chat.conversation_messages(df.limit(0))).count() == 0


def test_branches_by_score(llm):
    #        1(.5) -> 2(.1) -> 4(.9)      1 -> 3(.8)      6: orphan of a lost parent
    rows = [("t", 1, None, 0.5, "user", "q"), ("t", 2, 1, 0.1, "assistant", "a"), ("t", 4, 2, 0.9, "user", "b"), ("t", 3, 1, 0.8, "assistant", "c"), ("t", 6, 77, None, "user", "d"), ("u", 1, None, None, "user", "x")]
    df = llm.createDataFrame(rows, "tree string, node bigint, parent bigint, score double, role string, text string")
    got = {(r.tree, r["rank"]): (r.leaf, [t.text for t in r.turns]) for r in chat.formatted(df, branches=9).withColumn("turns", chat.read_turns(F.col("text"))).collect()}
    assert got == {("t", 1): (3, ["q", "c"]), ("t", 2): (4, ["q", "a", "b"]), ("t", 3): (6, ["d"]), ("u", 1): (1, ["x"])}
    assert chat.best_paths(df).select("tree", "leaf").distinct().count() == 2


def test_deep_chain_and_cycle(llm):
    df = llm.range(0, 70).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    path = chat.best_paths(df).orderBy("place").collect()
    assert [r.node for r in path] == list(range(70)) and [r.place for r in path] == list(range(1, 71))
