"""Conversations from reply trees, with DataFrame operations only.

Messages point to the message they answer. Doubling self-joins give each
message its depth and the score of its path in a logarithmic number of rounds;
branches are ranked by score, and the messages of the chosen ones are
enumerated by the same jumps in reverse. Each path becomes one string:

    <|turn|>role<|text|>text<|end|>...

Control strings inside a role or text are broken by a backslash, and
backslashes are doubled, which a single replacement undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that the template or common chat templates use as control marks.
CONTROL = r"([<\[])(?=\|(?:turn|text|end|im_start|im_end|startoftext|endoftext)\||/?s>|/?INST\]|</?SYS>>)"
MAX_ROUNDS = 48


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it by turn.

    Rows with the same turn follow in the order of role and text, nulls first.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    rows = conversations.select("conv_id", "role", "text", place.alias("node"))
    return rows.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(1.0).alias("score"), "role", "text",
    )


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, place, node): the messages of the ``branches`` best paths of each tree.

    ``messages`` has tree, node (unique in its tree), parent and score. The
    score of a branch is the mean over its messages; null counts as 0, ties go
    to the smaller leaf. A parent that is not in the tree, or null, makes a
    root. Raises on a cycle of replies.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    linked = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("up")), "left")
    state = cut_lineage(linked.select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth")))
    jumps = [state.filter("up IS NOT NULL")]
    while not jumps[-1].isEmpty():
        if len(jumps) > MAX_ROUNDS:
            raise ValueError("the replies form a cycle")
        over = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        # messages that have reached their root are done; the others jump on
        both = jumps[-1].join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        further = both.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        state = cut_lineage(state.filter("up IS NULL").unionByName(further))
        jumps.append(state.filter("up IS NOT NULL"))
    answered = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = state.join(answered, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "leftanti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), "node"))
    path = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches).select(
        "tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("place")
    )
    for k in range(len(jumps) - 2, -1, -1):  # every distance is a sum of powers of two
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        step = path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left")
        here = F.struct(F.col("node").alias("node"), F.col("place").alias("place"))
        there = F.struct(F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"))
        path = step.select("tree", "leaf", "rank", F.explode(F.array(here, there)).alias("x")).filter("x.node IS NOT NULL")
        path = path.select("tree", "leaf", "rank", "x.node", "x.place")
    return path


def formatted(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, text, loss): one string for each chosen path.

    ``loss`` lists start and length, in code points of the string, of the
    texts of ``loss_role``. Null roles and texts count as empty. A path is one
    row, so its string is as long as the conversation.
    """
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("learn"))
    rows = best_paths(messages, branches).join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(TURN), "role", F.lit(TEXT))
    rows = rows.withColumn("piece", F.concat(head, "text", F.lit(END))).withColumn("head", F.length(head))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head")
    rows = rows.withColumn("start", start).withColumn("size", F.length("text").cast("bigint"))
    turns = F.sort_array(F.collect_list(F.struct("place", "piece", "start", "size", "learn")))
    whole = rows.groupBy("tree", "leaf", "rank").agg(turns.alias("turns"))
    learn = F.filter("turns", lambda x: F.coalesce(x["learn"], F.lit(False)))
    return whole.select(
        "tree", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("text"),
        F.transform(learn, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("length"))).alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.split(text, r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, len(TURN) + 1, 1 << 30), r"<\|text\|>"))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(loss, lambda x: unescaped(text.substr((x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
