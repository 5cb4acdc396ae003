"""Language-model scores: corpus counts, and a recurrent network over word classes.

Counts cover all training texts. The most frequent words are inner words of
the network, further ones stand in classes of about equal mass, and all others
in a last class; within such a class a word has its share of the class's count.
The network is trained on every token of the training texts. They are dealt
into shards by a hash of the row, in the order of that hash, so that the result
does not depend on the layout of the input; each shard runs truncated
backpropagation from the same weights, and the weights are averaged by the
words seen. The number of shards follows the number of words. Only the table of frequent words, whose size is a
parameter, and the weights go to the tasks; other words meet their counts in a
join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..session import written_table
from . import gru
from . import words as W

END = np.uint64(0x5DEECE66D1234567)


@dataclass(frozen=True)
class LanguageSettings:
    """``head`` words are sent to the tasks. A shard has about ``shard`` words, trained in ``lanes`` side by side; a task holds at most ``hold`` words and a text."""

    head: int = 200_000
    inner: int = 1024
    inner_classes: int = 32
    outer_classes: int = 16
    hidden: int = 12
    window: int = 32
    rounds: int = 1
    rate: float = 0.02
    lanes: int = 192
    shard: int = 4_000_000
    hold: int = 6_000_000


@dataclass
class Table:
    """Frequent words by hash: slot, count, and natural log share of the class (0 for inner words)."""

    hashes: np.ndarray
    slot: np.ndarray
    count: np.ndarray
    share: np.ndarray
    start: np.ndarray
    shape: gru.Shape
    total: int
    types: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        at = self.start[(h >> np.uint64(44)).astype(np.int64)]
        while len(todo):
            at = np.minimum(at, len(self.hashes) - 1)
            have = self.hashes[at]
            hit = have == h[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (have < h[todo]) & (at + 1 < len(self.hashes))
            todo, at = todo[on], at[on] + 1
        return out


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and the starts of the texts."""
    words = W.Words(*W.text_bytes(batch.column("text")))
    n = words.per_text
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(first[-1], np.uint64)
    out[first[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hashes()
    return out, first


def _counted(table: Iterator[pa.RecordBatch], flush: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in W.batches(table):
        h, _ = _tokens(batch)
        held.append(h)
        size += len(h)
        if size >= flush:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): counts of hashed words, and of the end of texts."""
    return docs.select("text").mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, s: LanguageSettings) -> Table:
    """The table of frequent words; ``head`` rows reach the driver."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # few rows of each partition meet in one task: words below the size that ``head`` words reach are left out first
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, words = 0, 0
    for r in sizes:
        least, words = r["step"], words + r["words"]
        if words >= s.head:
            break
    top = counts.filter(step >= least).orderBy(F.col("n").desc(), "word").limit(s.head).toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    inner = min(s.inner, len(n))
    mass = np.cumsum(n[:inner]) / max(n[:inner].sum(), 1)
    cuts = np.minimum(np.searchsorted(mass, np.arange(1, s.inner_classes) / s.inner_classes) + 1, inner)
    bounds = sorted({0, inner, *cuts.tolist()})
    shape = gru.Shape(tuple(bounds), s.outer_classes + 1, s.hidden)
    rest = n[inner:]
    group = np.minimum((np.cumsum(rest) - rest) * s.outer_classes // max(rest.sum(), 1), s.outer_classes - 1).astype(np.int64)
    slot = np.concatenate([np.arange(inner), inner + group]).astype(np.int16)
    share = np.zeros(len(n))
    share[inner:] = np.log(rest / np.maximum(np.bincount(group, rest, s.outer_classes), 1)[group])
    if not len(n):  # one word that no text has
        word, n, slot, share = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int16), np.zeros(1)
    order = np.argsort(word)
    word = word[order]
    start = np.searchsorted(word, np.arange((1 << 20) + 1, dtype=np.uint64)[:-1] << np.uint64(44)).astype(np.int32)
    return Table(word, slot[order], n[order], share[order], start, shape, int(sums["n"]), int(sums["v"]))


def _slots(table: Table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = table.find(h)
    last = table.shape.slots - 1
    return np.where(at >= 0, table.slot[at], last).astype(np.int16), at


def _coded(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
    """The slots of each text as 16-bit numbers in a binary value."""
    for batch in W.batches(batches):
        h, first = _tokens(batch)
        ids, _ = _slots(table, h)
        where = pa.py_buffer((first * ids.itemsize).astype(np.int64))
        slots = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, where, pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), slots.cast(pa.binary())], ["key", "slots"])


def _trained(batches: Iterator[pa.RecordBatch], shape: gru.Shape, weights: np.ndarray, s: LanguageSettings) -> Iterator[pa.RecordBatch]:
    """Weights of each shard; the rows of a shard follow each other."""
    trainer, now, seen, held, size = None, None, 0, [], 0

    def learn() -> int:
        count = np.array([len(x) for x in held])
        return trainer.learn(np.concatenate(held), np.cumsum(count) - count, count, s.window) if held else 0

    def out() -> pa.RecordBatch:
        v = gru.flat(trainer.w)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(np.float64)), pa.array(np.full(len(v), seen, np.int64))], ["place", "value", "seen"])

    for batch in batches:
        for shard, slots in zip(batch.column("shard").to_pylist(), batch.column("slots")):
            if shard != now:
                if trainer:
                    seen += learn()
                    yield out()
                trainer, now, seen, held, size = gru.Trainer(gru.unflat(weights, shape), shape, s.rate, s.lanes), shard, 0, [], 0
            held.append(np.frombuffer(slots.as_buffer(), np.int16).copy())
            size += len(held[-1])
            if size >= s.hold:
                seen += learn()
                held, size = [], 0
    if trainer:
        seen += learn()
        yield out()


def train(docs: DataFrame, table: Table, settings: LanguageSettings = LanguageSettings()) -> np.ndarray:
    """Weights after ``rounds`` of training in all shards and averaging. ``docs`` has a ``key`` by which texts are dealt and ordered."""
    s = settings
    last = table.shape.slots - 1
    slot_counts = np.bincount(table.slot, table.count, table.shape.slots).astype(float)
    slot_counts[last] = max(table.total - slot_counts.sum(), 1)
    weights = gru.flat(gru.initial(table.shape, slot_counts))
    shards = -(-max(table.total, 1) // s.shard)
    coded = docs.select("key", "text").mapInArrow(partial(_coded, table=table), "key bigint, slots binary")
    coded = coded.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "key")
    for _ in range(s.rounds):
        parts = dealt.mapInArrow(partial(_trained, shape=table.shape, weights=weights, s=s), "place int, value double, seen bigint")
        mean = parts.groupBy("place").agg((F.sum(F.col("value") * F.col("seen")) / F.sum("seen")).alias("value")).toArrow()
        if mean.num_rows:
            weights = mean.sort_by("place").column("value").to_numpy()
    return weights


def _scored(batches: Iterator[pa.RecordBatch], table: Table, weights: np.ndarray, s: LanguageSettings, columns: list[str]) -> Iterator[pa.RecordBatch]:
    w = gru.unflat(weights, table.shape)
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x[1] for x in held])
        counts = np.concatenate([x[2] for x in held])
        first = np.concatenate([[0], np.cumsum(counts)])
        logs = gru.score(w, table.shape, ids, first, s.window)
        at = 0
        for rows, _, n, share, base, known, rare, rare_first in held:
            yield pa.RecordBatch.from_arrays([
                *rows, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array((logs[at : at + len(n)] + share) / np.log(10)),
                W.list_column(rare.view(np.int64), rare_first, pa.int64()),
            ], [*columns, "n_tokens", "n_known", "base_score", "score", "_rare"])
            at += len(n)

    for batch in W.batches(batches):
        h, first = _tokens(batch)
        ids, at = _slots(table, h)
        n = np.diff(first)
        found = at >= 0
        base = np.where(found, np.log10(table.count[at] + 1.0) - np.log10(table.total + table.types + 1.0), 0.0)
        share = np.where(found, table.share[at], 0.0)
        before = np.concatenate([[0], np.cumsum(~found)])
        held.append((
            [batch.column(c) for c in columns], ids, n, np.add.reduceat(share, first[:-1]), np.add.reduceat(base, first[:-1]),
            np.add.reduceat(found.astype(np.int64), first[:-1]), h[~found], before[first],
        ))
        size += len(h)
        if size >= s.hold:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def score(docs: DataFrame, train_row: Column, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """Columns of ``docs`` but text, with n_tokens, n_known, train_tokens, base_score and score (both log10).

    Rows where ``train_row`` holds are learned from; null counts as not. A null
    or empty text is its end alone. Repeated rows are scored one by one, and
    learned from as often. Without training rows every word is unknown. Words
    outside the training texts share one type. The same rows get the same
    scores in whatever order and partitions they come, up to the rounding of
    the averages.
    """
    s = settings
    columns = [c for c in docs.columns if c not in ("text", "n_tokens", "n_known", "train_tokens", "base_score", "score", "_row", "_rare")]
    known = docs.select(*columns, "text")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    learned = docs.filter(train_row).select(F.xxhash64(*plain).alias("key"), "text")
    counts = written_table(count_words(learned))
    table = frequent(counts, s)
    weights = train(learned, table, s)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*columns).schema)
    scored = known.mapInArrow(
        partial(_scored, table=table, weights=weights, s=s, columns=columns),
        f"{kinds}, n_tokens bigint, n_known bigint, base_score double, score double, _rare array<bigint>",
    )
    scored = written_table(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare_total = table.total - int(table.count.sum())
    rare_types = table.types - int(np.count_nonzero(table.count))
    words = scored.select("_row", F.explode("_rare").alias("word")).join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    each = words.groupBy("_row").agg(
        F.sum(F.log10(c + 1.0) - F.lit(float(np.log10(table.total + table.types + 1.0)))).alias("_base_more"),
        F.sum(F.log10(c + 1.0) - F.lit(float(np.log10(rare_total + rare_types + 1.0)))).alias("_more"),
        F.sum((c > 0).cast("bigint")).alias("_known_more"),
    )
    both = scored.join(each, "_row", "left")
    return both.select(
        *columns, "n_tokens", (F.col("n_known") + F.coalesce("_known_more", F.lit(0))).alias("n_known"), F.lit(table.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base_more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("_more", F.lit(0.0))).alias("score"),
    )
