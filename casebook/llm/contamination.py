"""Benchmark decontamination: rare seeds, then local alignment.

Seeds are word n-grams of the items that are unlikely by chance: the product of
the corpus frequencies of their words, times the corpus, is small. This keeps a
seed rare although a copied passage may stand in a third of all documents.
Words are lower-cased and freed of punctuation. The scan of the documents tests
each n-gram against a bit table of fixed size and keeps the words around hits;
candidates meet their items by a join on the seed, and Smith-Waterman alignment
of the words scores them, so that edited copies are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from . import words as W
from .bits import BITS, inside, table_of


@dataclass(frozen=True)
class MatchSettings:
    """``seed`` words; seeds expected more than ``chance`` times are dropped, but for the ``least`` rarest of an item.

    ``bits`` is the log2 of the size of the bit tables that are sent to the
    tasks (2 MB each). A pair counts from ``score``, which is the alignment
    score over that of the item with itself.
    """

    seed: int = 3
    chance: float = 1.0
    least: int = 5
    bits: int = BITS
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    score: float = 0.4


def _hashes(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray]:
    words = W.Words(*W.text_bytes(batch.column("text")), W.PUNCTUATION)
    return words, words.hashes()


def _item_rows(table: Iterator[pa.RecordBatch], s: MatchSettings) -> Iterator[pa.RecordBatch]:
    for batch in W.batches(table):
        words, h = _hashes(batch)
        grams, first = W.shingles(words, h, s.seed)
        yield pa.RecordBatch.from_arrays([
            batch.column("item_id"), W.list_column(h.view(np.int64), words.first, pa.int64()), W.list_column(grams.view(np.int64), first, pa.int64()),
        ], ["item_id", "words", "grams"])


def _word_counts(table: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words in the bit table, and (null, n) for all words."""
    total = 0
    for batch in W.batches(table):
        _, h = _hashes(batch)
        total += len(h)
        found, n = np.unique(h[inside(h, bits)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])


def _stretches(table: Iterator[pa.RecordBatch], bits: np.ndarray, reach: int, s: MatchSettings) -> Iterator[pa.RecordBatch]:
    """Stretches of words around seeds: (doc_id, at, words, grams); ``at`` is the place of the first word."""
    for batch in W.batches(table):
        words, h = _hashes(batch)
        grams, first = W.shingles(words, h, s.seed)
        hit = np.flatnonzero(inside(grams, bits))
        text = np.searchsorted(first, hit, "right") - 1
        place = words.first[text] + hit - first[text]
        lo = np.maximum(place - reach, words.first[text])
        hi = np.minimum(place + s.seed + reach, words.first[text + 1])
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])
        at = np.flatnonzero(fresh)
        start, stop = lo[at], hi[np.append(at[1:], len(hit)) - 1] if len(hit) else lo[at]
        size = stop - start
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(text[at])), pa.array(start - words.first[text[at]]),
            W.list_column(h[take].view(np.int64), ends, pa.int64()),
            W.list_column(grams[hit].view(np.int64), np.append(at, len(hit)), pa.int64()),
        ], ["doc_id", "at", "words", "grams"])


def align(item: np.ndarray, words: np.ndarray, s: MatchSettings) -> tuple[int, int]:
    """Best local alignment score of two word sequences (linear gaps), and where it ends in ``words``."""
    slope = -s.gap * np.arange(len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above + s.gap, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == w, s.match, s.mismatch))
        above = np.maximum.accumulate(row + slope) - slope
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def _scored(table: Iterator[pa.RecordBatch], s: MatchSettings) -> Iterator[pa.RecordBatch]:
    for batch in table:
        out = []
        for item, words, at in zip(batch.column("item"), batch.column("words"), batch.column("at").to_pylist()):
            item, words = item.values.to_numpy(), words.values.to_numpy()
            best, end = align(item, words, s)
            _, size = align(item[::-1], words[:end][::-1], s)
            out.append((best / (s.match * len(item)), at + end - size, at + end))
        score, lo, hi = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("item_id"), pa.array(score, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
            ["doc_id", "item_id", "score", "first_word", "end_word"],
        )


def matches(docs: DataFrame, items: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every pair from the least score, with its best place.

    Words are counted without punctuation. Null and empty texts match nothing,
    and neither do items with fewer words than a seed. Repeated rows of one
    doc_id or item_id give one row; ties go to the first place. Rows without a
    doc_id or item_id are left out.
    """
    s = settings
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    known = items.select("item_id", "text").filter("item_id IS NOT NULL").dropDuplicates()
    known = written_table(known.mapInArrow(partial(_item_rows, s=s), "item_id bigint, words array<bigint>, grams array<bigint>").filter(F.size("words") >= s.seed))
    item_words = table_of(known.select(F.explode("words").alias("word")), s.bits)
    counts = docs.mapInArrow(partial(_word_counts, bits=item_words), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written_table(counts)
    total = counts.filter("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # expected count of a seed: corpus size times the product of the frequencies of its words
    places = known.select("item_id", "words", F.posexplode("grams").alias("place", "gram"))
    each = places.select("item_id", "gram", F.explode(F.slice("words", F.col("place") + 1, s.seed)).alias("word"))
    share = F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(total + 1.0))
    rare = each.join(counts.filter("word IS NOT NULL"), "word", "left").groupBy("item_id", "gram").agg(F.sum(share).alias("chance"))
    rank = F.expr("row_number() OVER (PARTITION BY item_id ORDER BY chance, gram)")
    rare = rare.withColumn("rank", rank).filter((F.col("chance") + F.log(F.lit(total + 1.0)) <= float(np.log(s.chance))) | (F.col("rank") <= s.least))
    seeds = written_table(rare.select("gram", "item_id").distinct())
    reach = known.agg(F.max(F.size("words")).alias("n")).first()["n"] or 0
    seed_bits = table_of(seeds.select("gram"), s.bits)
    found = written_table(docs.mapInArrow(partial(_stretches, bits=seed_bits, reach=reach, s=s), "doc_id bigint, at bigint, words array<bigint>, grams array<bigint>"))
    pairs = found.select("doc_id", "at", F.explode(F.array_distinct("grams")).alias("gram")).join(seeds, "gram").select("doc_id", "at", "item_id").distinct()
    both = pairs.join(found.select("doc_id", "at", "words"), ["doc_id", "at"]).join(known.select("item_id", F.col("words").alias("item")), "item_id")
    scored = both.mapInArrow(partial(_scored, s=s), "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint")
    best = F.min(F.struct((-F.col("score")).alias("s"), "first_word", "end_word")).alias("best")
    return scored.filter(F.col("score") >= s.score).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.s")).alias("score"), "best.first_word", "best.end_word"
    )


def decontaminate(docs: DataFrame, items: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """Rows of ``docs`` without a match."""
    hit = matches(docs, items, settings).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "leftanti").select(*docs.columns)
