"""Exact removal of repeated word sequences.

A word goes if a window of ``width`` consecutive words that also starts earlier
covers it. Windows meet by super-k-mer partitioning:

* The minimiser of a window is the leftmost least hash of ``seed`` consecutive
  words in it, so equal windows have the same minimiser at the same place.
* Consecutive windows that share a minimiser travel as one packed string, their
  words joined by one space, to the bucket of that minimiser. Minimisers that
  occur in one place only cannot have a repeated window; they are dropped
  before a word is moved.
* In a bucket the words are numbered, windows are sorted by doubling the length
  that the numbers stand for, and equal neighbours are counted. The numbers come
  from whole words, so windows are compared exactly.
* The windows of a minimiser in more than ``crowd`` places, such as a common
  line among ever other neighbours, travel one by one to the bucket of their
  own hash, so that only equal windows meet.

Strings seen earlier in the same batch of texts are settled there: a passage in
a third of all documents sends one row for each batch. Equal texts are cut once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from . import words as W

SEGMENT = W.BLOCK - 1024
_PLACE = np.uint64(W.BLOCK - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
NO_DOC = (1 << 63) - 1
LENGTH_BITS = 24


@dataclass(frozen=True)
class PassageSettings:
    """``width`` words of a window, ``seed`` words of a minimiser, ``block`` strings sorted at once, ``crowd`` places above which windows travel one by one."""

    width: int = 20
    seed: int = 8
    block: int = 10_000
    crowd: int = 4096


def super_kmers(words: W.Words, s: PassageSettings) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, hash): the windows that start at words ``lo`` to ``hi`` of the batch share a minimiser of that hash."""
    left = np.repeat(words.first[1:], words.per_text) - np.arange(len(words))  # words to the end of the text
    hashes, seeds = words.hashes(fold=False), s.width - s.seed + 1
    parts = []
    for at in range(0, len(words) - s.width + 1, SEGMENT):
        stop = min(len(words), at + SEGMENT + s.width - 1)
        h = np.zeros(stop - at - s.seed + 1, np.uint64)
        for j in range(s.seed):
            h = W.mix(h * _STEP + hashes[at + j : at + j + len(h)] + np.uint64(1))
        keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        best = np.lib.stride_tricks.sliding_window_view(keyed, seeds).min(axis=1) & _PLACE
        valid = left[at : at + len(best)] >= s.width
        turn = np.ones(len(best) + 1, bool)
        turn[1:-1] = (best[1:] != best[:-1]) | (valid[1:] != valid[:-1])
        lo = np.flatnonzero(turn[:-1] & valid)
        hi = np.flatnonzero(turn[1:] & valid)
        parts.append((lo + at, hi + at, h[best[lo].astype(np.int64)]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    lo, hi, h = (np.concatenate(x) for x in zip(*parts))
    return np.searchsorted(words.first, lo, "right") - 1, lo, hi, h.view(np.int64)


def packed_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): every word followed by one space, and where each begins; the last entry is the end."""
    size = end - begin
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(starts[-1], 0x20, np.uint8)
    for i in range(0, len(size), rows):
        n = size[i : i + rows]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(starts[i : i + len(n)], n) + inside] = data[np.repeat(begin[i : i + rows], n) + inside]
    return out, starts


def _strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray, rows: int = 8192) -> pa.Array:
    """String column of byte spans, which may overlap."""
    size = stop - start
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for i in range(0, len(start), rows):
        j = min(i + rows, len(start))
        out[ends[i] : ends[j]] = data[np.repeat(start[i:j] - ends[i:j], size[i:j]) + np.arange(ends[i], ends[j])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def _minimisers(table: Iterator[pa.RecordBatch], s: PassageSettings) -> Iterator[pa.RecordBatch]:
    """(hash, mark, times): each minimiser of each text, and its places in it."""
    for batch in W.batches(table):
        text, _, _, h = super_kmers(W.Words(*W.text_bytes(batch.column("text"))), s)
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(fresh)
        marks = batch.column("mark").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[at]), pa.array(marks[text[at]]), pa.array(np.diff(np.append(at, len(h))), pa.int64())], ["hash", "mark", "times"]
        )


def _listed(lists: pa.Array, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in the list of its text."""
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pair = np.concatenate([h, lists.flatten().to_numpy()]).view(np.uint64)
    pair = W.mix(pair + W.mix(np.concatenate([text, owner]).astype(np.uint64)))
    return np.isin(pair[: len(h)], pair[len(h) :])


def _settle(key: np.ndarray, order: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): rows that are the earliest of their key, and rows of a later place.

    A row that repeats the place of the earliest one, because a document is
    listed twice, is neither.
    """
    rank = np.lexsort((at, mark, order))
    _, index, back = np.unique(key[rank], return_index=True, return_inverse=True)
    lead = np.empty(len(key), np.int64)
    lead[rank] = rank[index][back]
    first = lead == np.arange(len(key))
    return first, (order != order[lead]) | (mark != mark[lead]) | (at != at[lead])


BUCKETED = ["hash", "order", "mark", "lo", "hi", "packed"]
BUCKET_TYPES = "hash bigint, order bigint, mark bigint, lo bigint, hi bigint, packed string"


def _travellers(table: Iterator[pa.RecordBatch], s: PassageSettings) -> Iterator[pa.RecordBatch]:
    """Packed strings of the windows with a repeated minimiser; a row without a string is settled: its windows go."""
    for batch in W.batches(table):
        words = W.Words(*W.text_bytes(batch.column("text")))
        text, lo, hi, h = super_kmers(words, s)
        keep = _listed(batch.column("seeds"), text, h)
        text, lo, hi, h = (x[keep] for x in (text, lo, hi, h))
        crowded = _listed(batch.column("crowded"), text, h)
        data, starts = packed_words(words.data, words.starts, words.ends)
        whole = (x[~crowded] for x in (text, lo, hi, h))
        yield from _sent(batch, words, data, starts, *whole, s)
        for i in range(0, np.count_nonzero(crowded), 4096):
            t, a, b = (x[crowded][i : i + 4096] for x in (text, lo, hi))
            count = b - a + 1
            t, a = np.repeat(t, count), np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield from _sent(batch, words, data, starts, t, a, a, None, s)


def _sent(batch, words: W.Words, data, starts, text, lo, hi, h, s: PassageSettings, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows of the given windows, some at a time; without ``h`` the bucket is a hash of the string."""
    orders, marks = batch.column("_order").to_numpy(), batch.column("mark").to_numpy()
    for i in range(0, len(text), rows):
        t, a, b = (x[i : i + rows] for x in (text, lo, hi))
        packed = _strings(data, starts[a], starts[b + s.width] - 1)
        code = packed.dictionary_encode()
        order, mark, at = orders[t], marks[t], a - words.first[t]
        first, later = _settle(code.indices.to_numpy(), order, mark, at)
        if h is None:
            raw, ends = W.text_bytes(code.dictionary)
            bucket = W.span_hashes(raw, ends[:-1], ends[1:]).view(np.int64)[code.indices.to_numpy()]
        else:
            bucket = h[i : i + rows]
        bucket = np.where(first, bucket, mark ^ at)
        made = [pa.array(x) for x in (bucket, order, mark, at, b - words.first[t])]
        made.append(pc.if_else(pa.array(first), packed, pa.scalar(None, pa.string())))
        yield pa.RecordBatch.from_arrays(made, BUCKETED).filter(pa.array(first | later))


def window_numbers(words: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the windows of ``width`` that start at each place: equal exactly when the windows are. Windows over the end are of no meaning."""

    def joined(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        beside = np.append(b[step:], np.zeros(min(step, len(b)), b.dtype))
        return np.unique(a * (b.max() + 1) + beside, return_inverse=True)[1]

    power, size, out, done = words.astype(np.int64), 1, None, 0
    while len(words):
        if width & size:
            out, done = (power, size) if out is None else (joined(out, power, done), done + size)
        if done == width:
            return out
        power, size = joined(power, power, size), 2 * size
    return words


def _counted(batch: pa.RecordBatch, s: PassageSettings) -> pa.RecordBatch:
    """Spans (mark, span) that go, of whole buckets; span packs the first word and the number of words."""
    settled = pc.is_null(batch.column("packed")).to_numpy(zero_copy_only=False)
    mark, lo, hi = (batch.column(c).to_numpy() for c in ("mark", "lo", "hi"))
    out = [[mark[settled], lo[settled], hi[settled]]]
    rest = batch.filter(pa.array(~settled))
    if rest.num_rows > 1:
        order, mark, lo, hi = (rest.column(c).to_numpy() for c in ("order", "mark", "lo", "hi"))
        word = pc.split_pattern(rest.column("packed"), " ").flatten().dictionary_encode().indices.to_numpy()
        count = hi - lo + 1
        row = np.repeat(np.arange(len(lo)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        size = count + s.width - 1
        place = np.repeat(np.cumsum(size) - size, count) + inside
        _, gone = _settle(window_numbers(word, s.width)[place], order[row], mark[row], lo[row] + inside)
        at = np.flatnonzero(gone)
        turn = np.ones(len(at) + 1, bool)
        turn[1:-1] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        a, b = at[turn[:-1]], at[turn[1:]]
        out.append([mark[row[a]], (lo[row] + inside)[a], (lo[row] + inside)[b]])
    mark, lo, hi = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(mark), pa.array(lo << LENGTH_BITS | (hi - lo + s.width))], ["mark", "span"])


def _sorted_buckets(table: Iterator[pa.RecordBatch], s: PassageSettings) -> Iterator[pa.RecordBatch]:
    """Whole buckets, about ``block`` strings at a time, from rows ordered by hash, string and place.

    Of equal strings the first one stays in the bucket and the others are
    settled as they come, so that a bucket of equal windows takes no memory.
    """
    held: list[pa.RecordBatch] = []
    lead = None  # the last row that stayed
    for batch in table:
        if lead is not None:
            batch = _joined([lead, batch])
        h, packed = batch.column("hash").to_numpy(), batch.column("packed")
        equal = np.zeros(len(h), bool)
        equal[1:] = (h[1:] == h[:-1]) & pc.equal(packed[1:], packed[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        leads = np.maximum.accumulate(np.where(equal, 0, np.arange(len(h))))
        later = np.zeros(len(h), bool)
        for c in ("order", "mark", "lo"):
            v = batch.column(c).to_numpy()
            later |= v != v[leads]
        if later.any():
            gone = batch.filter(pa.array(later))
            yield _counted(gone.set_column(5, "packed", pa.nulls(gone.num_rows, pa.string())), s)
        seen, lead = lead is not None, batch.slice(leads[-1], 1)
        fresh = ~equal
        fresh[0] = not seen
        batch = batch.filter(pa.array(fresh))
        while batch.num_rows:
            h = batch.column("hash").to_numpy()
            if sum(b.num_rows for b in held) >= s.block:
                cut = int(np.searchsorted(h, held[-1].column("hash")[-1].as_py(), "right"))
                if cut < batch.num_rows:
                    yield _counted(_joined([*held, batch.slice(0, cut)]), s)
                    held, batch = [], batch.slice(cut)
                    continue
            held.append(batch)
            break
    if held:
        yield _counted(_joined(held), s)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def _results(table: Iterator[pa.RecordBatch], s: PassageSettings) -> Iterator[pa.RecordBatch]:
    for batch in W.batches(table):
        words = W.Words(*W.text_bytes(batch.column("text")))
        n, first = words.per_text, words.first
        spans = batch.column("spans").fill_null([])
        edge = np.zeros(len(words) + 1, np.int64)
        packed = spans.flatten().to_numpy()
        begin = first[np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy())] + (packed >> LENGTH_BITS)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + (packed & ((1 << LENGTH_BITS) - 1)), -1)
        whole = batch.column("copy").to_numpy(zero_copy_only=False) & (n >= s.width)
        gone = (np.cumsum(edge[:-1]) > 0) | np.repeat(whole, n)
        removed = np.concatenate([[0], np.cumsum(gone)])
        # maximal removed runs, which end with their text
        turn = np.zeros(len(words) + 1, bool)
        turn[1:-1] = gone[1:] != gone[:-1]
        turn[first] = True
        owner = words.owner()
        a, b = np.flatnonzero(turn[:-1] & gone), np.flatnonzero(turn[1:] & gone) + 1
        runs = np.concatenate([[0], np.cumsum(np.bincount(owner[a], minlength=batch.num_rows))])
        base = first[owner[a]]

        data, place = packed_words(words.data, words.starts[~gone], words.ends[~gone])
        place = place[first - removed[first]].tolist()
        kept = pa.array([data[i : max(i, j - 1)].tobytes() for i, j in zip(place[:-1], place[1:])], pa.binary()).cast(pa.string())
        others = [c for c in batch.schema.names if c in ("doc_id", "_extra")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in others]
            + [pa.array(n, pa.int64()), pa.array(removed[first[1:]] - removed[first[:-1]], pa.int64()), kept]
            + [W.list_column(x, runs, pa.int64()) for x in (a - base, b - base)],
            [*others, "n_words", "n_removed", "kept", "starts", "ends"],
        )


def remove_passages(docs: DataFrame, settings: PassageSettings = PassageSettings()) -> DataFrame:
    """Columns of ``docs`` but text, with n_words, n_removed, kept (the words left, joined by one space), and starts, ends of the removed word spans.

    ``docs`` has doc_id bigint and text; further columns pass through, but for
    those named like a result. Earlier means a smaller doc_id, or an earlier
    start in the same text. A null text counts as empty. A null doc_id comes
    after all others. Rows with the same doc_id and text are one document, and
    each gets its result; different texts with the same doc_id are ordered by a
    hash of the text. Texts under ``width`` words stay. An empty table gives no rows.
    """
    s = settings
    made = {"n_words", "n_removed", "kept", "starts", "ends"}
    extra = [c for c in docs.columns if c not in ("doc_id", "text") and c not in made]
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(
        "doc_id", text.alias("text"), F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra))).alias("_extra"), F.coalesce("doc_id", F.lit(NO_DOC)).alias("_order"), F.xxhash64(text).alias("mark")
    )
    long = texts.filter(F.octet_length("text") >= 2 * s.width - 1)
    firsts = long.groupBy("mark").agg(F.min("_order").alias("first_doc"))
    found = written_table(long.select("text", "mark").mapInArrow(partial(_minimisers, s=s), "hash bigint, mark bigint, times bigint"))
    places = found.groupBy("hash").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.max("times").alias("most"), F.sum("times").alias("places"))
    again = places.filter("a <> b OR most > 1").select("hash", (F.col("places") > s.crowd).alias("many"))
    wanted = found.join(again, "hash").groupBy("mark").agg(F.collect_set("hash").alias("seeds"), F.collect_set(F.when(F.col("many"), F.col("hash"))).alias("crowded"))
    # not "=": as a join key it would shuffle the texts once more
    sources = texts.join(wanted.join(firsts, "mark"), "mark").filter("_order <= first_doc")
    # all columns, as in the join below: Spark then shuffles the texts once for both
    strings = sources.select(*texts.columns, "seeds", "crowded").mapInArrow(partial(_travellers, s=s), BUCKET_TYPES)
    in_order = strings.repartition("hash").sortWithinPartitions("hash", "packed", "order", "mark", "lo")
    spans = in_order.mapInArrow(partial(_sorted_buckets, s=s), "mark bigint, span bigint")
    per_text = spans.groupBy("mark").agg(F.collect_set("span").alias("spans"))
    joined = texts.join(per_text, "mark", "left").join(firsts, "mark", "left")
    joined = joined.withColumn("copy", F.coalesce(F.col("_order") > F.col("first_doc"), F.lit(False)))
    kinds = texts.select("_extra").schema[0].dataType.simpleString()
    out = joined.select(*texts.columns, "copy", "spans").mapInArrow(
        partial(_results, s=s), f"doc_id bigint, _extra {kinds}, n_words bigint, n_removed bigint, kept string, starts array<bigint>, ends array<bigint>"
    )
    return out.select("doc_id", *(F.col("_extra")[f"c{i}"].alias(c) for i, c in enumerate(extra)), *out.columns[2:])
