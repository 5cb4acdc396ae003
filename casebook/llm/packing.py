"""Token sequences of a fixed size with few gaps.

Texts are tokenised word by word: the tokenizer never joins characters across
white space, so each distinct word is encoded once in a worker and the ids of a
text are gathered from that table. Pieces are dealt at random into groups of a
bounded size. A group starts from best fit in decreasing order; a local search
then takes the emptiest sequence and moves, exchanges one for one, or
exchanges two for one with fuller ones as long as the sum of squared fills
grows, until that sequence is empty or nothing helps.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from . import words as W


@dataclass(frozen=True)
class PackSettings:
    """``group`` pieces are packed together; ``known`` bounds the words a worker remembers."""

    vocabulary: str = "word_bpe_49k.json"
    capacity: int = 4096
    end_id: int = 1
    group: int = 16_384
    known: int = 600_000
    tries: int = 4000


class Encoder:
    """Ids of words, remembered by hash."""

    def __init__(self, s: PackSettings):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.limit, self.at_once = s.known, 2000
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(s.vocabulary))
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        each, where, back = np.unique(words.hashes(fold=False), return_index=True, return_inverse=True)
        if len(self.hashes) > self.limit:
            self._forget()
        at = np.searchsorted(self.hashes, each)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != each) if len(self.hashes) else np.arange(len(each))
        if len(new):
            raw, starts, ends = words.data, words.starts[where[new]], words.ends[where[new]]
            texts = [raw[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
            sizes, ids = [np.diff(self.first)], [self.ids]
            for i in range(0, len(texts), self.at_once):  # encodings are large objects
                found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + self.at_once], add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in found], np.int64))
                ids.append(np.array([i for x in found for i in x], np.uint32))
            sizes, ids = np.concatenate(sizes), np.concatenate(ids)
            hashes = np.concatenate([self.hashes, each[new]])
            order = np.argsort(hashes)
            self.ids = ids[_ragged((np.cumsum(sizes) - sizes)[order], sizes[order])]
            self.hashes, self.first = hashes[order], np.concatenate([[0], np.cumsum(sizes[order])])
            at = np.searchsorted(self.hashes, each)
        start, size = self.first[at][back], np.diff(self.first)[at][back]
        return self.ids[_ragged(start, size)], size


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_ENCODERS: dict[str, Encoder] = {}


def _pieces(table: Iterator[pa.RecordBatch], s: PackSettings, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _ENCODERS.setdefault(s.vocabulary, None) or Encoder(s)
    _ENCODERS[s.vocabulary] = encoder
    for batch in W.batches(table):
        words = W.Words(*W.text_bytes(batch.column("text")))
        ids, size = encoder.encode(words)
        before = np.concatenate([[0], np.cumsum(size)])
        own = before[words.first[1:]] - before[words.first[:-1]]
        rows, kept = [], []
        for doc, at, n in zip(batch.column("doc_id").to_pylist(), before[words.first[:-1]].tolist(), own.tolist()):
            text = np.append(ids[at : at + n], np.uint32(s.end_id)).astype("<u4")
            for piece, start in enumerate(range(0, n + 1, s.capacity)):
                part = text[start : start + s.capacity]
                rows.append((doc, piece, start, len(part), crc32(part.tobytes())))
                if keep_ids:
                    kept.append(part.astype(np.int32))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, settings: PackSettings = PackSettings(), keep_ids: bool = False) -> DataFrame:
    """Pieces of every text with their place and checksum, and their ids if asked for. Null counts as empty."""
    kinds = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, s=settings, keep_ids=keep_ids), kinds)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in decreasing order of size; each bin lists its items."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (gap, bin), ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > n:
            insort(gaps, (gap - n, b))
    return bins


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int, tries: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that increase the sum of squared fills."""
    home = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.bincount(home, sizes, len(bins)).astype(np.int64)
    held = [set(x) for x in bins]
    stuck = np.zeros(len(bins), bool)

    def put(item: int, to: int) -> None:
        a = home[item]
        held[a].discard(item)
        held[to].add(item)
        fill[a] -= sizes[item]
        fill[to] += sizes[item]
        home[item] = to
        stuck[to] = False

    for _ in range(tries):
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if fill.sum() > (np.count_nonzero(fill) - 1) * capacity or len(open_bins) == 0:
            break
        source = int(open_bins[fill[open_bins].argmin()])
        under = np.flatnonzero((fill < capacity) & (fill >= fill[source]))
        under = under[under != source]
        rest = np.flatnonzero((fill[home] < capacity) & (fill[home] >= fill[source]) & (home != source))
        room = capacity - fill
        own = sorted(held[source], key=lambda i: -sizes[i])
        done = False
        for x in own:  # a move into the tightest bin that takes it
            fits = under[room[under] >= sizes[x]]
            if len(fits):
                put(x, int(fits[room[fits].argmin()]))
                done = True
                break
        if done or not len(rest):
            stuck[source] = not done
            continue
        best = (0, None, (), ())
        give = [((x,), int(sizes[x])) for x in own]
        give += [((x, y), int(sizes[x] + sizes[y])) for i, x in enumerate(own[:12]) for y in own[i + 1 : 12]]
        for items, n in give:  # one or two of the source for one of a fuller bin
            grow = n - sizes[rest]
            good = (grow > 0) & (grow <= room[home[rest]])
            if good.any():
                gain = np.where(good, grow * (fill[home[rest]] - fill[source] + grow), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), int(home[rest[k]]), items, (int(rest[k]),))
        order = rest[np.lexsort((sizes[rest], home[rest]))]
        pair = home[order[1:]] == home[order[:-1]]
        left, right = order[:-1][pair], order[1:][pair]
        for x in own:  # one of the source for two of a fuller bin
            grow = sizes[x] - sizes[left] - sizes[right]
            good = (grow > 0) & (grow <= room[home[left]])
            if good.any():
                gain = np.where(good, grow * (fill[home[left]] - fill[source] + grow), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), int(home[left[k]]), (x,), (int(left[k]), int(right[k])))
        if best[1] is None:
            stuck[source] = True
            continue
        for i in best[3]:
            put(i, source)
        for i in best[2]:
            put(i, best[1])
    return [sorted(x) for x in held if x]


def _packed(table: pa.Table, s: PackSettings) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
    sizes = table.column("length").to_numpy()
    bins = improve(sizes, best_fit(sizes, s.capacity), s.capacity, s.tries)
    number, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        number[items] = b
        offset[items] = np.cumsum(sizes[items]) - sizes[items]
    group = table.column("_group").to_numpy()
    return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(group << 32 | number)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    An empty or null text is its end id alone. Repeated rows are packed once
    each. A null doc_id is packed like any other. An empty table gives no rows.
    """
    s = settings
    cut = written_table(pieces(docs, s))
    n_groups = max(1, -(-cut.count() // s.group))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)).cast("bigint"))

    def packed(table: pa.Table) -> pa.Table:
        return _packed(table, s)

    return dealt.groupBy("_group").applyInArrow(packed, PIECES + ", sequence_id bigint, offset bigint")
