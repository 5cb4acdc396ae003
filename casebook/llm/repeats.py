"""Exact removal of repeated byte strings.

A byte goes if a string of ``length`` bytes that also starts earlier covers it.
The suffixes that matter are those cut at ``length`` bytes, one window for each
start. They are sorted one bucket at a time, in the manner of a difference-cover
construction:

* The cover is content-defined: in every window the leftmost least hash of
  ``sample`` bytes is the cover position. Equal windows have their cover
  position at the same offset, which is what a periodic difference cover
  guarantees for two starts, at 1 position in 25 instead of 1 in 7.
* A bucket holds the windows with the same cover sample. Buckets whose sample
  occurs in one place are dropped before any bytes are moved.
* In a bucket the bytes after the sample, and the bytes before it read
  backwards, are sorted once. The ranks of all truncations follow from the
  common prefixes of neighbours, so that two windows are equal exactly when two
  precomputed ranks are. No window is compared byte by byte.
* A bucket of more than ``block`` places, such as a common line among ever other
  neighbours, is not gathered: each of its windows goes to a bucket of its own
  bytes and offset.

Only cover samples, the few bytes around repeated ones, and the texts by hash
are shuffled. Texts that are equal as a whole are compared once, and contexts
seen earlier in the same batch are settled there, so a passage that a third of
all documents share sends one row for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SEGMENT = W.BLOCK - 1024
_LOW = np.uint64(W.BLOCK - 1)
NO_DOC = (1 << 63) - 1


@dataclass(frozen=True)
class RepeatSettings:
    """``length`` of the strings, ``sample`` bytes of a cover sample, ``block`` contexts sorted at once; samples in more places are split by window."""

    length: int = 100
    sample: int = 48
    block: int = 30_000


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if span < w else h


def cover(data: np.ndarray, offsets: np.ndarray, s: RepeatSettings) -> tuple[np.ndarray, ...]:
    """(text, at, lo, hi, hash): cover position ``at`` serves the windows that start at ``lo`` to ``hi``."""
    k, w, n = s.sample, s.length - s.sample + 1, len(data)
    sizes = np.diff(offsets)
    long = sizes >= s.length
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - s.length + 1, -1)
    valid = np.cumsum(step, dtype=np.int8)[:n].astype(bool)
    parts = []
    for at in range(0, max(n - s.length + 1, 0), SEGMENT):
        stop = min(n, at + SEGMENT + s.length - 1)
        b = data[at:stop]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(W._VALUE[b] * W._UP[: len(b)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * W._DOWN[: len(b) - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        best = _least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), w) & _LOW
        good = valid[at : at + len(best)]
        fresh = good.copy()
        fresh[1:] &= ~good[:-1] | (best[1:] != best[:-1])
        last = good.copy()
        last[:-1] &= ~good[1:] | (best[1:] != best[:-1])
        lo, hi = np.flatnonzero(fresh), np.flatnonzero(last)
        pos = best[lo].astype(np.int64)
        parts.append((pos + at, lo + at, hi + at, h[pos]))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    pos, lo, hi, h = (np.concatenate(x) for x in zip(*parts))
    text = np.searchsorted(offsets, lo, "right") - 1
    return text, pos - offsets[text], lo - offsets[text], hi - offsets[text], h.view(np.int64)


def _samples(table: Iterator[pa.RecordBatch], s: RepeatSettings) -> Iterator[pa.RecordBatch]:
    """(hash, mark, times): each cover sample of each text, and its places in it."""
    for batch in W.batches(table):
        text, _, lo, _, h = cover(*W.text_bytes(batch.column("text")), s)
        order = np.lexsort((lo, h, text))
        text, h = text[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(h)))
        marks = batch.column("mark").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(marks[text[at]]), pa.array(times, pa.int64())], ["hash", "mark", "times"])


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary column of byte spans that may overlap."""
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for i in range(0, len(start), 8192):
        j = min(i + 8192, len(start))
        out[ends[i] : ends[j]] = data[np.repeat(start[i:j] - ends[i:j], size[i:j]) + np.arange(ends[i], ends[j])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


_CONTEXT = ["hash", "doc_id", "mark", "at", "lo", "hi", "before", "after"]
CONTEXT_TYPES = "hash bigint, doc_id bigint, mark bigint, at bigint, lo bigint, hi bigint, before binary, after binary"


def _hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte spans."""
    out = np.zeros(len(first), np.uint64)
    for a in range(0, len(data), SEGMENT):  # spans are short: a segment and what reaches over its end
        b = min(len(data), a + SEGMENT + 1024)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(W._VALUE[data[a:b]] * W._UP[: b - a], out=sums[1:])
        here = np.flatnonzero((first >= a) & (first < a + SEGMENT))
        x = first[here] - a
        out[here] = (sums[x + size[here]] - sums[x]) * W._DOWN[x]
    return out


def _earliest(keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their key."""
    fresh = np.zeros(len(keys), bool)
    fresh[np.unique(keys, return_index=True)[1]] = True
    return fresh


def _places(*ordered: np.ndarray) -> np.ndarray:
    """Which of the ordered rows name another place than the row before."""
    fresh = np.zeros(len(ordered[0]), bool)
    fresh[:1] = True
    for x in ordered:
        fresh[1:] |= x[1:] != x[:-1]
    return fresh


def _contexts(table: Iterator[pa.RecordBatch], s: RepeatSettings) -> Iterator[pa.RecordBatch]:
    """Bytes around the repeated cover samples of each text.

    A context that an earlier text or place of the batch has as well is settled
    here: its row has no bytes and ``at`` = -1, and ``lo`` to ``hi`` go.
    Contexts of crowded samples give a row for each window, with a hash of its
    own; windows seen earlier in the batch are settled likewise.
    """
    for batch in W.batches(table):
        data, offsets = W.text_bytes(batch.column("text"))
        text, at, lo, hi, h = cover(data, offsets, s)

        def listed(column: str, text: np.ndarray, h: np.ndarray) -> np.ndarray:
            """Whether each sample is in the list of its text."""
            wanted = batch.column(column)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            pair = np.concatenate([h, wanted.flatten().to_numpy()]).view(np.uint64)
            pair = W.mix(pair + W.mix(np.concatenate([text, owner]).astype(np.uint64)))
            return np.isin(pair[: len(h)], pair[len(h) :])

        keep = listed("samples", text, h)
        text, at, lo, hi, h = (x[keep] for x in (text, at, lo, hi, h))
        doc, mark = batch.column("_order").to_numpy()[text], batch.column("mark").to_numpy()[text]
        order = np.lexsort((lo, at, mark, doc))
        order = order[_places(doc[order], mark[order], at[order], lo[order])]  # a document may be listed twice
        text, at, lo, hi, h, doc, mark = (x[order] for x in (text, at, lo, hi, h, doc, mark))
        base = offsets[text]
        first, size = lo + base, hi - lo + s.length
        whole = W.mix(_hashes(data, first, size) + W.mix(h.view(np.uint64) + (at - lo).astype(np.uint64) * np.uint64(4099) + (hi - lo).astype(np.uint64)))
        fresh = _earliest(whole)
        split = fresh & listed("crowded", text, h)

        zero = np.zeros(len(h), np.int64)
        before = _spans(data, first, np.where(fresh & ~split, at - lo, zero))
        after = _spans(data, np.where(fresh, first + (at - lo) + s.sample, zero), np.where(fresh & ~split, hi + s.length - at - s.sample, zero))
        made = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(fresh, h, mark ^ at), doc, mark, np.where(fresh, at, -1), lo, hi)] + [before, after], _CONTEXT)
        yield made.filter(pa.array(~split)) if split.any() else made

        for some in np.split(np.flatnonzero(split), range(4096, np.count_nonzero(split), 4096)) if split.any() else ():
            yield from _windows(data, base[some], at[some], lo[some], hi[some], h[some], doc[some], mark[some], s)


def _windows(data: np.ndarray, base, at, lo, hi, h, doc, mark, s: RepeatSettings, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Contexts as one row for each window; windows seen earlier here are settled."""
    count = hi - lo + 1
    row = np.repeat(np.arange(len(at)), count)
    start = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    offset = at[row] - start
    own = W.mix(h.view(np.uint64)[row] + offset.astype(np.uint64) * np.uint64(4099))
    own = W.mix(_hashes(data, base[row] + start, np.full(len(row), s.length, np.int64)) + own)
    fresh = _earliest(own)
    gone = np.flatnonzero(~fresh)
    if len(gone):  # as runs of starts in a context
        new = np.ones(len(gone), bool)
        new[1:] = (row[gone[1:]] != row[gone[:-1]]) | (gone[1:] != gone[:-1] + 1)
        a, b = gone[new], gone[np.append(np.flatnonzero(new)[1:] - 1, len(gone) - 1)]
        none = pa.array([b""] * len(a), pa.binary())
        x = row[a]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (mark[x] ^ start[a], doc[x], mark[x], np.full(len(a), -1, np.int64), start[a], start[b])] + [none, none], _CONTEXT)
    left = np.flatnonzero(fresh)
    for i in range(0, len(left), rows):
        w = left[i : i + rows]
        x, begin = row[w], start[w] + base[row[w]]
        before, after = _spans(data, begin, offset[w]), _spans(data, begin + offset[w] + s.sample, s.length - s.sample - offset[w])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own[w].view(np.int64), doc[x], mark[x], at[x], start[w], start[w])] + [before, after], _CONTEXT)


def _matrix(column: pa.Array, width: int, backwards: bool) -> np.ndarray:
    """(rows, width) bytes, padded with zeros."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    inside = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
    out = np.zeros((len(size), width), np.uint8)
    out[row, np.repeat(size, size) - 1 - inside if backwards else inside] = raw[offsets[0] : offsets[-1]]
    return out


def _ranks(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of (bucket, bytes), and the common prefix with the row before (-1: another bucket)."""
    order = np.lexsort((np.ascontiguousarray(side).view(f"S{side.shape[1]}").ravel(), bucket))
    a = side[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(1), differ.argmax(1), side.shape[1])
    common = np.where(bucket[order][1:] == bucket[order][:-1], common, -1)
    return order, np.concatenate([[-1], common])


def _block(batch: pa.RecordBatch, s: RepeatSettings) -> pa.RecordBatch:
    """Spans (mark, span) that go, of whole buckets; span packs start and length."""
    mark, at, lo, hi = (batch.column(c).to_numpy() for c in ("mark", "at", "lo", "hi"))
    done = at < 0
    out_mark, out_lo, out_hi = [mark[done]], [lo[done]], [hi[done]]
    rest = batch.filter(pa.array(~done))
    if rest.num_rows > 1:
        doc, mark, at, lo = (rest.column(c).to_numpy() for c in ("doc_id", "mark", "at", "lo"))
        order = np.lexsort((lo, at, mark, doc))
        rest = rest.take(pa.array(order[_places(doc[order], mark[order], at[order], lo[order])]))
    if rest.num_rows > 1:
        h, doc, mark, at, lo, hi = (rest.column(c).to_numpy() for c in ("hash", "doc_id", "mark", "at", "lo", "hi"))
        width = s.length - s.sample
        before, after = _matrix(rest.column("before"), width, True), _matrix(rest.column("after"), width, False)
        bucket = np.unique(h, return_inverse=True)[1]
        order_b, common_b = _ranks(bucket, before)
        order_a, common_a = _ranks(bucket, after)
        earlier = np.lexsort((at, mark, doc))
        gone = np.zeros((len(h), width + 1), bool)
        rank_b, rank_a = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        for o in range(width + 1):  # windows with o bytes before the sample
            rows = earlier[((at - hi <= o) & (o <= at - lo))[earlier]]
            if len(rows) > 1:
                rank_b[order_b] = np.cumsum(common_b < o)
                rank_a[order_a] = np.cumsum(common_a < width - o)
                _, first, inverse = np.unique(rank_b[rows] * (len(h) + 1) + rank_a[rows], return_index=True, return_inverse=True)
                gone[rows, o] = first[inverse] != np.arange(len(rows))
        # offsets that go, as runs: a run of o from x to y covers starts at - y to at - x
        edge = np.zeros((len(h), width + 3), np.int8)
        edge[:, 1:-1] = gone
        step = np.diff(edge, axis=1)
        row, x = np.nonzero(step == 1)
        _, y = np.nonzero(step == -1)
        out_mark.append(mark[row])
        out_lo.append(at[row] - (y - 1))
        out_hi.append(at[row] - x)
    mark, lo, hi = (np.concatenate(x) for x in (out_mark, out_lo, out_hi))
    return pa.RecordBatch.from_arrays([pa.array(mark), pa.array(lo << 24 | np.minimum(hi - lo + s.length, (1 << 24) - 1))], ["mark", "span"])


def _sorted_buckets(table: Iterator[pa.RecordBatch], s: RepeatSettings) -> Iterator[pa.RecordBatch]:
    """Whole buckets, at least ``block`` rows at a time, from rows ordered by hash."""
    held: list[pa.RecordBatch] = []
    for batch in table:
        while batch.num_rows:
            h = batch.column("hash").to_numpy()
            if sum(b.num_rows for b in held) >= s.block:
                last = held[-1].column("hash")[-1].as_py()
                cut = int(np.searchsorted(h, last, "right"))
                if cut < batch.num_rows:
                    yield _block(_joined(held + [batch.slice(0, cut)]), s)
                    held, batch = [], batch.slice(cut)
                    continue
            held.append(batch)
            break
    if held:
        yield _block(_joined(held), s)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def remaining(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pieces of ``raw`` that are left without the spans, and the maximal spans."""
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.ones(len(lo), bool)
    fresh[1:] = lo[1:] > hi[:-1]
    starts, ends = lo[fresh], hi[np.append(np.flatnonzero(fresh)[1:] - 1, len(lo) - 1)]
    pieces, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        pieces.append(raw[at:a])
        at = b
    return [*pieces, raw[at:]], starts, ends


def _results(table: Iterator[pa.RecordBatch], s: RepeatSettings, decode: bool) -> Iterator[pa.RecordBatch]:
    for batch in W.batches(table):
        kept, starts, ends, sizes, texts = [], [], [], [], []
        for raw, copy, spans in zip(
            batch.column("text").cast(pa.binary()).to_pylist(), batch.column("copy").to_pylist(), batch.column("spans")
        ):
            raw = raw or b""
            sizes.append(len(raw))
            if copy and len(raw) >= s.length:
                pieces = []
                starts.append([0])
                ends.append([len(raw)])
            elif spans.is_valid and len(spans):
                packed = spans.values.to_numpy()
                pieces, a, b = remaining(raw, packed >> 24, (packed >> 24) + (packed & ((1 << 24) - 1)))
                starts.append(a.tolist())
                ends.append(b.tolist())
            else:
                pieces = [raw]
                starts.append([])
                ends.append([])
            kept.append(b"".join(pieces))
            if decode:  # characters that lost a byte go as a whole
                texts.append("".join(x.decode(errors="ignore") for x in pieces))
        others = [c for c in batch.schema.names if c not in ("text", "copy", "spans", "mark", "_order")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in others]
            + [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
            + [pa.array(texts, pa.string())] * decode,
            [*others, "n_bytes", "kept", "starts", "ends", *["kept_text"] * decode],
        )


def remove_repeats(docs: DataFrame, settings: RepeatSettings = RepeatSettings(), decode: bool = False) -> DataFrame:
    """Columns of ``docs`` but text, with n_bytes, kept (the remaining bytes), and starts, ends of the removed spans.

    ``decode`` adds kept_text, in which characters that lost a byte are left out.
    ``docs`` has doc_id bigint and text; further columns pass through, but for those named like a result. Earlier
    means a smaller doc_id, or an earlier start in the same text. A null text
    counts as empty. A null doc_id comes after all others. Rows with the same
    doc_id and text are one document, and each gets its result; different texts
    with the same doc_id are ordered by a hash of the text. Texts under
    ``length`` bytes stay. An empty table gives no rows.
    """
    s = settings
    made = {"n_bytes", "kept", "starts", "ends", "kept_text"}
    extra = [c for c in docs.columns if c not in ("doc_id", "text") and c not in made]
    texts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_none"), *extra).alias("_extra"), F.coalesce("doc_id", F.lit(NO_DOC)).alias("_order"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
    )
    long = texts.filter(F.octet_length("text") >= s.length)
    firsts = long.groupBy("mark").agg(F.min("_order").alias("first_doc"))
    samples = long.select("text", "mark").mapInArrow(partial(_samples, s=s), "hash bigint, mark bigint, times bigint")
    beside = "OVER (PARTITION BY hash ORDER BY mark)"
    again = samples.withColumn("other", F.expr(f"lag(mark) {beside} <> mark OR lead(mark) {beside} <> mark")).filter("times > 1 OR other")
    again = again.withColumn("places", F.expr("sum(times) OVER (PARTITION BY hash)"))
    wanted = again.groupBy("mark").agg(F.collect_set("hash").alias("samples"), F.collect_set(F.when(F.col("places") > s.block, F.col("hash"))).alias("crowded"))
    # not "=": as a join key it would shuffle the texts once more
    sources = texts.join(wanted.join(firsts, "mark"), "mark").filter("_order <= first_doc")
    # all columns, as in the join below: Spark then shuffles the texts once for both
    contexts = sources.select(*texts.columns, "samples", "crowded").mapInArrow(partial(_contexts, s=s), CONTEXT_TYPES)
    spans = contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(partial(_sorted_buckets, s=s), "mark bigint, span bigint")
    per_text = spans.groupBy("mark").agg(F.collect_set("span").alias("spans"))
    joined = texts.join(per_text, "mark", "left").join(firsts, "mark", "left")
    joined = joined.withColumn("copy", F.coalesce(F.col("_order") > F.col("first_doc"), F.lit(False)))
    kinds = texts.select("_extra").schema[0].dataType.simpleString()
    out = joined.select(*texts.columns, "copy", "spans").mapInArrow(
        partial(_results, s=s, decode=decode), f"doc_id bigint, _extra {kinds}, n_bytes bigint, kept binary, starts array<bigint>, ends array<bigint>" + ", kept_text string" * decode
    )
    return out.select("doc_id", *(F.col("_extra")[c].alias(c) for c in extra), *out.columns[2:])
