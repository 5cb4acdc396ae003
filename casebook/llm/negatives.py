"""Hard negatives of anchors by exact integer inner products.

Candidates are dealt by hash into groups of about ``group`` rows, which a task
holds as one matrix; every anchor visits every group, in tiles. A tile of
scores is a product of int64 matrices by Strassen's recursion, with zeros up to
sizes that halve evenly. Additions and products wrap at 64 bits, so a score is
exact whenever it fits, whatever the partial sums.

Two passes are needed, because the window of negatives follows from the score
of a positive. In the first an anchor meets the candidates of its own label and
leaves the ``positives`` best of each group; in the second it meets all others
and leaves the best ``negatives`` in each window. What a group leaves is a heap
of a fixed size; row numbers merge the heaps, first inside the tasks.

The work is anchors times rows. What moves is each candidate once in each pass,
and each anchor once for a group: with 1 row in 100 an anchor, n rows in all and
groups of 16,384, n / 1,638,400 times the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table

#: Squared length, after scaling, up to which 100 times a score fits in 64 bits.
LARGEST = 2**55
NONE = -(2**56)


@dataclass(frozen=True)
class MiningSettings:
    """A negative of an anchor and a positive has ``low`` <= 100 * its score / the positive's <= ``high``."""

    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    group: int = 16_384
    rows: int = 128
    columns: int = 2048
    leaf: int = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """Product of int64 matrices modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    depth = 0
    while min(m, k, n) >> (depth + 1) >= leaf:
        depth += 1
    up = lambda x: -(-x >> depth) << depth
    if (up(m), up(k), up(n)) != (m, k, n):
        a = np.pad(a, ((0, up(m) - m), (0, up(k) - k)))
        b = np.pad(b.T, ((0, up(n) - n), (0, up(k) - k))).T
    return _halved(a, b, depth)[:m, :n]


def _halved(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    (m, k), n = (x // 2 for x in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _halved(a11 + a22, b11 + b22, depth - 1)
    p2 = _halved(a21 + a22, b11, depth - 1)
    p3 = _halved(a11, b12 - b22, depth - 1)
    p4 = _halved(a22, b21 - b11, depth - 1)
    p5 = _halved(a11 + a12, b22, depth - 1)
    p6 = _halved(a21 - a11, b11 + b12, depth - 1)
    p7 = _halved(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Scaled components, one row a vector, with zeros up to ``width``."""
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = np.floor(values.astype(np.float64) * scale)
    return out


class _Rows:
    """Ids, labels, keys and vectors of some rows."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.id, self.label, self.key = (batch.column(c).to_numpy() for c in ("vec_id", "label", "key"))
        sizes = np.diff(batch.column("vector").offsets.to_numpy())
        self.width = int(sizes.max()) if len(sizes) else 0


def _groups(table: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Rows, _Rows, int]]:
    """(candidates of a group, some of its anchors, group) from rows ordered by group and kind."""
    held: list[pa.RecordBatch] = []
    group, candidates = None, None
    for batch in table:
        g, anchor = batch.column("g").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (anchor[1:] != anchor[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if g[a] != group:
                group, held, candidates = g[a], [], None
            if not anchor[a]:
                held.append(part)
            elif held:
                if candidates is None:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    order = np.lexsort((whole.column("key").to_numpy(), whole.column("vec_id").to_numpy(), whole.column("label").to_numpy()))
                    candidates = _Rows(whole.take(pa.array(order)))
                    fresh = np.ones(len(order), bool)  # a row that is listed twice counts once
                    fresh[1:] = (candidates.key[1:] != candidates.key[:-1]) | (candidates.id[1:] != candidates.id[:-1])
                    candidates = _Rows(candidates.batch.filter(pa.array(fresh)))
                yield candidates, _Rows(part), group


def _best_positives(table: Iterator[pa.RecordBatch], s: MiningSettings) -> Iterator[pa.RecordBatch]:
    at, matrix = None, None
    for c, a, group in _groups(table):
        if at != group or matrix.shape[1] < a.width:
            at, matrix = group, _matrix(c.batch.column("vector"), max(c.width, a.width), s.scale)
        anchors = _matrix(a.batch.column("vector"), matrix.shape[1], s.scale)
        cuts = np.flatnonzero(a.label[1:] != a.label[:-1]) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a.label)]):
            left, right = np.searchsorted(c.label, a.label[i]), np.searchsorted(c.label, a.label[i], "right")
            for x in range(i, j, s.rows):
                rows = np.arange(x, min(x + s.rows, j))
                for y in range(left, right, s.columns):
                    some = slice(y, min(y + s.columns, right))
                    score = strassen(anchors[rows], matrix[some].T, s.leaf)
                    own = (c.id[some] == a.id[rows, None]) & (c.key[some] == a.key[rows, None])
                    score = np.where(own, NONE, score)
                    best = np.argsort(-score, axis=1, kind="stable")[:, : s.positives]
                    value = np.take_along_axis(score, best, 1)
                    r, k = np.nonzero(value > NONE)
                    to = best[r, k] + y
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (a.id[rows[r]], a.key[rows[r]], value[r, k], c.id[to], c.key[to])],
                        ["anchor_id", "anchor_key", "positive_score", "positive_id", "positive_key"],
                    )


def _best_negatives(table: Iterator[pa.RecordBatch], s: MiningSettings) -> Iterator[pa.RecordBatch]:
    at, matrix = None, None
    for c, a, group in _groups(table):
        if at != group or matrix.shape[1] < a.width:
            at, matrix = group, _matrix(c.batch.column("vector"), max(c.width, a.width), s.scale)
        anchors = _matrix(a.batch.column("vector"), matrix.shape[1], s.scale)
        scores = a.batch.column("scores")
        size = np.diff(scores.offsets.to_numpy())
        window = np.zeros((len(size), s.positives), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        window[row, np.arange(len(row)) - np.repeat(scores.offsets.to_numpy()[:-1] - scores.offsets.to_numpy()[0], size)] = scores.flatten().to_numpy()
        for x in range(0, len(a.id), s.rows):
            rows = np.arange(x, min(x + s.rows, len(a.id)))
            for y in range(0, len(c.id), s.columns):
                some = slice(y, y + s.columns)
                # by id, so that equal scores keep the smaller one first
                by_id = np.lexsort((c.key[some], c.id[some])) + y
                score = np.where(c.label[by_id] == a.label[rows, None], NONE, strassen(anchors[rows], matrix[by_id].T, s.leaf))
                order = np.argsort(-score, axis=1, kind="stable")
                score = np.take_along_axis(score, order, 1)
                for k in range(s.positives):
                    positive = window[rows, k]
                    start = np.count_nonzero(100 * score > s.high * positive[:, None], axis=1)
                    place = start[:, None] + np.arange(s.negatives)
                    inside = place < score.shape[1]
                    value = np.take_along_axis(score, np.minimum(place, score.shape[1] - 1), 1)
                    r, n = np.nonzero(inside & (value > NONE) & (100 * value >= s.low * positive[:, None]) & (size[rows] > k)[:, None])
                    to = by_id[order[r, place[r, n]]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (a.key[rows[r]], np.full(len(r), k), value[r, n], c.id[to], c.key[to])],
                        ["anchor_key", "k", "negative_score", "negative_id", "negative_key"],
                    )


def _visits(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Candidates, each in its group, and anchors, each in every group; a group's candidates come first."""
    own = F.pmod("key", F.lit(groups)).cast("int").alias("g")
    extra = [c for c in anchors.columns if c not in rows.columns]
    here = rows.select(own, F.lit(False).alias("anchor"), *rows.columns, *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra))
    there = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("anchor"), *rows.columns, *extra)
    return here.unionByName(there).repartition("g").sortWithinPartitions("g", "anchor", "label")


def mine(vectors: DataFrame, anchor: Column, settings: MiningSettings = MiningSettings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; further columns are not read.
    ``anchor`` says which rows are anchors. A component x counts as
    floor(``scale`` * x). The positives of an anchor are the first other rows
    of its label, the negatives of a positive the first rows of another label
    in its window; higher scores come first, ties by smaller vec_id.

    Rows with a null vec_id, label, vector or component, or one that is not
    finite, take no part, nor do vectors so long that 100 times a score could leave 64
    bits (a squared length of 2**55 after scaling). A missing component counts
    as zero, so vectors of unequal sizes are compared over the shorter one; an empty one has the
    score 0 with all. Rows equal in id, label and vector count once; different
    rows of one id each take part. An empty table gives no rows.
    """
    s = settings
    size = F.greatest(F.size("embedding"), F.lit(1)).cast("double")
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * s.scale + 1 < F.sqrt(F.lit(float(LARGEST)) / size)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fits).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.xxhash64("vec_id", "label", "embedding").alias("key"),
        F.col("embedding").alias("vector"), anchor.alias("_anchor"),
    )
    groups = max(1, -(-rows.count() // s.group))
    candidates = rows.drop("_anchor")
    chosen = rows.filter("_anchor").drop("_anchor")
    heaps = _visits(candidates, chosen, groups).mapInArrow(
        partial(_best_positives, s=s), "anchor_id bigint, anchor_key bigint, positive_score bigint, positive_id bigint, positive_key bigint"
    )
    # an anchor that is listed twice leaves the same heap twice
    rank = F.expr("dense_rank() OVER (PARTITION BY anchor_key, anchor_id ORDER BY positive_score DESC, positive_id, positive_key)")
    merged = heaps.withColumn("k", rank).filter(F.col("k") <= s.positives).withColumn("k", F.col("k") - 1).distinct()
    positives = written_table(merged)
    listed = F.array_sort(F.collect_list(F.struct("k", "positive_score")))["positive_score"]
    windows = positives.groupBy("anchor_key", "anchor_id").agg(listed.alias("scores"))
    with_windows = chosen.dropDuplicates(["key", "vec_id"]).join(windows.withColumnsRenamed({"anchor_key": "key", "anchor_id": "vec_id"}), ["key", "vec_id"])
    found = _visits(candidates, with_windows.select(*candidates.columns, "scores"), groups).mapInArrow(
        partial(_best_negatives, s=s), "anchor_key bigint, k bigint, negative_score bigint, negative_id bigint, negative_key bigint"
    )
    rank = F.expr("row_number() OVER (PARTITION BY anchor_key, k ORDER BY negative_score DESC, negative_id, negative_key)")
    best = found.withColumn("rank", rank).filter(F.col("rank") <= s.negatives)
    return best.join(positives.withColumn("k", F.col("k").cast("bigint")), ["anchor_key", "k"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
