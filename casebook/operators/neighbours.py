"""Nearest corpus examples of new texts, and votes among their labels.

Queries are broadcast, in blocks of a bounded number of term weights; the corpus
stays where it is stored. A task indexes some thousand rows at a time by those
terms that any query has, each list in descending order of weight, and keeps the k best rows of every
query. The lowest of them bounds what is looked at next: terms whose largest
weights together stay below it need no look, and a list of another term is left
at the weight from which it can no longer be reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import labels, text
from ..session import ship, written_table
from .ordering import top_per_group

K_EXAMPLES = 8
# Term weights of the queries that are broadcast together, about 12 MB.
BLOCK_TERMS = 1_000_000
# Term weights of the corpus that a task indexes at once.
INDEX_TERMS = 500_000
PLACES = 9
SLACK = 10.0**-PLACES


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, ids, weights): ragged rows as flat arrays and their starts."""
    size = pc.list_value_length(batch.column("term_ids")).fill_null(0).to_numpy()
    ids, weights = (batch.column(c).flatten().to_numpy() for c in ("term_ids", "weights"))
    return np.concatenate([[0], np.cumsum(size)]), ids, weights


class _Index:
    """Some corpus rows, by row and by term with the largest weights first."""

    def __init__(self, batch: pa.RecordBatch, asked: np.ndarray):
        """``asked`` tells by term id whether a query has the term."""
        self.keys = batch.column("key")
        first, ids, weights = _lists(batch)
        met = np.flatnonzero(np.append(asked, False)[np.minimum(ids, len(asked))])
        self.first, self.ids, self.weights = np.searchsorted(met, first), ids[met], weights[met]
        self.n = batch.num_rows
        self.place = pc.rank(self.keys, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
        self.by_key = np.argsort(self.place)
        order = np.argsort(-self.weights)
        small = self.ids.astype(np.uint16) if len(asked) <= 1 << 16 else self.ids  # numpy counts numbers of two bytes instead of comparing them
        order = order[np.argsort(small[order], kind="stable")]
        self.terms, self.impact = self.ids[order], self.weights[order]
        self.rows = np.repeat(np.arange(self.n), np.diff(self.first))[order]
        self.labels = batch.column("label")

    def has_label(self, value: str | None) -> np.ndarray:
        if value is None:
            return np.zeros(self.n, bool)
        return pc.equal(self.labels, value).fill_null(False).to_numpy(zero_copy_only=False)

    def all_scores(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j, w in zip(np.searchsorted(self.terms, ids), np.searchsorted(self.terms, ids, "right"), weights):
            out[self.rows[i:j]] += self.impact[i:j] * w  # a row has a term once
        return out

    def reaching(self, ids: np.ndarray, weights: np.ndarray, least: float) -> np.ndarray:
        """Rows whose score may be ``least`` or more, which is positive."""
        start, stop = np.searchsorted(self.terms, ids), np.searchsorted(self.terms, ids, "right")
        met = stop > start
        start, stop, weights = start[met], stop[met], weights[met]
        bound = self.impact[start] * weights
        order = np.argsort(-bound)
        start, stop, weights, bound = start[order], stop[order], weights[order], bound[order]
        rest = bound[::-1].cumsum()[::-1]  # of a term and all after it
        found = []
        for i in range(np.count_nonzero(rest >= least)):
            needed = (least - (rest[0] - bound[i])) / weights[i] if weights[i] > 0 else 0.0
            j = start[i] + np.searchsorted(-self.impact[start[i] : stop[i]], -needed, "right")
            found.append(self.rows[start[i] : j])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def scores(self, rows: np.ndarray, by_term: np.ndarray) -> np.ndarray:
        size = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.first[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate([[0.0], np.cumsum(by_term[self.ids[at]] * self.weights[at])])
        return sums[ends] - sums[ends - size]


def _indexed(table: Iterator[pa.RecordBatch], asked: np.ndarray, limit: int) -> Iterator[_Index]:
    held, terms = [], 0
    for batch in table:
        if not batch.num_rows:
            continue
        held.append(batch)
        terms += len(batch.column("term_ids").flatten())
        if terms >= limit:
            yield _Index(pa.Table.from_batches(held).combine_chunks().to_batches()[0], asked)
            held, terms = [], 0
    if held:
        yield _Index(pa.Table.from_batches(held).combine_chunks().to_batches()[0], asked)


def _nearest(table: Iterator[pa.RecordBatch], queries: Broadcast, k: int, index_terms: int) -> Iterator[pa.RecordBatch]:
    asked: pa.RecordBatch = queries.value
    first, ids, weights = _lists(asked)
    wanted = asked.column("label").to_pylist()
    # of each query the best rows with its label and the best others, as (-score, null key, key)
    heaps: list[tuple[list, list]] = [([], []) for _ in wanted]
    by_term = np.zeros(int(ids.max()) + 1 if len(ids) else 1)
    in_queries = np.zeros(len(by_term), bool)
    in_queries[ids] = True
    for index in _indexed(table, in_queries, index_terms):
        for q, label in enumerate(wanted):
            same, other = heaps[q]
            open_heaps = [(same, True)] * (label is not None) + [(other, False)] * (len(same) < k)
            least = min(-h[-1][0] if len(h) == k else 0.0 for h, _ in open_heaps)
            i, w = ids[first[q] : first[q + 1]], weights[first[q] : first[q + 1]]
            if least > 0:
                rows = index.reaching(i, w, least - SLACK)
                by_term[i] = w
                score = index.scores(rows, by_term)
                by_term[i] = 0.0
            else:
                rows, score = np.arange(index.n), index.all_scores(i, w)
            score = np.round(score, PLACES)
            labelled = index.has_label(label)[rows]
            for heap, side in open_heaps:
                mine = np.flatnonzero(labelled == side)
                if len(heap) == k:
                    mine = mine[score[mine] >= -heap[-1][0]]
                if len(mine) > 4 * k:  # all that reach the k-th score
                    mine = mine[score[mine] >= np.partition(score[mine], len(mine) - k)[len(mine) - k]]
                best = mine[np.lexsort((index.place[rows[mine]], -score[mine]))[:k]]
                keys = index.keys.take(pa.array(rows[best])).to_pylist()
                heap[:] = sorted(heap + [(-s, x is None, x) for s, x in zip(score[best].tolist(), keys)])[:k]
    out = [(q, side, x, -s) for q, pair in enumerate(heaps) for heap, side in zip(pair, (True, False)) for s, _, x in heap]
    position = pa.array([r[0] for r in out], pa.int64())
    yield pa.RecordBatch.from_arrays(
        [asked.column("key").take(position), asked.column("label").take(position), pa.array([r[1] for r in out], pa.bool_())]
        + [pa.array([r[2] for r in out], queries.value.schema.field("corpus_key").type), pa.array([r[3] for r in out], pa.float64())],
        ["query", "label", "same_label", "key", "similarity"],
    )


def best_of_tasks(
    queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, k: int, preferred: str | None, corpus_label: str | None
) -> list[DataFrame]:
    """Per block of queries, the best corpus rows of each task; the corpus is not moved."""
    ship(queries.sparkSession)
    use_label = bool(preferred and corpus_label)
    none = F.lit(None).cast("string")
    asked = written_table(queries.select(
        F.col(query_key).alias("key"), (F.col(preferred).cast("string") if use_label else none).alias("label"), "term_ids", "weights",
        F.lit(None).cast(corpus.schema[corpus_key].dataType).alias("corpus_key"),
    ))
    docs = corpus.select(F.col(corpus_key).alias("key"), (F.col(corpus_label).cast("string") if use_label else none).alias("label"), "term_ids", "weights")
    blocks = 1 + (asked.agg(F.sum(F.size("term_ids"))).first()[0] or 0) // BLOCK_TERMS
    schema = StructType([
        StructField("query", queries.schema[query_key].dataType), StructField("label", asked.schema["label"].dataType),
        *docs.sparkSession.createDataFrame([], "same_label boolean").schema, StructField("key", corpus.schema[corpus_key].dataType),
        *docs.sparkSession.createDataFrame([], "similarity double").schema,
    ])
    out = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if part.num_rows:
            held = docs.sparkSession.sparkContext.broadcast(part.to_batches()[0])
            out.append(docs.mapInArrow(partial(_nearest, queries=held, k=k, index_terms=INDEX_TERMS), schema))
    return out or [docs.sparkSession.createDataFrame([], schema)]


def nearest_examples(
    queries: DataFrame,
    corpus: DataFrame,
    query_key: str,
    corpus_key: str,
    k: int = K_EXAMPLES,
    preferred: str | None = None,
    corpus_label: str | None = None,
) -> DataFrame:
    """The k most similar corpus rows of each query, by cosine similarity.

    Both sides carry ``term_ids`` and unit-length ``weights``, which are not
    negative. With ``preferred`` and ``corpus_label``, rows whose label equals
    the query's preferred value come first. Rows that share no term have
    similarity 0 and fill up the k. Similarities equal to nine places are ordered by key.
    """
    found = reduce(DataFrame.unionByName, best_of_tasks(queries, corpus, query_key, corpus_key, k, preferred, corpus_label))
    best = top_per_group(found, ["query"], [F.desc("same_label"), F.desc("similarity"), F.asc_nulls_last("key")], k)
    return best.select(F.col("key").alias(corpus_key), F.col("query").alias(query_key), "similarity", "same_label", "rank")


def vote_labels(column: Column | str) -> Column:
    """Values of a label cell that take part in a vote."""
    raw = F.trim(F.coalesce(text._col(column), F.lit("")))
    parts = labels._parts(raw, r"[|,]")
    parts = F.when(F.size(parts) == 0, F.array(raw)).otherwise(parts)
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "nan"))


def label_votes(examples: DataFrame, query_key: str, column: str) -> DataFrame:
    """Summed similarity per (query, label); negative similarities weigh 0."""
    weight = F.greatest(F.col("similarity"), F.lit(0.0))
    return (
        examples.select(query_key, weight.alias("_w"), F.explode(vote_labels(column)).alias("label"))
        .groupBy(query_key, "label")
        .agg(F.sum("_w").alias("weight"))
    )


def weighted_vote(examples: DataFrame, query_key: str, column: str) -> DataFrame:
    """The label with the largest summed similarity of each query."""
    votes = label_votes(examples, query_key, column)
    best = top_per_group(votes, [query_key], [F.desc(F.round("weight", PLACES - 1)), F.asc("label")], 1)
    return best.select(query_key, "label", "weight")
