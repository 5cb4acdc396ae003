"""TF-IDF over word and word-pair vocabularies of a bounded size."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import text
from ..functions.binding import let
from ..session import ship, written_table
from .ordering import largest

# Words that a task counts or weighs at once.
WORDS_AT_ONCE = 2_000_000
# Terms of them that a task reports, as a multiple of the vocabulary and at least so many.
REPORTED, LEAST_REPORTED = 4, 10_000


def english_stop_words() -> list[str]:
    """Spark's own English list; pass another one through ``TermSettings``."""
    return StopWordsRemover.loadDefaultStopWords("english")


@dataclass(frozen=True)
class TermSettings:
    """Which terms are counted and how they are weighted.

    ``max_features`` bounds the vocabulary. That makes it safe to hold on the
    driver and to broadcast.
    """

    stop_words: tuple[str, ...] = ()
    bigrams: bool = False
    min_df: int = 1
    max_df: float = 1.0
    max_features: int = 20_000
    sublinear: bool = False


def stored_words(df: DataFrame, column: str, settings: TermSettings, *keep: str) -> DataFrame:
    """Write the words of every text once, with the columns to keep; ``words`` then stands for the text.

    Document count, vocabulary and vectors all read this table, so texts are
    split once. Rows are dealt by the first kept column before they are split,
    because a file of texts may be a single task and words are larger than texts.
    """
    n = 3 * df.sparkSession.sparkContext.defaultParallelism
    words = text.tokens(F.coalesce("_text", F.lit("")), list(settings.stop_words))
    dealt = df.select(*keep, text._col(column).alias("_text")).repartition(n, keep[0])
    return written_table(dealt.select(*keep, words.alias("words")))


def row_terms(column: Column | str, settings: TermSettings, split: bool = False) -> Column:
    """All terms of a text: words without stop words, then pairs if wanted. ``split``: the column holds words already."""
    words = text._col(column) if split else text.tokens(F.coalesce(text._col(column), F.lit("")), list(settings.stop_words))
    return let(words, text.with_bigrams) if settings.bigrams else words


def _is_split(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, ArrayType)


def _words(df: DataFrame, column: str, settings: TermSettings) -> Column:
    """The words of a text, or of a column that holds words already, joined by spaces.

    Words hold no spaces. One string for a text reaches Python faster than its
    words one by one, and is split there.
    """
    return F.array_join(row_terms(column, TermSettings(settings.stop_words), _is_split(df, column)), " ")


def _lists(words: pa.Array) -> pa.Array:
    """Lists of words, of such lists or of strings of joined words."""
    if pa.types.is_list(words.type) or pa.types.is_large_list(words.type):
        return words
    return pc.split_pattern(pc.if_else(pc.equal(words, ""), None, words), " ")


def _slices(lists: pa.Array | pa.ChunkedArray, at_once: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """(words, row of each word, rows) of consecutive rows with at most ``at_once`` words together, or of one row."""
    size = pc.list_value_length(lists).fill_null(0).to_numpy()
    words = pc.list_flatten(lists)
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    ends, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + at_once, "right")) - 1)
        yield words[ends[i] : ends[j]], np.repeat(np.arange(j - i), size[i:j]), j - i
        i = j


def _gathered(table: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.ChunkedArray]:
    """The first column of consecutive batches that have about ``at_once`` words together."""
    held, n = [], 0
    for batch in table:
        lists = _lists(batch.column(0))
        held.append(lists)
        n += len(lists.flatten())
        if n >= at_once:
            yield pa.chunked_array(held)
            held, n = [], 0
    if n:
        yield pa.chunked_array(held)


def _counted(table: Iterator[pa.RecordBatch], bigrams: bool, at_once: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """(term, cf, df) of some texts at a time: every word is a number, and a pair of neighbours is a number of two digits.

    With ``most``, only so many of the most frequent terms of these texts come
    out, and ``unseen``, the largest count among the others, beside each of them
    and in a row of its own without a term.
    """
    for lists in _gathered(table, at_once):
        for words, row, _ in _slices(lists, at_once):
            _, row = np.unique(row, return_inverse=True)  # rows without words are left out
            coded = words.dictionary_encode()
            names, code, n = coded.dictionary, coded.indices.to_numpy().astype(np.int64), int(row[-1]) + 1 if len(row) else 0
            if not n:
                continue
            size = len(names)
            found = [code * n + row]
            if bigrams:
                near = np.flatnonzero(row[1:] == row[:-1])
                found.append((size + code[near] * size + code[near + 1]) * n + row[near])
            each = np.concatenate(found)
            each.sort()
            first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))  # of a term in a text
            term = each[first] // n
            start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            cf = np.diff(np.append(first[start], len(each)))
            df = np.diff(np.append(start, len(term)))
            pair, unseen = term[start] - size, 0
            if most is not None and len(cf) > most:
                unseen = int(np.partition(cf, len(cf) - most - 1)[len(cf) - most - 1])
                taken = cf > unseen
                pair, cf, df = pair[taken], cf[taken], df[taken]
            cut = int(np.searchsorted(pair, 0))
            named = [names.take(pa.array(pair[:cut] + size))]
            if bigrams:
                named.append(pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in np.divmod(pair[cut:], size)), " "))
            columns = [pa.concat_arrays(named), pa.array(cf, pa.int64()), pa.array(df, pa.int64())]
            if most is None:
                yield pa.RecordBatch.from_arrays(columns, ["term", "cf", "df"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(cf), unseen), pa.int64())], ["term", "cf", "df", "unseen"])
                yield pa.RecordBatch.from_pydict({"term": pa.nulls(1, pa.string()), **{c: pa.array([x], pa.int64()) for c, x in (("cf", 0), ("df", 0), ("unseen", unseen))}})


def _counted_again(table: Iterator[pa.RecordBatch], shared: Broadcast, at_once: int) -> Iterator[pa.RecordBatch]:
    """(term, cf, df) of the terms of a ``_Weigher`` in all texts of a task."""
    weigher: _Weigher = shared.value
    n = len(weigher.terms)
    cf, df = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lists in _gathered(table, at_once):
        for words, row, _ in _slices(lists, at_once):
            _, term, tf = weigher.found(words, row)
            cf += np.bincount(term, tf, n).astype(np.int64)
            df += np.bincount(term, minlength=n)
    met = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([weigher.terms.take(pa.array(met)), pa.array(cf[met]), pa.array(df[met])], ["term", "cf", "df"])


def vocabulary(df: DataFrame, column: str, settings: TermSettings, n_docs: int) -> DataFrame:
    """(term, cf, df): the terms that pass the document limits, most frequent first.

    A task counts the terms of some texts at a time, as numbers, and deals the
    most frequent of them by term. What it leaves out bounds the counts of all
    terms from above, and what it deals bounds them from below; the few terms
    that may belong to the ``max_features`` most frequent are then counted in
    all texts. Where the bounds do not tell them from the rest, as among terms
    of equal counts, every term of every task is dealt and counted. The
    vocabulary is cut at a count that histograms give, so no task gathers the
    candidates.
    """
    ship(df.sparkSession)
    words = df.select(_words(df, column, settings).alias("words"))
    count = partial(_counted, bigrams=settings.bigrams, at_once=WORDS_AT_ONCE)
    allowed = n_docs * settings.max_df
    most = max(REPORTED * settings.max_features, LEAST_REPORTED)
    counts = written_table(_summed(words.mapInArrow(partial(count, most=most), "term string, cf bigint, df bigint, unseen bigint"), "cf", "df", "unseen"))
    unseen = counts.filter("term IS NULL").select("unseen").first()
    if unseen and unseen[0]:
        near = _may_be_largest(counts.filter("term IS NOT NULL"), unseen[0], settings, n_docs, most)
        if near is None:
            counts = _summed(words.mapInArrow(count, "term string, cf bigint, df bigint"), "cf", "df")
        else:
            shared = df.sparkSession.sparkContext.broadcast(_Weigher(near, [0.0] * len(near), settings))
            again = partial(_counted_again, shared=shared, at_once=WORDS_AT_ONCE)
            counts = _summed(words.mapInArrow(again, "term string, cf bigint, df bigint"), "cf", "df")
    kept = counts.filter(F.col("term").isNotNull() & (F.col("df") >= settings.min_df) & (F.col("df") <= allowed)).select("term", "cf", "df")
    return largest(written_table(kept), "cf", "term", settings.max_features).orderBy(F.desc("cf"), "term")


def _summed(some: DataFrame, *columns: str) -> DataFrame:
    return some.repartition("term").groupBy("term").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def _may_be_largest(counts: DataFrame, unseen: int, settings: TermSettings, n_docs: int, most: int) -> list[str] | None:
    """Terms whose count may be among the largest, by bounds; None if others may be, or if they are more than ``most``.

    The tasks together left out at most ``unseen`` of a term that none dealt,
    and of another what those left out that did not deal it.
    """
    allowed, missing = n_docs * settings.max_df, unseen - F.col("unseen")
    sure = (F.col("df") >= settings.min_df) & (F.least(F.col("df") + missing, F.lit(n_docs)) <= allowed)
    # Bounded by max_features.
    top = counts.filter(sure).orderBy(F.desc("cf")).limit(settings.max_features).agg(F.count(F.lit(1)), F.min("cf")).first()
    if top[0] < settings.max_features or top[1] <= unseen:
        return None
    near = counts.filter((F.col("cf") + missing >= top[1]) & (F.col("df") + missing >= settings.min_df) & (F.col("df") <= allowed))
    rows = near.select("term").limit(most + 1).collect()
    return sorted(r["term"] for r in rows) if len(rows) <= most else None


class _Weigher:
    """Term ids and unit-length weights of lists of words; a pair of neighbours is looked up by the numbers of its words."""

    def __init__(self, terms: list[str], idf: list[float], settings: TermSettings):
        self.terms = pa.array(terms, pa.string())
        # words hold no spaces, so a term with one is a pair
        parts = [t.split(" ", 1) for t in terms] if settings.bigrams else [[t] for t in terms]
        names = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(names)}
        self.names, self.size = pa.array(names, pa.string()), len(names)
        self.single = np.full(len(names) + 1, -1, np.int64)  # the last is for words of no term
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = i
            else:
                pairs.append((number[p[0]] * self.size + number[p[1]], i))
        self.pairs, self.pair_ids = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.idf, self.sublinear = np.array(idf), settings.sublinear

    def found(self, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term id, count) of the terms in these words."""
        n = len(self.idf)
        code = pc.index_in(words, self.names).fill_null(-1).to_numpy().astype(np.int64)
        term = self.single[code]
        met = np.flatnonzero(term >= 0)
        found = [row[met] * n + term[met]]
        if len(self.pairs):
            near = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
            pair = code[near] * self.size + code[near + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            met = self.pairs[at] == pair
            found.append(row[near[met]] * n + self.pair_ids[at[met]])
        each, tf = np.unique(np.concatenate(found), return_counts=True)
        return *np.divmod(each, max(n, 1)), tf

    def weigh(self, lists: pa.Array, at_once: int) -> pa.Array:
        lists = _lists(lists)
        ids, weights, sizes, done = [], [], np.zeros(len(lists), np.int64), 0
        for words, row, n_rows in _slices(lists, at_once):
            own, term, tf = self.found(words, row)
            weight = tf * self.idf[term]
            if self.sublinear:
                weight = (1 + np.log(tf)) * weight / tf
            if len(own):
                start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                length = np.sqrt(np.add.reduceat(weight * weight, start))
                length[length == 0] = 1.0
                many = np.diff(np.append(start, len(own)))
                weight = weight / np.repeat(length, many)
                sizes[done + own[start]] = many
            ids.append(term.astype(np.int32))
            weights.append(weight)
            done += n_rows
        first = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((ids, np.int32), (weights, np.float64)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(first, pa.array(x)) for x in flat], ["term_ids", "weights"])


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary with inverse document frequencies, in one order."""

    terms: list[str]
    idf: list[float]
    settings: TermSettings = field(default_factory=TermSettings)

    @cached_property
    def _weigher(self) -> _Weigher:
        return _Weigher(self.terms, self.idf, self.settings)

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``term_ids`` and ``weights``, arrays of one unit-length sparse row.

        Without a shuffle: terms are counted against the broadcast vocabulary,
        scaled and normalised, some texts at a time.
        """
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self._weigher)

        def weigh(words: pa.Array) -> pa.Array:
            return shared.value.weigh(words, WORDS_AT_ONCE)

        weighed = F.arrow_udf(weigh, "term_ids array<int>, weights array<double>")(_words(df, column, self.settings))
        return df.withColumn("_w", weighed).withColumns({c: F.col(f"_w.{c}") for c in ("term_ids", "weights")}).drop("_w")

    def terms_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, v) for i, (t, v) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term_id int, term string, idf double")

    def vector_table(self, df: DataFrame) -> DataFrame:
        """Write the rows once with a ``features`` vector for the ML estimators.

        Arrays are stored in the layout of a sparse vector and read back as
        one, so no row passes through Python.
        """
        layout = F.struct(
            F.lit(0).cast("byte").alias("type"),
            F.lit(len(self.terms)).alias("size"),
            F.col("term_ids").alias("indices"),
            F.col("weights").alias("values"),
        )
        stored = df.withColumn("features", layout)
        schema = StructType(
            [StructField("features", VectorUDT()) if f.name == "features" else f for f in stored.schema.fields]
        )
        return written_table(stored, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        self.terms_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
        settings = json.dumps(asdict(self.settings))
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TfidfModel:
        # The saved table has at most max_features rows.
        rows = spark.read.parquet(f"{path}/terms").orderBy("term_id").collect()
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        settings["stop_words"] = tuple(settings["stop_words"])
        return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], TermSettings(**settings))


def fit_tfidf(df: DataFrame, column: str, settings: TermSettings) -> TfidfModel:
    """Vocabulary with smooth idf, ln((1 + n) / (1 + df)) + 1; ``column`` holds texts, or words as ``stored_words`` leaves them."""
    n = df.count()
    # Bounded by max_features.
    rows = vocabulary(df, column, settings, n).select("term", "df").collect()
    if not rows:
        raise ValueError("No terms are left after the document limits.")
    rows.sort(key=lambda r: r["term"])
    idf = [math.log((1 + n) / (1 + r["df"])) + 1 for r in rows]
    return TfidfModel([r["term"] for r in rows], idf, settings)


def weights_long(vectorised: DataFrame, *keep: str) -> DataFrame:
    """One row per text and term id with its weight."""
    return vectorised.select(*keep, F.explode(F.arrays_zip("term_ids", "weights")).alias("_z")).select(
        *keep, F.col("_z.term_ids").alias("term_id"), F.col("_z.weights").alias("weight")
    )


def with_terms(long: DataFrame, model: TfidfModel) -> DataFrame:
    """Replace term ids by terms; the vocabulary is bounded by max_features."""
    return long.join(F.broadcast(model.terms_table(long.sparkSession).drop("idf")), "term_id").drop("term_id")
