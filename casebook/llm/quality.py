"""Quality rules, and a linear-chain conditional random field over lines.

Each line with a word is a step of a chain. Its features are counts over its
bytes; labels are content or boilerplate. The most likely labelling comes from
Viterbi decoding, and a document stays if the rules pass and enough of its
words stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

FEATURES = ("bias", "symbols", "upper", "marks", "pipes", "digits", "short", "stop", "again", "letters")
SYMBOLS = b"#*$%&|<>"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _LOWER = _class(SYMBOLS), _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_MARK, _DIGIT, _STOP = _class(b"!?"), _class(b"0123456789"), _class(b".!?:;\"')")


@dataclass(frozen=True)
class LineModel:
    """``emit``: weights for content against boilerplate; ``move``[a, b]: weight of label b after a (0 boilerplate, 1 content)."""

    emit: tuple[float, ...] = (2.0, -12.0, -3.0, -6.0, -8.0, -2.0, -0.5, 0.5, -1.0, 0.5)
    move: tuple[tuple[float, float], tuple[float, float]] = ((0.7, 0.0), (0.0, 0.7))


@dataclass(frozen=True)
class QualitySettings:
    """``train_docs`` bounds the labelled documents that the field is fitted on."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_content: float = 0.5
    train_docs: int = 1500
    steps: int = 150
    rate: float = 0.15
    penalty: float = 1e-3


@dataclass
class Lines:
    """Lines with a word: their text, words and features; and the counts of each text."""

    text: np.ndarray
    n_words: np.ndarray
    features: np.ndarray
    counts: dict[str, np.ndarray] = field(default_factory=dict)


def lines_of(column: pa.Array) -> Lines:
    data, offsets = W.text_bytes(column)
    words = W.Words(data, offsets)
    n_texts = len(offsets) - 1
    cut = np.flatnonzero(data == 10)
    text_of_cut = np.searchsorted(offsets, cut, "right") - 1
    starts = np.concatenate([offsets[:-1], cut + 1])
    ends = np.concatenate([offsets[1:], cut])
    text = np.concatenate([np.arange(n_texts), text_of_cut])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = ends[np.lexsort((ends, np.concatenate([np.arange(n_texts), text_of_cut])))]
    first = np.searchsorted(words.starts, starts)
    held = np.searchsorted(words.starts, ends) - first
    some = held > 0
    starts, ends, text, held = starts[some], ends[some], text[some], held[some]

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (sums[ends] - sums[starts]).astype(np.int64)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)

    symbols = _SYMBOL[data]
    key = W.mix(W.span_hashes(data, starts, ends) + W.mix(text.astype(np.uint64)))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    upper, lower = per_line(_UPPER[data]), per_line(_LOWER[data])
    size = np.maximum(ends - starts, 1)
    last = data[words.ends[np.searchsorted(words.ends, ends, "right") - 1] - 1] if len(starts) else np.zeros(0, np.uint8)
    features = np.stack([
        np.ones(len(starts)), per_line(symbols) / size, upper / np.maximum(upper + lower, 1), per_line(_MARK[data]) / held,
        per_line(data == 0x7C) / held, per_line(_DIGIT[data]) / size, held < 4, _STOP[last], again, (upper + lower) / size,
    ], 1).astype(np.float64)

    shingle, at = W.shingles(words, words.hashes(fold=False), 3)
    owner = np.repeat(np.arange(n_texts), np.diff(at))
    _, where, often = np.unique(W.mix(shingle + W.mix(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
    many = np.flatnonzero(often[where] > 1)
    begin = words.first[owner[many]] + many - at[owner[many]]
    repeated = np.zeros(len(words) + 2, bool)
    for j in range(3):
        repeated[begin + j] = True
    total = np.concatenate([[0], np.cumsum(repeated[: len(words)])])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] += 1
    np.add.at(inside, words.ends, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    counts = {
        "n_words": words.per_text.astype(np.int64),
        "word_chars": per_text(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(symbols),
        "n_dup_lines": np.bincount(text[again], minlength=n_texts).astype(np.int64),
        "n_repeat_words": total[words.first[1:]] - total[words.first[:-1]],
    }
    return Lines(text, held, features, counts)


def _steps(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each chain, longest chain first."""
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(text)))
    order = np.argsort(-sizes, kind="stable")
    return starts[order], sizes[order]


def viterbi(text: np.ndarray, score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Labels of the most likely path of each chain; ``score`` is content's gain. Ties go to content."""
    starts, sizes = _steps(text)
    best = np.zeros((len(text), 2))
    back = np.zeros((len(text), 2), np.int8)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        at = starts[: np.searchsorted(-sizes, -t, "left")] + t
        best[at, 1] = score[at]
        if t:
            come = best[at - 1][:, :, None] + move[None]
            back[at] = come[:, 1] >= come[:, 0]
            best[at] += come.max(1)
    out = np.zeros(len(text), np.int8)
    if len(text):
        ends = starts + sizes - 1
        out[ends] = best[ends, 1] >= best[ends, 0]
        for t in range(1, int(sizes[0])):
            at = ends[: np.searchsorted(-sizes, -t, "left")] - t
            out[at] = back[at + 1, out[at + 1]]
    return out


def _marginals(text: np.ndarray, score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(content) of each line, and the expected moves."""
    starts, sizes = _steps(text)
    emit = np.stack([np.zeros_like(score), score], 1)
    ahead, behind = emit.copy(), np.zeros_like(emit)
    longest = int(sizes[0]) if len(sizes) else 0
    for t in range(1, longest):
        at = starts[: np.searchsorted(-sizes, -t, "left")] + t
        ahead[at] += np.logaddexp.reduce(ahead[at - 1][:, :, None] + move[None], 1)
    for t in range(longest - 2, -1, -1):
        at = starts[: np.searchsorted(-sizes, -(t + 1), "left")] + t
        behind[at] = np.logaddexp.reduce(move[None] + (emit[at + 1] + behind[at + 1])[:, None, :], 2)
    both = ahead + behind
    norm = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.flatnonzero(text[1:] == text[:-1])
    pair = ahead[inner][:, :, None] + move[None] + (emit[inner + 1] + behind[inner + 1])[:, None, :] - norm[inner][:, None, None]
    return np.exp(both[:, 1] - norm), np.exp(pair).sum(0)


def fit(text: np.ndarray, features: np.ndarray, label: np.ndarray, s: QualitySettings) -> LineModel:
    """Maximum likelihood with a small penalty, by gradient steps from the default weights."""
    start = LineModel()
    w, move = np.array(start.emit), np.array(start.move)
    if len(text) == 0 or label.min() == label.max():
        return start
    inner = np.flatnonzero(text[1:] == text[:-1])
    moves = np.zeros((2, 2))
    np.add.at(moves, (label[inner], label[inner + 1]), 1)
    n = len(text)
    sums = [np.zeros_like(w), np.zeros_like(move)]
    for _ in range(s.steps):
        p, expected = _marginals(text, features @ w, move)
        for i, (x, g) in enumerate(((w, features.T @ (label - p) / n - s.penalty * w), (move, (moves - expected) / n - s.penalty * move))):
            sums[i] += g * g
            x += s.rate * g / np.sqrt(sums[i] + 1e-9)
    return LineModel(tuple(w.tolist()), tuple(map(tuple, move.tolist())))


def train(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> LineModel:
    """Fit on at most ``train_docs`` labelled documents, the first by a hash of their id.

    The label of a document stands for its lines. Without labelled documents of
    both kinds the default weights are returned.
    """
    s = settings
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_docs rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_quality").alias("quality")).limit(s.train_docs)
    table = rows.toArrow().sort_by("doc_id")
    if table.num_rows == 0:
        return LineModel()
    lines = lines_of(table.column("text"))
    return fit(lines.text, lines.features, table.column("quality").to_numpy()[lines.text].astype(np.int64), s)


def _judged(table: Iterator[pa.RecordBatch], model: LineModel, s: QualitySettings) -> Iterator[pa.RecordBatch]:
    emit, move = np.array(model.emit), np.array(model.move)
    for batch in W.batches(table, text="_text"):
        lines = lines_of(batch.column("_text"))
        n = batch.num_rows
        content = viterbi(lines.text, lines.features @ emit, move)
        words = lines.counts["n_words"]
        share = np.bincount(lines.text, lines.n_words * content, n) / np.maximum(words, 1)
        failed = (words < s.min_words) | (100 * lines.counts["n_repeat_words"] > s.max_repeat_percent * words)
        others = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in others] + [pa.array(lines.counts[c]) for c in COUNTS]
            + [pa.array(failed), pa.array(share), pa.array(~failed & (share >= s.min_content))],
            [*others, *COUNTS, "base_failed", "content_share", "kept"],
        )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: LineModel, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """Columns of ``docs``, the counts, base_failed, content_share and kept; without a shuffle.

    A null, empty or blank text has no words: the rules fail and share is 0. A
    text of one endless line is one step. Rows that are repeated are judged
    alike; columns of ``docs`` named like a result are replaced.
    """
    made = {*COUNTS, "base_failed", "content_share", "kept"}
    kept = docs.select(*[c for c in docs.columns if c not in made], F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return kept.mapInArrow(partial(_judged, model=model, s=settings), f"{kinds}, {counts}, base_failed boolean, content_share double, kept boolean")
