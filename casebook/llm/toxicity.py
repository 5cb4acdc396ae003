"""Toxicity from a weighted lexicon.

Texts are folded first: lower case, compatibility forms, look-alike letters of
other scripts, and digits or signs that stand for letters. The lexicon holds
whole words and word beginnings, learned from labelled documents by log odds,
and exception phrases in which such a word is harmless. One Aho-Corasick pass
finds them; weights are summed, normalised by length, and turned into a
probability by a logistic fit.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from . import words as W

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOK_ALIKES = dict(zip("абвгдезиклмнорстухыіјѕԁһԛԝѵαβεηικνορτυχωı", "a6brde3nkmmhopctyxbijsdhqwvabenikvoptuxwi"))
SIGNS = dict(zip("013457@$€", "oieastase"))


class _Fold(dict):
    """Character map that is filled on demand."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(SIGNS.get(x) or LOOK_ALIKES.get(x) or (x if x.isalnum() or unicodedata.combining(x) else " ") for x in c)
        self[code] = c
        return c


_FOLD = _Fold()


def folded(text: str) -> str:
    """Folded words between single spaces, with a space at each end."""
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass(frozen=True)
class ToxicSettings:
    """``sample`` bounds the labelled documents, ``candidates`` the terms and ``size`` the lexicon that are learned from."""

    sample: int = 40_000
    candidates: int = 20_000
    size: int = 2_000
    shortest: int = 4
    longest: int = 7
    least: int = 5
    odds: float = 2.0
    exceptions: int = 500
    steps: int = 30


@dataclass(frozen=True)
class Lexicon:
    """``weights`` of patterns (" word " or " beginning"), harmless ``exceptions`` (" two words "), and the logistic fit."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    logistic: tuple[float, float, float] = (-3.0, 1.0, 1.0)


def _terms(text: str, s: ToxicSettings) -> set[str]:
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(s.shortest, min(s.longest, len(w) - 1) + 1))
    return out


def _term_counts(table: Iterator[pa.RecordBatch], known: frozenset | None, s: ToxicSettings) -> Iterator[pa.RecordBatch]:
    """(term, n) over documents, for all terms or the known ones."""
    for batch in table:
        found: Counter = Counter()
        for text in batch.column("text").to_pylist():
            terms = _terms(text or "", s)
            found.update(terms if known is None else terms & known)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])


def automaton(lexicon: Lexicon):
    """Aho-Corasick automaton over patterns and exceptions: (weight, length); exceptions have weight None."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in lexicon.weights:
        out.add_word(term, (weight, len(term)))
    for phrase in lexicon.exceptions:
        out.add_word(phrase, (None, len(phrase)))
    out.make_automaton()
    return out


def hits(text: str, machine) -> list[tuple[int, int, float]]:
    """(start, end, weight) in a folded text; the heaviest pattern of each word counts, unless an exception covers it."""
    words: dict[int, tuple[int, float]] = {}
    covered = []
    if len(machine):
        for end, (weight, size) in machine.iter(text):
            start = end - size + 1
            if weight is None:
                covered.append((start, end))
            elif start not in words or weight > words[start][1]:
                words[start] = (end, weight)
    return [(a, b, w) for a, (b, w) in words.items() if not any(x <= a and b <= y for x, y in covered)]


def _features(table: Iterator[pa.RecordBatch], lexicon: Lexicon, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``columns``, and weight and words of the folded text."""
    machine = automaton(lexicon)
    for batch in W.batches(table, text="_text"):
        weight, size = [], []
        for text in batch.column("_text").to_pylist():
            plain = folded(text or "")
            weight.append(sum(w for _, _, w in hits(plain, machine)))
            size.append(plain.count(" ") - 1 if plain.strip() else 0)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(weight, pa.float64()), pa.array(size, pa.int64())], [*columns, "_weight", "_folded"])


def _contexts(table: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(phrase, toxic, n): word pairs around hits, by documents."""
    machine = automaton(lexicon)
    for batch in table:
        found: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            plain = folded(text or "")
            phrases = set()
            for start, end, _ in hits(plain, machine):
                stop = plain.index(" ", start + 1)
                if start:
                    phrases.add(plain[plain.rindex(" ", 0, start) : stop + 1])
                if stop + 1 < len(plain):
                    phrases.add(plain[start : plain.index(" ", stop + 1) + 1])
            found.update((p, toxic) for p in phrases)
        phrase, toxic = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(found.values()), pa.int64())], ["phrase", "toxic", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[float, ...]:
    """Maximum likelihood by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return tuple(w.tolist())


def _design(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(np.maximum(weight, 0)), 10 * weight / (n + 50.0)], 1)


def train(docs: DataFrame, labels: DataFrame, settings: ToxicSettings = ToxicSettings()) -> Lexicon:
    """Lexicon and fit from at most ``sample`` labelled documents, the first by a hash of their id.

    ``labels`` has doc_id and toxic; null labels are left out. Without both
    labels an empty lexicon with a low constant score is returned.
    """
    s = settings
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    rows = written_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most ``sample`` rows
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()

    def counts(df: DataFrame, known: frozenset | None) -> DataFrame:
        return df.select("text").mapInArrow(partial(_term_counts, known=known, s=s), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    ones = counts(rows.filter("toxic = 1"), None).filter(F.col("n") >= s.least).orderBy(F.col("n").desc(), "term").limit(s.candidates).toArrow().to_pylist()
    known = frozenset(r["term"] for r in ones)
    zeros = {r["term"]: r["n"] for r in counts(rows.filter("toxic = 0"), known).toArrow().to_pylist()}
    odds = {r["term"]: float(np.log((r["n"] + 0.5) / (toxic + 1)) - np.log((zeros.get(r["term"], 0) + 0.5) / (clean + 1))) for r in ones}
    often = {r["term"]: r["n"] for r in ones}
    strong = sorted((t for t, w in odds.items() if w >= s.odds), key=lambda t: (-often[t] * odds[t], t))
    kept: dict[str, float] = {}
    for term in strong:
        shorter = (term.rstrip(" ")[:k] for k in range(1 + s.shortest, len(term.rstrip(" ")) + 1))
        if len(kept) < s.size and not any(kept.get(p, 0) >= odds[term] for p in shorter if p != term):
            kept[term] = odds[term]
    lexicon = Lexicon(tuple(sorted(kept.items())))
    around = rows.select("text", "toxic").mapInArrow(partial(_contexts, lexicon=lexicon), "phrase string, toxic int, n bigint")
    around = around.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("n").alias("n"))
    safe = around.filter(f"clean >= {s.least} AND 10 * clean >= 9 * n").orderBy(F.col("clean").desc(), "phrase").limit(s.exceptions).collect()
    lexicon = Lexicon(lexicon.weights, tuple(r["phrase"] for r in safe))
    seen = rows.select("toxic", F.col("text").alias("_text")).mapInArrow(partial(_features, lexicon=lexicon, columns=["toxic"]), "toxic int, _weight double, _folded bigint").toArrow()
    x = _design(seen.column("_weight").to_numpy(), seen.column("_folded").to_numpy())
    return Lexicon(lexicon.weights, lexicon.exceptions, _logistic(x, seen.column("toxic").to_numpy().astype(float), s.steps))


def _scored(table: Iterator[pa.RecordBatch], lexicon: Lexicon, columns: list[str]) -> Iterator[pa.RecordBatch]:
    fit = np.array(lexicon.logistic)
    for batch in _features(table, lexicon, columns):
        x = _design(batch.column("_weight").to_numpy(), batch.column("_folded").to_numpy().astype(float))
        score = 1 / (1 + np.exp(-np.clip(x @ fit, -500, 500)))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Columns of ``docs`` but text, with score (0 to 1) and predicted; without a shuffle.

    Only the text decides. A null or empty text gets the score of a text
    without hits. Columns named score or predicted are replaced.
    """
    columns = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(
        partial(_scored, lexicon=lexicon, columns=columns), f"{kinds}, score double, predicted int"
    )
