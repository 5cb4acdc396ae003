"""Numeric arrays: norms, softmax and ranking inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import _col


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(c: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(c), lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(c: Column | str) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    return let(
        F.coalesce(F.nullif(norm(c), F.lit(0.0)), F.lit(1.0)),
        lambda length: F.transform(_col(c), lambda x: x.cast("double") / length),
    )


def euclidean(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_sum(F.transform(gaps, lambda g: g * g)))


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of scores, shifted by the maximum for safety."""
    powers = let(
        F.array_max(_col(logits)).cast("double"),
        lambda top: F.transform(_col(logits), lambda x: F.exp(x.cast("double") - top)),
    )
    return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda x: x / total)))


def top_scores(scores: Column | str, k: int, labels: list[str] | None = None) -> Column:
    """The k best entries as array<struct<label, score>>, best first.

    Labels default to the position. Equal scores keep the order of position.
    """
    names = F.array(*[F.lit(v) for v in labels]) if labels else None

    def entry(x: Column, i: Column) -> Column:
        return F.struct((-x.cast("double")).alias("neg"), i.alias("pos"))

    def named(e: Column) -> Column:
        label = F.get(names, e["pos"]) if names is not None else e["pos"]
        return F.struct(label.alias("label"), (-e["neg"]).alias("score"))

    ranked = F.slice(F.sort_array(F.transform(_col(scores), entry)), 1, k)
    return F.transform(ranked, named)


def scores_text(ranked: Column | str) -> Column:
    """``label: 0.1234 | label: 0.0987`` of a ranked score array."""
    return F.array_join(
        F.transform(
            _col(ranked),
            lambda e: F.concat(e["label"].cast("string"), F.lit(": "), F.format_string("%.4f", e["score"])),
        ),
        " | ",
    )
