"""Label columns: cleaning, multi-value splitting and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import _col, normalize_text, parse_list

SEPARATOR = " | "

# Texts that mean "no label".
EMPTY_LABELS = ["nan", "none", "null", "n/a", "na", "[]"]

# Short forms of the seven numbered risk domains.
SHORT_FORMS = {
    "1. Discrimination and Toxicity": "D&T",
    "2. Privacy & Security": "Privacy",
    "3. Misinformation": "Misinfo",
    "4. Malicious Actors & Misuse": "Misuse",
    "5. Human-Computer Interaction": "HCI",
    "6. Socioeconomic & Environmental Harms": "Socio-env",
    "7. AI system safety, failures, and limitations": "Safety",
}

# Words in a risk, and the terms then looked for in a summary,
# in order of preference. The first row with a matching word applies.
PREFERRED_TERMS = [
    (["misinformation"], ["misinformation", "hallucination", "fabrication"]),
    (["misuse"], ["misuse", "unsafe", "security", "privacy", "exposure"]),
    (["discrimination", "toxicity"], ["bias", "toxicity", "discrimination"]),
    (["privacy", "security"], ["privacy", "security", "exposure"]),
    (["safety", "limitations"], ["failure", "bug", "capability", "generalization", "hardware", "latency"]),
]


def clean_label(c: Column | str) -> Column:
    """Cleaned text, with the usual spellings of "nothing" turned into ""."""
    return _no_empty(normalize_text(c))


def _no_empty(text: Column) -> Column:
    return F.when(F.lower(text).isin(EMPTY_LABELS), F.lit("")).otherwise(text)


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_labels(c: Column | str) -> Column:
    """Values of a `` | `` separated label, trimmed, blanks dropped."""
    return _parts(clean_label(c), r" \| ")


def split_commas(c: Column | str) -> Column:
    return _parts(_col(c), ",")


def problem_labels(c: Column | str) -> Column:
    """Values separated by a bar or a comma; "nan" and null give none."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    return _parts(F.when(F.lower(text) == "nan", F.lit("")).otherwise(text), r"[|,]")


def primary_label(c: Column | str) -> Column:
    return F.try_element_at(problem_labels(c), F.lit(1))


def target_label(c: Column | str, strategy: str = "as_label", separator: str = SEPARATOR) -> Column:
    """Training label under a multi-label policy; "" means the row is unusable.

    ``as_label`` keeps the combination, ``first`` its first part, ``drop`` none.
    """
    if strategy not in ("as_label", "first", "drop"):
        raise ValueError("strategy must be one of: as_label, first, drop")
    text = normalize_text(c)
    blank = [v for v in EMPTY_LABELS if v != "[]"]
    label = F.when(F.lower(text).isin(blank), F.lit("")).otherwise(text)
    if strategy == "as_label":
        return label
    # normalize_text leaves single spaces, so a separator keeps its spelling.
    many = label.contains(separator)
    kept = F.trim(F.substring_index(label, separator, 1)) if strategy == "first" else F.lit("")
    return F.when(many, kept).otherwise(label)


def summary_label(c: Column | str, risk: Column | str) -> Column:
    """One label out of ``a (3) | b (2)``, preferring terms that fit the risk.

    The trailing count is removed. Terms are tried in order, and for each the
    segments in order; without a match the first segment is used.
    """
    risk_text = F.lower(F.coalesce(_col(risk), F.lit("")))
    terms = F.array().cast("array<string>")
    for words, wanted in reversed(PREFERRED_TERMS):
        hit = F.lit(False)
        for word in words:
            hit = hit | risk_text.contains(word)
        terms = F.when(hit, F.array(*[F.lit(t) for t in wanted])).otherwise(terms)

    def choose(segments: Column) -> Column:
        matches = F.flatten(
            F.transform(terms, lambda t: F.filter(segments, lambda s: F.lower(s).contains(t)))
        )
        return F.coalesce(F.get(matches, F.lit(0)), F.get(segments, F.lit(0)))

    chosen = let(_parts(F.coalesce(_col(c), F.lit("")), r"\|"), choose)
    return F.nullif(F.trim(F.regexp_replace(chosen, r"\s*\(\d+\)\s*$", "")), F.lit(""))


def short_label(c: Column | str, max_len: int = 22) -> Column:
    """Known short form, else the text cut to ``max_len`` with an ellipsis."""
    text = _col(c).cast("string")
    known = F.lit(None).cast("string")
    for full, short in SHORT_FORMS.items():
        known = F.when(text == full, F.lit(short)).otherwise(known)
    cut = F.concat(F.rtrim(F.substring(text, 1, max_len - 1)), F.lit("…"))
    return F.coalesce(known, F.when(F.length(text) <= max_len, text).otherwise(cut))


def contains_any(c: Column | str, values: list[str]) -> Column:
    """True when the text, or one of its `` | `` values, is in ``values``."""
    if not values:
        return F.lit(True)
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    wanted = F.array(*[F.lit(v) for v in values])
    return F.arrays_overlap(F.split(text, r" \| "), wanted) | text.isin(list(values))


def label_items(c: Column | str) -> Column:
    """Clean values of one cell: a bracketed list is expanded, else one value.

    A cell is cleaned once; one value is clean by then.
    """

    def items(t: Column) -> Column:
        listed = F.filter(F.transform(parse_list(t), clean_label), lambda x: x != "")
        return F.when(t.rlike(r"^\[.*\]$"), listed).otherwise(F.filter(F.array(t), lambda x: x != ""))

    return let(normalize_text(c), lambda text: let(_no_empty(text), items))


def join_sorted(values: Column) -> Column:
    """Distinct values in case-insensitive order, `` | `` separated."""
    pairs = F.transform(F.array_distinct(values), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p["v"]), SEPARATOR)


def collapse(c: Column | str) -> Column:
    """Aggregate: all distinct clean values of a group, joined in order.

    Raw cells are de-duplicated on the map side and parsed after the shuffle,
    so each distinct cell is parsed once per group.
    """
    cells = F.collect_set(_col(c).cast("string"))
    return join_sorted(F.flatten(F.transform(cells, label_items)))
