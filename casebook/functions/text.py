"""String columns: cleaning, list parsing, URLs and assembled text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

UNKNOWN_DOMAIN = "Unknown"
WORD = r"[\p{L}\p{N}_]{2,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Null to "", NUL and whitespace runs to one space, trimmed."""
    spaced = F.regexp_replace(_col(c).cast("string"), r"(?U)[\s\x00\x1c-\x1f]+", " ")
    return F.trim(F.coalesce(spaced, F.lit("")))


def normalize_text_list(c: Column | str) -> Column:
    """Elements joined by a space, then cleaned as text; null elements are dropped."""
    return normalize_text(F.array_join(_col(c), " "))


def safe_string(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def snake_name(c: Column | str) -> Column:
    """Trimmed lower-case snake_case form of a name held in a column."""
    joined = F.regexp_replace(F.lower(normalize_text(c)), r"[^\p{L}\p{N}]+", "_")
    return F.trim(joined, F.lit("_"))


def slug(c: Column | str, default: str = "target") -> Column:
    """ASCII slug, or ``default`` when nothing is left."""
    joined = F.trim(F.regexp_replace(normalize_text(c), "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.lower(joined), F.lit("")), F.lit(default))


def _strip_quotes(c: Column) -> Column:
    return F.trim(F.trim(F.trim(c), F.lit('"')), F.lit("'"))


def _drop_blank(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def _quoted_list(t: Column) -> Column:
    """Elements of a list, tuple or set literal with quotes in it, else null."""
    quoted = t.rlike(r"^[\[({].*['\"].*[\])}]$")
    return F.when(quoted, F.from_json(F.regexp_replace(t, r"^[\[({](.*?),?\s*[\])}]$", r"[$1]"), "array<string>"))


def _bare_list(t: Column) -> Column:
    """Elements between commas; numbers may stand in any kind of bracket."""
    numbers = t.rlike(r"^[({][\s0-9.,+\-]*[)}]$")
    inner = F.when(numbers, F.trim(t, F.lit("(){}"))).otherwise(F.trim(t, F.lit("[]")))
    return F.transform(F.split(inner, ","), _strip_quotes)


def parse_list(c: Column | str) -> Column:
    """Text holding a list literal or a comma list, to array<string>.

    Null and blank give an empty array. Only quoted literals need the JSON
    reader, because plain elements look the same without it.
    """

    def parse(t: Column) -> Column:
        quoted = F.transform(_quoted_list(t), normalize_text)
        return _drop_blank(F.coalesce(quoted, _bare_list(t)))

    return let(normalize_text(c), parse)


def parse_list_strict(c: Column | str) -> Column:
    """List literal to array<string>; anything else gives an empty array."""

    def parse(t: Column) -> Column:
        quoted = F.transform(_quoted_list(t), lambda x: F.trim(x))
        plain = F.when(t.rlike(r"^\[[^'\"]*\]$"), _bare_list(t))
        return F.when(t.rlike(r"^\[.*\]$"), _drop_blank(F.coalesce(quoted, plain)))

    return F.coalesce(let(normalize_text(c), parse), F.array().cast("array<string>"))


def url_host(c: Column | str) -> Column:
    """Lower-case host with port as written; null when there is none."""
    text = F.trim(_col(c).cast("string"))
    host = F.regexp_extract(F.lower(text), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.nullif(host, F.lit(""))


def url_domain(c: Column | str) -> Column:
    """Host without a leading ``www.``; a missing scheme is assumed; "" when none."""
    text = normalize_text(c)
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.coalesce(F.regexp_replace(url_host(full), r"^www\.", ""), F.lit(""))


def fill_domain(c: Column | str) -> Column:
    return F.coalesce(F.nullif(safe_string(c), F.lit("")), F.lit(UNKNOWN_DOMAIN))


def join_text(*columns: Column | str) -> Column:
    """Non-blank trimmed parts joined by one space."""
    return F.concat_ws(" ", *[F.nullif(F.trim(_col(c).cast("string")), F.lit("")) for c in columns])


def labelled_text(fields: list[tuple[str, Column | str]]) -> Column:
    """``Label: value`` for each non-empty field, in order.

    A value already used by an earlier field is skipped, whatever its case.
    """
    return labelled_values([(label, normalize_text(c)) for label, c in fields])


def labelled_values(fields: list[tuple[str, Column]]) -> Column:
    """``labelled_text`` of values that are clean already; each is used several times."""
    values = [v for _, v in fields]
    keys = [F.lower(v) for v in values]
    parts = []
    for i, (label, _) in enumerate(fields):
        fresh = reduce(lambda a, b: a & b, [keys[i] != keys[j] for j in range(i)], values[i] != "")
        parts.append(F.when(fresh, F.concat(F.lit(f"{label}: "), values[i])))
    return F.concat_ws(" ", *parts)


def tokens(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two characters or more, stop words removed."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return words


def with_bigrams(words: Column) -> Column:
    """Words followed by the pairs of neighbouring words."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def preview(c: Column | str, length: int = 240) -> Column:
    return F.substring(safe_string(c), 1, length)
