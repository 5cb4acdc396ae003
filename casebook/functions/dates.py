"""Timestamps and years with per-row fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

FIRST_YEAR = 1900
LAST_YEAR = 2100
# Formats tried after the ISO forms that Spark recognises itself.
FORMATS = ("M/d/yyyy", "d.M.yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def parse_timestamp(c: Column | str, formats: tuple[str, ...] = FORMATS) -> Column:
    """UTC timestamp of a date text; text in no known form gives null.

    A bare number is not a date here, so that a year column stays numeric.
    """
    text = F.trim(_col(c).cast("string"))
    dated = F.when(~text.rlike(r"^[+-]?[0-9]+([.][0-9]*)?$"), text)
    return F.coalesce(
        F.try_to_timestamp(dated), *[F.try_to_timestamp(dated, F.lit(f)) for f in formats]
    )


def valid_year(c: Column | str) -> Column:
    """Numeric year between 1900 and 2100, else null."""
    number = F.trim(_col(c).cast("string")).try_cast("double")
    return F.when(number.between(FIRST_YEAR, LAST_YEAR), number).cast("int")


def extract_year(c: Column | str) -> Column:
    """Year of the date, or the numeric year itself, decided row by row."""
    return F.coalesce(F.year(parse_timestamp(c)), valid_year(c))
