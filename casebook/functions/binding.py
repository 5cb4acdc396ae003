"""Evaluating a sub-expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An expression repeated inside a lambda would run once per array element.
    A one-element array binds it to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
