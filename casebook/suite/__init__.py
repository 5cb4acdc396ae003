"""Registered queries over the shared test tables, each with an SQL equivalent where one exists."""

from .registry import QUERIES, SQL
from . import corpora, fitted, folders, graphs, learned, linked, scalars, streams, texts, views  # noqa: F401  (fills the registry)

__all__ = ["QUERIES", "SQL"]
