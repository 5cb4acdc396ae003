"""Filters that keep several linked tables consistent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..session import few, written_table


@dataclass(frozen=True)
class Context:
    """The four linked tables of a view."""

    incidents: DataFrame
    incident_reports: DataFrame
    risk_long: DataFrame
    locations: DataFrame | None = None


def year_between(column: str, low: int, high: int) -> Column:
    """Inclusive range; an unknown year is outside."""
    return F.coalesce(F.col(column), F.lit(-1)).between(low, high)


def has_keyword(column: Column | str, keyword: str) -> Column:
    """Literal text search, whatever the case."""
    value = F.lower(F.coalesce(text._col(column), F.lit("")))
    return F.contains(value, F.lit(keyword.strip().lower()))


def restrict(df: DataFrame, keys: DataFrame, on: str = "incident_id", unique: bool = False) -> DataFrame:
    """Rows whose key is present in ``keys``.

    Keys that repeat are reduced on the map side first, so that a key holding
    a large share of the rows is shuffled once per task.
    """
    ids = keys.select(on)
    return df.join(ids if unique else ids.distinct(), on, "left_semi")


def filter_context(
    ctx: Context,
    years: tuple[int, int] | None = None,
    risks: list[str] | None = None,
    domains: list[str] | None = None,
    keyword: str | None = None,
) -> Context:
    """Year, keyword, category and domain filters applied to all four tables.

    The cheap predicates come first and reach the scan. A category selects
    incidents, and all labels of those stay. A domain selects links, and the
    incidents that have one. Everything else follows by semi-join with the
    incident ids that are left, which are found once.
    """
    incidents, links = ctx.incidents, ctx.incident_reports
    if years:
        incidents = incidents.filter(year_between("incident_year", *years))
    if keyword and keyword.strip():
        incidents = incidents.filter(has_keyword("search_text", keyword))
    plain = incidents
    if risks:
        incidents = restrict(incidents, ctx.risk_long.filter(F.col("risk_category").isin(list(risks))))
    if domains:
        links = links.filter(F.col("source_domain").isin(list(domains)))
        incidents = restrict(incidents, links)
    ids = incidents.select("incident_id")
    if risks or domains:
        # a link of a chosen domain keeps its incident, so these are the incidents of the links as well
        ids = written_table(ids.distinct())
        incidents = restrict(plain, ids, unique=True)
    return Context(
        incidents=incidents,
        incident_reports=restrict(links, ids, unique=True),
        risk_long=restrict(ctx.risk_long, ids, unique=True),
        locations=None if ctx.locations is None else restrict(ctx.locations, ids, unique=True),
    )


def filter_cluster_records(
    records: DataFrame,
    years: tuple[int, int] | None = None,
    risks: list[str] | None = None,
    domains: list[str] | None = None,
    keyword: str | None = None,
    cluster: str | None = None,
    columns: dict[str, str | None] | None = None,
) -> DataFrame:
    """Record filter of the cluster views. A cluster that is no number is ignored."""
    columns = columns or {
        "year": "incident_year", "risk_category": "mit_risk_domain", "source_domain": "source_domain",
    }
    out = records

    def usable(name: str) -> str | None:
        column = columns.get(name)
        return column if column in records.columns else None

    if years and usable("year"):
        number = F.col(usable("year")).cast("string").try_cast("double")
        out = out.filter(number.between(*years))
    if risks and usable("risk_category"):
        out = out.filter(labels.contains_any(usable("risk_category"), risks))
    if domains and usable("source_domain"):
        out = out.filter(F.col(usable("source_domain")).isin(list(domains)))
    searched = [c for c in ("input_text", "incident_title", "report_title") if c in records.columns]
    if keyword and keyword.strip() and searched:
        joined = F.concat_ws(" ", *[text.safe_string(c) for c in searched])
        out = out.filter(has_keyword(joined, keyword))
    if cluster and cluster != "__all__" and cluster.lstrip("+-").isdigit():
        out = out.filter(F.col("cluster_label") == int(cluster))
    return out


def long_enough(text_column: str, min_chars: int, key: str | None = None) -> Column:
    """Minimum text length, and a non-empty key when one is given."""
    enough = F.length(text_column) >= min_chars
    return enough & (F.col(key).cast("string") != "") if key else enough


def min_support(df: DataFrame, label: str, rows: int = 3) -> DataFrame:
    """Rows whose label occurs often enough."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= rows)
    return df.join(few(counts.select(label), "frequent labels"), label, "left_semi")
