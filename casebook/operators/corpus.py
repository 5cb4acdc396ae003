"""Text corpus tables: assembled text, cleaning, rollup and modelling rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from ..session import few
from .filters import long_enough
from .ordering import keep_first

# Labelled fields of the text, in order.
REPORT_FIELDS = [
    ("Report title", "report_title"),
    ("Incident title", "incident_title"),
    ("Incident description", "incident_description"),
    ("Report text", "report_text"),
    ("Source domain", "source_domain"),
    ("Source URL", "report_url"),
]
INCIDENT_FIELDS = [
    ("Incident title", "incident_title"),
    ("Incident description", "incident_description"),
    ("Report titles", "linked_report_titles"),
    ("Source domains", "source_domains"),
]


def add_text(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """``input_text`` of the labelled fields, each of which is cleaned once."""
    clean = {f"_clean_{i}": text.normalize_text(c) for i, (_, c) in enumerate(fields)}
    values = [(label, F.col(name)) for (label, _), name in zip(fields, clean)]
    return df.withColumns(clean).withColumn("input_text", text.labelled_values(values)).drop(*clean)


def clean_examples(
    df: DataFrame, min_chars: int = 40, label_columns: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """Rows with enough text and, when label columns are given, any label; duplicates removed."""
    out = df.withColumn("input_text", text.normalize_text("input_text")).filter(long_enough("input_text", min_chars))
    if label_columns is not None:
        if not label_columns:
            raise ValueError("No label columns were detected, so no classification rows can be made.")
        out = out.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in label_columns]))
    keys = [c for c in ("incident_id", "report_id", "input_text") if c in out.columns]
    return keep_first(out, keys, order or [c for c in out.columns if c not in keys] or keys)


def incident_rollup(report_level: DataFrame) -> DataFrame:
    """Distinct reports, sources and report titles per incident.

    The reports are a set as the titles are: a distinct count beside sets would
    aggregate every set by incident and report first.
    """
    return report_level.groupBy("incident_id").agg(
        F.size(F.collect_set("report_id")).cast("long").alias("joined_report_count"),
        labels.collapse("source_domain").alias("source_domains"),
        labels.collapse("report_title").alias("linked_report_titles"),
    )


def incident_level(incidents: DataFrame, report_level: DataFrame, incident_labels: DataFrame | None = None) -> DataFrame:
    """Incidents with their rollup, labels and text."""
    out = (
        incidents.drop("incident_report_ids")
        .join(incident_rollup(report_level), "incident_id", "left")
        .na.fill(0, ["joined_report_count"])
        .na.fill("", ["source_domains", "linked_report_titles"])
    )
    if incident_labels is not None:
        out = out.join(incident_labels, "incident_id", "left")
    return add_text(out, INCIDENT_FIELDS)


def modeling_frame(
    df: DataFrame, target: str, strategy: str = "as_label", min_chars: int = 40, order: list[str] | None = None
) -> DataFrame:
    """Cleaned training rows with ``target_label``, one per (incident, text, label)."""
    out = (
        df.withColumn("input_text", text.normalize_text("input_text"))
        .withColumn("incident_id", text.normalize_text("incident_id"))
        .withColumn("target_label", labels.target_label(target, strategy))
        .filter(long_enough("input_text", min_chars, "incident_id") & (F.col("target_label") != ""))
    )
    keys = ["incident_id", "input_text", "target_label"]
    return keep_first(out, keys, order or [c for c in out.columns if c not in keys] or keys)


def require_classes(df: DataFrame, column: str = "target_label", least: int = 2) -> DataFrame:
    if df.select(column).distinct().limit(least).count() < least:
        raise ValueError(f"Need at least {least} target classes after cleaning.")
    return df


def encode_labels(df: DataFrame, column: str = "target_label") -> tuple[DataFrame, DataFrame]:
    """Rows with a 0-based ``label`` in sorted order, and the (label, name) mapping.

    Classes are few, so ranking them needs one small window; the mapping joins
    back on the class name.
    """
    mapping = df.select(column).distinct().withColumn("label", F.row_number().over(Window.orderBy(column)) - 1)
    mapping = few(mapping, "classes")
    return df.join(mapping, column), mapping.select("label", column)


def cluster_input(
    df: DataFrame, text_column: str = "input_text", key: str = "incident_id", min_chars: int = 80,
    order: list[str] | None = None,
) -> DataFrame:
    """Cleaned rows for clustering: long enough, keyed, first of equal (key, text).

    The text is cleaned as the one element of an array, because the filter on
    its length would be moved below a plain projection and clean it again.
    """
    out = df.withColumn(text_column, F.explode(F.array(text.normalize_text(text_column)))).withColumn(key, text.normalize_text(key))
    out = out.filter(long_enough(text_column, min_chars, key))
    return keep_first(out, [key, text_column], order or [c for c in out.columns if c not in (key, text_column)] or [key])


def label_values(df: DataFrame, column: str) -> DataFrame:
    """One row per value of a multi-value label column."""
    return df.withColumn("value", F.explode(labels.split_labels(column)))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column."""
    counted = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "missing")


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, incidents and reports per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("incident_id").alias("n_incidents"),
        F.countDistinct("report_id").alias("n_reports"),
    )


def catalog_metadata(incidents: DataFrame, risks: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, value) rows: the years' bounds, the sizes, every category and every source."""
    facts = incidents.agg(
        F.min("incident_year").alias("incident_year_min"), F.max("incident_year").alias("incident_year_max"), F.count(F.lit(1)).alias("n_incidents")
    )
    n_risks, n_reports = (t.agg(F.count(F.lit(1)).cast("string")).scalar() for t in (risks, reports))
    facts = facts.select(*[F.col(c).cast("string").alias(c) for c in facts.columns], n_risks.alias("n_risks"), n_reports.alias("n_reports"))
    bounds = facts.unpivot([], facts.columns, "kind", "value")
    categories = risks.filter("risk_category <> ''").select(F.lit("risk_category").alias("kind"), F.col("risk_category").alias("value")).distinct()
    sources = reports.filter("source_domain IS NOT NULL").select(F.lit("source_domain").alias("kind"), F.col("source_domain").alias("value")).distinct()
    return bounds.unionByName(categories).unionByName(sources)
