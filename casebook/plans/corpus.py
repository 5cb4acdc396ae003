"""The text corpus: linked reports with labels, text and leak-free splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import components, corpus, links, prepare, splits, taxonomy
from ..session import written_table
from ..sources import names, sinks
from ..sources.catalog import load_folder


@dataclass
class Corpus:
    report_level: DataFrame
    incident_level: DataFrame
    classification_ready: DataFrame | None
    label_columns: list[str]
    split_map: DataFrame


def build_corpus(
    incidents: DataFrame,
    reports: DataFrame,
    taxonomies: dict[str, DataFrame],
    fractions: tuple[float, float, float] = (0.8, 0.0, 0.2),
    seed: int = 42,
    min_chars: int = 40,
    has_links: bool = True,
    check: bool = True,
) -> Corpus:
    """Corpus tables from canonical incidents and reports and raw taxonomies.

    The cleaned report table is written once, because the rollup, the
    components and both outputs read it.
    """
    rows = links.report_level(reports, incidents, has_links)
    incident_labels, report_labels, label_columns = taxonomy.classification_labels(taxonomies)
    if incident_labels is not None:
        rows = rows.join(incident_labels, "incident_id", "left")
    if report_labels is not None:
        rows = rows.join(report_labels, "report_id", "left")
    rows = written_table(corpus.clean_examples(corpus.add_text(rows, corpus.REPORT_FIELDS), min_chars))

    by_incident = corpus.incident_level(incidents, rows, incident_labels)
    # Incidents without any report take part as nodes of their own.
    linked = rows.select("incident_id", "report_id")
    alone = by_incident.select("incident_id").join(linked.select("incident_id").distinct(), "incident_id", "left_anti")
    groups = components.connected_components(linked)
    groups = groups.unionByName(alone.select("incident_id", alone["incident_id"].alias("component")))
    split_map = written_table(splits.group_split(groups, fractions, seed))

    rows = splits.apply_split(rows, split_map)
    ready = corpus.clean_examples(rows, min_chars, label_columns) if label_columns else None
    if check:
        splits.verify_no_leaks(rows, "report_level")
        if ready is not None:
            ready = written_table(ready)  # read once for each key, and by the caller
            splits.verify_no_leaks(ready, "classification_ready")
    return Corpus(rows, splits.apply_split(by_incident, split_map), ready, label_columns, split_map)


def corpus_from_folder(
    spark: SparkSession, folder: str, output: str | None = None, split: str = "80/20", seed: int = 42
) -> Corpus:
    """Read a folder of CSV files, build the corpus, and write it when asked."""
    catalog = load_folder(spark, folder)
    for stem in ("incidents", "reports"):
        if catalog.get(stem) is None:
            raise ValueError(f"`{stem}.csv` is required but was not found in the data folder.")
    raw = catalog.tables["incidents"]
    built = build_corpus(
        prepare.corpus_incidents(raw),
        prepare.corpus_reports(catalog.tables["reports"]),
        catalog.taxonomies(),
        splits.parse_split_spec(split),
        seed,
        has_links=names.find_column(raw.columns, names.REPORT_LINKS_WIDE) is not None,
    )
    if output:
        sinks.write_tables({"report_level": built.report_level, "incident_level": built.incident_level}, output)
        if built.classification_ready is not None:
            sinks.write_by_split(built.classification_ready, f"{output}/classification_ready")
    return built
