"""Tables behind the dashboard views, from a folder of CSV files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import corpus, filters, links, prepare, taxonomy
from ..sources.catalog import Catalog, load_folder


@dataclass
class PreparedData:
    catalog: Catalog
    incidents: DataFrame
    reports: DataFrame
    incident_reports: DataFrame
    risk_long: DataFrame
    locations: DataFrame | None
    notes: list[str] = field(default_factory=list)

    def context(self) -> filters.Context:
        return filters.Context(self.incidents, self.incident_reports, self.risk_long, self.locations)

    def metadata(self) -> DataFrame:
        return corpus.catalog_metadata(self.incidents, self.risk_long, self.reports)


def prepare_data(spark: SparkSession, folder: str) -> PreparedData:
    """Load and link a folder. Missing tables become empty ones with a note."""
    catalog = load_folder(spark, folder)
    notes: list[str] = []

    def table(stem: str) -> DataFrame:
        df = catalog.get(stem)
        if df is None:
            notes.append(f"`{stem}.csv` was not found; views that need it stay empty.")
            df = spark.createDataFrame([], "incident_id string, report_number string")
        return df

    incidents = prepare.incidents(table("incidents"), notes)
    reports = prepare.reports(table("reports"), notes)
    risks = taxonomy.risk_long(catalog.taxonomies(), notes)
    if risks is None:
        notes.append("No classification labels were found; category views stay empty.")
        risks = spark.createDataFrame([], taxonomy.LONG_COLUMNS)
    return PreparedData(
        catalog=catalog,
        incidents=incidents,
        reports=reports,
        incident_reports=links.incident_reports(incidents, reports, notes),
        risk_long=risks,
        locations=taxonomy.locations(catalog.taxonomies(), notes),
        notes=notes,
    )
