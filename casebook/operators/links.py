"""Joining incidents to the reports that document them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

REPORT_COLUMNS = ["report_title", "report_text", "report_url", "source_domain", "report_year"]
INCIDENT_COLUMNS = [
    "incident_title", "incident_description", "incident_date", "incident_year",
    "ai_deployer", "ai_developer", "harmed_parties",
]


def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def exploded_links(incidents: DataFrame, list_column: str, extra: list[str] | None = None) -> DataFrame:
    """One row per (incident, listed report); blank report ids are dropped."""
    return incidents.select(
        "incident_id", *(extra or []), F.explode(list_column).alias("report_id")
    ).withColumn("report_id", F.trim("report_id")).filter("report_id <> ''")


def incident_reports(incidents: DataFrame, reports: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """Links from the incidents' lists, left-joined to the reports.

    A link whose report is unknown stays, without a domain. Without any link
    the reports' own incident ids are used, if they have them.
    """
    links = exploded_links(
        incidents, "report_ids", ["incident_title", "incident_description", "incident_year"]
    )
    if links.isEmpty():
        if "incident_id" in reports.columns:
            return reports.withColumn("incident_id", F.col("incident_id").cast("string"))
        if notes is not None:
            notes.append("No usable incident-to-report links were created.")
    return links.join(reports.select("report_id", *REPORT_COLUMNS), "report_id", "left")


def report_level_direct(reports: DataFrame, incidents: DataFrame) -> DataFrame:
    """Reports that name their incident, with the incident's columns."""
    named = reports.withColumnRenamed("direct_incident_id", "incident_id")
    return named.join(
        incidents.select("incident_id", *_present(incidents, INCIDENT_COLUMNS)), "incident_id"
    )


def report_level_links(reports: DataFrame, incidents: DataFrame) -> DataFrame:
    """Reports found through the incidents' lists, with the incident's columns."""
    links = exploded_links(incidents, "incident_report_ids")
    links = links.withColumn("report_id", text.normalize_text("report_id"))
    joined = reports.drop("direct_incident_id").join(links, "report_id")
    return joined.join(
        incidents.select("incident_id", *_present(incidents, INCIDENT_COLUMNS)), "incident_id", "left"
    )


def report_level(reports: DataFrame, incidents: DataFrame, has_links: bool = True) -> DataFrame:
    """Direct ids when at least one matches, else the listed links."""
    direct = reports.filter("direct_incident_id <> ''").join(
        incidents.select(F.col("incident_id").alias("direct_incident_id")), "direct_incident_id", "left_semi"
    )
    if not direct.isEmpty():
        return report_level_direct(reports, incidents)
    if not has_links:
        raise ValueError(
            "Could not join reports to incidents: the reports have no usable incident ID and the "
            "incidents have no report-link column."
        )
    joined = report_level_links(reports, incidents)
    if exploded_links(incidents, "incident_report_ids").isEmpty():
        raise ValueError("No usable report IDs were parsed from the incidents' report-link column.")
    return joined
