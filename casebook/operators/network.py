"""Incident, category and source as an edge table and as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def network_table(attention_table: DataFrame, risks: DataFrame, links: DataFrame) -> DataFrame:
    """One row per (incident, category, source) with report counts."""
    domains = links.groupBy("incident_id", "source_domain").agg(F.countDistinct("report_id").alias("domain_reports"))
    categories = risks.select("incident_id", "risk_category").distinct()
    return (
        attention_table.select("incident_id", "incident_title", "report_count")
        .join(categories, "incident_id")
        .join(domains, "incident_id", "left")
    )


def top_network_incidents(network: DataFrame, n: int) -> DataFrame:
    return (
        network.groupBy("incident_id", "incident_title")
        .agg(F.max("report_count").alias("report_count"))
        .orderBy(F.desc("report_count"), "incident_id")
        .limit(n)
    )


def top_nodes(attention_table: DataFrame, risks: DataFrame, n: int) -> DataFrame:
    """The n most reported incidents that have a category."""
    labelled = attention_table.join(risks.select("incident_id").distinct(), "incident_id", "left_semi")
    return labelled.orderBy(F.desc("report_count"), "incident_id").limit(n).select("incident_id", "incident_title")


def graph_rows(top: DataFrame, risks: DataFrame, links: DataFrame) -> DataFrame:
    """(incident_id, kind, value): the distinct ends of the top incidents' edges.

    Categories and sources are taken side by side, not as the pairs that the
    network table holds. Blank ends are left out.
    """
    ends = [
        df.filter(F.col(c) != "").join(top.select("incident_id"), "incident_id", "left_semi").select(
            "incident_id", F.lit(kind).alias("kind"), F.col(c).alias("value")
        )
        for df, c, kind in ((risks, "risk_category", "risk"), (links, "source_domain", "source"))
    ]
    return ends[0].unionByName(ends[1]).distinct()


def nodes(attention_table: DataFrame, risks: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Distinct incident, risk and source nodes around the n most reported incidents."""
    top = top_nodes(attention_table, risks, n)
    key = F.col("incident_id").cast("string")
    incidents = top.select(
        F.concat(F.lit("incident::"), key).alias("node"),
        F.coalesce(F.nullif(F.substring("incident_title", 1, 80), F.lit("")), key).alias("label"),
        F.lit("Incident").alias("node_type"),
    )
    label = F.when(F.col("kind") == "risk", labels.short_label("value", 28)).otherwise(F.col("value"))
    ends = graph_rows(top, risks, links).select("kind", "value").distinct().select(
        F.concat("kind", F.lit("::"), "value").alias("node"), label.alias("label"), F.initcap("kind").alias("node_type")
    )
    return incidents.unionByName(ends)


def edges(attention_table: DataFrame, risks: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Distinct incident-risk and incident-source edges of the n most reported incidents."""
    ends = graph_rows(top_nodes(attention_table, risks, n), risks, links)
    return ends.select(
        F.concat(F.lit("incident::"), F.col("incident_id").cast("string")).alias("src"),
        F.concat("kind", F.lit("::"), "value").alias("dst"),
    )
