"""How much coverage incidents and sources get."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def kpi_summary(incidents: DataFrame, links: DataFrame, all_risks: DataFrame) -> DataFrame:
    """One row of headline numbers; categories come from the unfiltered labels."""
    i = incidents.agg(
        F.countDistinct("incident_id").alias("total_incidents"),
        F.min("incident_year").alias("year_min"),
        F.max("incident_year").alias("year_max"),
    )
    r = links.agg(F.countDistinct("report_id")).scalar()
    c = all_risks.filter("risk_category <> ''").agg(F.countDistinct("risk_category")).scalar()
    span = F.coalesce(F.concat("year_min", F.lit(" - "), "year_max"), F.lit("N/A"))
    return i.select(
        "total_incidents", r.alias("total_reports"), span.alias("year_range"), c.alias("risk_categories")
    )


def attention(incidents: DataFrame, links: DataFrame | None) -> DataFrame:
    """Distinct reports per incident, 0 without any; list lengths if there are no links."""
    columns = [c for c in ("incident_id", "incident_title", "incident_year", "incident_description") if c in incidents.columns]
    if links is None:
        return incidents.select(*columns, "report_count")
    counts = links.groupBy("incident_id").agg(F.countDistinct("report_id").alias("report_count"))
    return incidents.select(*columns).join(counts, "incident_id", "left").na.fill(0, ["report_count"])


def top_incidents(attention_table: DataFrame, n: int) -> DataFrame:
    return attention_table.orderBy(F.desc("report_count"), "incident_id").limit(n)


def evidence_table(attention_table: DataFrame, n: int = 50) -> DataFrame:
    """Newest incidents first, then by title; unknown years last."""
    return attention_table.orderBy(
        F.desc_nulls_last("incident_year"), F.asc_nulls_last("incident_title"), "incident_id"
    ).limit(n)


def top_domains(links: DataFrame, n: int) -> DataFrame:
    counts = links.filter(F.col("source_domain").isNotNull()).groupBy("source_domain").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.orderBy(F.desc("count"), "source_domain").limit(n)


def count_histogram(attention_table: DataFrame) -> DataFrame:
    """Incidents per report count."""
    return attention_table.groupBy("report_count").agg(F.count(F.lit(1)).alias("incidents"))


def lorenz_curve(attention_table: DataFrame) -> DataFrame:
    """Cumulative share of incidents and of reports, from (0, 0) to (1, 1).

    The running sums go over the distinct report counts instead of the
    incidents. With R reports there are fewer than sqrt(2R) + 1 of those. Equal
    counts lie on one line, so the curve is the same.
    """
    running = Window.orderBy("report_count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("report_count").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reports = F.col("report_count") * F.col("incidents")
    points = count_histogram(attention_table).select(
        (F.sum("incidents").over(running) / F.sum("incidents").over(whole)).alias("incident_share"),
        F.sum(reports).over(running).alias("_part"),
        F.sum(reports).over(whole).alias("_all"),
    ).filter("_all > 0").select("incident_share", (F.col("_part") / F.col("_all")).alias("report_share"))
    start = points.limit(1).select(F.lit(0.0).alias("incident_share"), F.lit(0.0).alias("report_share"))
    return points.unionByName(start)


def attention_histogram(attention_table: DataFrame) -> DataFrame:
    """Incidents in equal-width bins, between 5 and 25 of them."""
    counts = count_histogram(attention_table)
    bounds = counts.agg(
        F.struct(
            F.min("report_count").cast("double").alias("lo"),
            F.max("report_count").cast("double").alias("hi"),
            F.least(F.lit(25), F.greatest(F.lit(5), F.count(F.lit(1)))).cast("int").alias("bins"),
        )
    ).scalar()
    placed = counts.withColumn("b", bounds).select(
        "report_count", "incidents", F.col("b.lo").alias("lo"), F.col("b.bins").alias("bins"),
        (F.greatest(F.col("b.hi") - F.col("b.lo"), F.lit(1.0)) / F.col("b.bins")).alias("width"),
    )
    position = F.floor((F.col("report_count") - F.col("lo")) / F.col("width")).cast("int") + 1
    binned = placed.withColumn("bin", F.least(position, F.col("bins")))
    return binned.groupBy("bin").agg(
        F.min(F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
        F.sum("incidents").alias("incidents"),
    )


def most_reported(attention_table: DataFrame) -> DataFrame:
    return top_incidents(attention_table, 1).select("incident_id")


def incident_detail(
    attention_table: DataFrame, risks: DataFrame, links: DataFrame, incident_id=None, limit: int = 5
) -> DataFrame:
    """One incident with up to five labels and five distinct sources.

    Without an id, or with an unknown one, the most reported incident is shown.
    """
    chosen = None
    if incident_id is not None:
        named = attention_table.filter(F.col("incident_id") == F.lit(incident_id)).select("incident_id")
        chosen = named if not named.isEmpty() else None
    chosen = chosen if chosen is not None else most_reported(attention_table)
    # At most one row each, so joining on the id stays small.
    row = attention_table.join(F.broadcast(chosen), "incident_id")
    labels = (
        risks.join(F.broadcast(chosen), "incident_id").filter(F.col("risk_category").isNotNull())
        .select("incident_id", "risk_category").distinct()
        .orderBy("risk_category").limit(limit)
        .groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_list("risk_category")), ", ").alias("risk_categories"))
    )
    shown = F.coalesce(F.nullif(text.safe_string("report_title"), F.lit("")), text.safe_string("source_domain"))
    sources = (
        links.join(F.broadcast(chosen), "incident_id")
        .select("incident_id", "report_title", "report_url", "source_domain").distinct()
        .orderBy("report_title", "report_url", "source_domain").limit(limit)
        .groupBy("incident_id")
        .agg(F.array_join(F.array_sort(F.collect_list(
            F.concat(shown, F.lit(" <"), text.safe_string("report_url"), F.lit(">"))
        )), "; ").alias("source_examples"))
    )
    return row.join(labels, "incident_id", "left").join(sources, "incident_id", "left")
