"""Yearly trends and the category mix over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def per_year(df: DataFrame, year: str) -> DataFrame:
    """Rows per year; rows without a year are not counted."""
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(F.col(year).alias("year"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def overview_by_year(incidents: DataFrame, links: DataFrame) -> DataFrame:
    """Incidents and report links per year, side by side."""
    left = per_year(incidents, "incident_year").withColumnRenamed("count", "incidents")
    right = per_year(links, "report_year").withColumnRenamed("count", "reports")
    return left.join(right, "year", "full_outer")


def rolling_average(year_counts: DataFrame, years: int = 3) -> DataFrame:
    """Trailing mean over the years that exist.

    The window has no partition key, but its input is one row per year.
    """
    trailing = Window.orderBy("year").rowsBetween(-(years - 1), Window.currentRow)
    return year_counts.withColumn("rolling", F.avg("count").over(trailing))


def risk_counts(incidents: DataFrame, links: DataFrame, risks: DataFrame, metric: str = "incidents") -> DataFrame:
    """(year, risk_category, count) by incident year, or by report year of the links.

    Links are counted per incident and year before they meet the labels, so
    an incident with very many links joins as a few rows. A link counts once
    for every label of its incident.
    """
    labels = risks.filter(F.col("risk_category").isNotNull()).select("incident_id", "risk_category")
    if metric == "reports":
        base = (
            links.filter(F.col("report_year").isNotNull())
            .groupBy("incident_id", F.col("report_year").alias("year"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
    else:
        base = incidents.filter(F.col("incident_year").isNotNull()).select(
            "incident_id", F.col("incident_year").alias("year"), F.lit(1).cast("long").alias("n")
        )
    return base.join(labels, "incident_id").groupBy("year", "risk_category").agg(F.sum("n").alias("count"))


def keep_top(counts: DataFrame, column: str, top_n: int) -> DataFrame:
    """Rows of the n values with the largest totals, ties in order of the value.

    Totals and ranks are windows over the counted table, so the rows behind
    it are read once. The rank limit is applied in every task before the
    ranked rows meet in one.
    """
    total = F.sum("count").over(Window.partitionBy(column))
    rank = F.dense_rank().over(Window.orderBy(F.desc("_total"), column))
    ranked = counts.withColumn("_total", total).withColumn("_rank", rank)
    return ranked.filter(F.col("_rank") <= top_n).drop("_total", "_rank")


def risk_by_year(
    incidents: DataFrame, links: DataFrame, risks: DataFrame, metric: str = "incidents", top_n: int = 7
) -> DataFrame:
    """Counts of the top categories per year, with their share among those."""
    kept = keep_top(risk_counts(incidents, links, risks, metric), "risk_category", top_n)
    total = F.sum("count").over(Window.partitionBy("year"))
    return kept.select("year", "risk_category", "count", (F.col("count") / F.nullif(total, F.lit(0))).alias("share"))


def risk_totals(risk_years: DataFrame) -> DataFrame:
    return risk_years.groupBy("risk_category").agg(F.sum("count").alias("visible_count"))


def pivot_years(risk_years: DataFrame, years: list[int]) -> DataFrame:
    """Category by year; missing combinations are 0. The years are named by the caller."""
    return risk_years.groupBy("risk_category").pivot("year", years).sum("count").na.fill(0)


def year_list(risk_years: DataFrame) -> list[int]:
    """Years present; valid years bound the result."""
    years = risk_years.filter(F.col("year").between(dates.FIRST_YEAR, dates.LAST_YEAR))
    return [r["year"] for r in years.select("year").distinct().orderBy("year").collect()]


def heatmap_share(risk_years: DataFrame) -> DataFrame:
    """Every (category, year) pair with its share of the year; absent pairs are 0.

    The pairs come from the distinct categories and years of the table, whose
    sizes are those of the chart.
    """
    years = risk_years.agg(F.array_sort(F.collect_set("year"))).scalar()
    grid = risk_years.select("risk_category").distinct().select("risk_category", F.explode(years).alias("year"))
    full = grid.join(risk_years.select("risk_category", "year", "count"), ["risk_category", "year"], "left").na.fill(
        0, ["count"]
    )
    total = F.sum("count").over(Window.partitionBy("year"))
    share = F.coalesce(F.col("count") / F.nullif(total, F.lit(0)), F.lit(0.0))
    return full.select("risk_category", "year", "count", share.alias("share"))


def risk_rank(risk_years: DataFrame) -> DataFrame:
    """Dense rank of the categories within each year, largest first."""
    order = Window.partitionBy("year").orderBy(F.desc("count"))
    return risk_years.withColumn("rank", F.dense_rank().over(order))


def recent_top_labels(labelled: DataFrame, column: str, since: int, top_n: int) -> DataFrame:
    """Yearly counts of the labels that are most frequent since a year."""
    counts = (
        labelled.filter(F.col("year") >= since)
        .groupBy("year", column)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return keep_top(counts, column, top_n)


def label_story(labels: DataFrame, incidents: DataFrame, columns: list[str], default: str = "Unknown") -> DataFrame:
    """Label rows with their incident's year and title; missing labels are named."""
    meta = incidents.select("incident_id", F.col("incident_year").alias("year"), "incident_title")
    return labels.join(meta, "incident_id", "left").na.fill(default, columns)


def value_by_year(labelled: DataFrame, column: str, values: list[str], since: int) -> DataFrame:
    """Year by value pivot of selected values, 0 where absent."""
    rows = labelled.filter(F.col("year") >= since).filter(F.col(column).isin(values))
    return rows.groupBy("year").pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def value_counts(df: DataFrame, column: str, top_n: int | None = None, nulls: bool = False) -> DataFrame:
    """Rows per value; the null bucket only on request."""
    rows = df if nulls else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts if top_n is None else counts.orderBy(F.desc("count"), F.asc_nulls_last(column)).limit(top_n)


def count_rows(frames: dict[str, DataFrame], name: str = "level") -> DataFrame:
    """One count per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias(name), "n_rows") for n, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
