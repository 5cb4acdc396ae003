"""Counts per country, and the rows behind the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import few


def country_counts(locations: DataFrame, links: DataFrame | None = None, fallback: bool = False) -> DataFrame:
    """Distinct incidents, or reports when links are given, per country.

    Distinct ids are counted per (country, place) and summed over places, so
    an id with two places in a country counts twice. A row needs both
    values, unless ``fallback`` lets the place stand in for the country.
    """
    rows = locations if links is None else locations.join(
        links.select("incident_id", "report_id").distinct(), "incident_id"
    )
    if fallback:
        rows = rows.filter("country IS NOT NULL OR location_label IS NOT NULL")
    else:
        rows = rows.filter("country IS NOT NULL AND location_label IS NOT NULL")
    ids = "incident_id" if links is None else "report_id"
    label = F.trim(F.coalesce("country", "location_label"))
    return (
        rows.groupBy("country", "location_label")
        .agg(F.countDistinct(ids).alias("n"))
        .groupBy(label.alias("country_label"))
        .agg(F.sum("n").alias("count"))
        .filter("country_label <> ''")
    )


def country_iso(df: DataFrame, countries: DataFrame, column: str = "country_label") -> DataFrame:
    """Three-letter codes from a country table with code2, code3 and name.

    Two-letter values are looked up as codes, all others as names. The table
    is expanded to one row per key, and the world's countries bound it.
    """
    keys = (
        countries.select(F.upper("code2").alias("_key"), F.col("code3").alias("iso_alpha"))
        .unionByName(countries.filter(F.length("name") != 2).select(F.col("name").alias("_key"), F.col("code3").alias("iso_alpha")))
        .groupBy("_key").agg(F.min("iso_alpha").alias("iso_alpha"))
    )
    value = F.trim(column)
    key = (
        F.when(F.lower(value).isin("", "global", "--", "unknown"), F.lit(None))
        .when(value.rlike("^[A-Za-z]{2}$"), F.upper(value))
        .otherwise(value)
    )
    return df.withColumn("_key", key).join(few(keys, "countries"), "_key", "left").drop("_key")


def map_table(counts: DataFrame) -> DataFrame:
    """Rows with a code if any has one, else all rows by name; with bubble sizes."""
    codes = counts.agg(F.count("iso_alpha")).scalar()
    size = F.least(F.greatest(F.sqrt("count") * 5, F.lit(8.0)), F.lit(28.0))
    return (
        counts.filter((codes == 0) | F.col("iso_alpha").isNotNull())
        .select(
            "country_label", "count", "iso_alpha",
            F.coalesce("iso_alpha", "country_label").alias("location"),
            F.when(F.col("iso_alpha").isNotNull(), size).alias("bubble_size"),
        )
    )


def top_countries(counts: DataFrame, n: int = 12) -> DataFrame:
    return counts.orderBy(F.desc("count"), "country_label").limit(n)
