"""Canonical incident and report tables from loosely structured inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources import names
from ..session import cut_lineage
from .ordering import keep_first, with_row_index

# Source columns of the parties named in an incident.
PARTIES = [
    ("alleged_deployer_of_ai_system", "ai_deployer"),
    ("alleged_developer_of_ai_system", "ai_developer"),
    ("alleged_harmed_or_nearly_harmed_parties", "harmed_parties"),
]


def _string(column: str | None, clean: bool = False) -> Column:
    """The column as text, or "" when the table has no such column."""
    if column is None:
        return F.lit("")
    return text.normalize_text(column) if clean else text.safe_string(column)


def _date(column: str | None) -> tuple[Column, Column]:
    if column is None:
        return F.lit(None).cast("timestamp"), F.lit(None).cast("int")
    return dates.parse_timestamp(column), dates.extract_year(column)


def incidents(df: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """Incident table of the dashboard views; the raw columns are kept."""
    notes = notes if notes is not None else []
    found = {
        "id": names.find_column(df.columns, names.INCIDENT_ID),
        "title": names.find_column(df.columns, names.TITLE),
        "description": names.find_column(df.columns, names.DESCRIPTION),
        "date": names.find_column(df.columns, names.DATE),
        "links": names.find_column(df.columns, names.REPORT_LINKS),
    }
    if found["id"] is None:
        df = with_row_index(df, "_row")
        notes.append("No incident ID column was found; the row index is used.")
    if found["date"] is None:
        notes.append("Incidents have no date column, so views over time lack them.")
    if found["links"] is None:
        notes.append("Incidents have no column of report links, so attention counts only direct links.")
    when, year = _date(found["date"])
    out = df.select(
        "*",
        F.trim(_string(found["id"] or "_row")).alias("c_id"),
        _string(found["title"]).alias("c_title"),
        _string(found["description"]).alias("c_description"),
        when.alias("c_date"),
        year.alias("c_year"),
        text.parse_list(found["links"] or F.lit("")).alias("c_links"),
    ).withColumn("c_search", text.join_text("c_title", "c_description"))
    canonical = {
        "incident_id": F.col("c_id"),
        "incident_title": F.col("c_title"),
        "incident_description": F.col("c_description"),
        "incident_date": F.col("c_date"),
        "incident_year": F.col("c_year"),
        "report_ids": F.col("c_links"),
        "report_count": F.size("c_links"),
        "search_text": F.col("c_search"),
    }
    raw = [c for c in df.columns if c not in canonical and c != "_row"]
    return out.select(*[c.alias(n) for n, c in canonical.items()], *raw).filter("incident_id <> ''")


def reports(df: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """Report table of the dashboard views."""
    notes = notes if notes is not None else []
    report_id = names.find_column(df.columns, names.REPORT_ID)
    domain = names.find_column(df.columns, names.DOMAIN)
    direct = "incident_id" if "incident_id" in df.columns else None
    url = _string(names.find_column(df.columns, names.URL))
    if report_id is None:
        df = with_row_index(df, "_row")
        notes.append("No report ID column was found; the row index is used.")
    _, year = _date(names.find_column(df.columns, names.DATE))
    out = df.select(
        F.trim(_string(report_id or "_row")).alias("report_id"),
        _string(names.find_column(df.columns, names.TITLE)).alias("report_title"),
        _string(names.find_column(df.columns, names.DESCRIPTION)).alias("report_text"),
        url.alias("report_url"),
        text.fill_domain(domain if domain else text.url_host(url)).alias("source_domain"),
        year.alias("report_year"),
        *([F.col(direct)] if direct else []),
    )
    return out.filter("report_id <> ''")


def corpus_incidents(df: DataFrame) -> DataFrame:
    """Incident table of the text corpus: cleaned text, one row per incident."""
    incident_id = names.require_column(df.columns, names.INCIDENT_ID_STRICT, "incidents", "incident ID")
    links = names.find_column(df.columns, names.REPORT_LINKS_WIDE)
    when, year = _date(names.find_column(df.columns, names.DATE_WIDE))
    out = df.select(
        text.normalize_text(incident_id).alias("incident_id"),
        _string(names.find_column(df.columns, names.TITLE), True).alias("incident_title"),
        _string(names.find_column(df.columns, names.DESCRIPTION_WIDE), True).alias("incident_description"),
        when.alias("incident_date"),
        year.alias("incident_year"),
        text.parse_list(links or F.lit("")).alias("incident_report_ids"),
        *[_string(src if src in df.columns else None, True).alias(dst) for src, dst in PARTIES],
        F.monotonically_increasing_id().alias("_order"),
    ).filter("incident_id <> ''")
    return keep_first(out, ["incident_id"], ["_order"]).drop("_order")


def corpus_reports(df: DataFrame) -> DataFrame:
    """Report table of the text corpus, with the incident it names, if any."""
    report_id = names.find_column(df.columns, names.REPORT_ID_STRICT)
    incident_id = names.find_column(df.columns, names.INCIDENT_ID_STRICT)
    if report_id is None and incident_id is None:
        raise ValueError(
            "Could not detect either a report ID or an incident ID for `reports`. "
            f"Available columns: {', '.join(df.columns)}"
        )
    domain = names.find_column(df.columns, names.DOMAIN)
    url = _string(names.find_column(df.columns, names.URL), True)
    when, year = _date(names.find_column(df.columns, names.DATE_WIDE))
    if report_id is None:
        df = with_row_index(df, "_row")
        key = F.concat(F.lit("generated_report_"), F.col("_row").cast("string"))
    else:
        key = text.normalize_text(report_id)
    return df.select(
        key.alias("report_id"),
        _string(incident_id, True).alias("direct_incident_id"),
        _string(names.find_column(df.columns, names.TITLE), True).alias("report_title"),
        _string(names.find_column(df.columns, names.TEXT), True).alias("report_text"),
        url.alias("report_url"),
        text.fill_domain(text.normalize_text(domain) if domain else text.url_domain(url)).alias("source_domain"),
        when.alias("report_date"),
        year.alias("report_year"),
    ).filter("report_id <> ''")


def resolve_duplicates(df: DataFrame, duplicates: DataFrame, key: str = "incident_id") -> DataFrame:
    """Replace duplicate incident ids by the true one, following chains to their end.

    ``duplicates`` has the columns duplicate_incident_number and
    true_incident_number; of several true ids the smallest counts, and an id
    that is its own true id ends a chain. Each round doubles the length of
    chain that is followed and cuts the lineage, so that n pairs take at most
    log2(n) + 1 rounds. A cycle has no end and raises.
    """
    pairs = duplicates.select(
        F.col("duplicate_incident_number").cast("string").alias("src"),
        F.col("true_incident_number").cast("string").alias("dst"),
    ).filter("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    pairs = cut_lineage(pairs)
    for _ in range(pairs.count().bit_length() + 1):
        onward = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        step = cut_lineage(pairs.join(onward, "dst", "left"))
        pairs = step.select("src", F.coalesce("next", "dst").alias("dst"))
        if step.filter("next IS NOT NULL").isEmpty():
            break
    else:
        if not step.filter("next IS NOT NULL").isEmpty():
            raise ValueError("The duplicate ids form a cycle.")
    keyed = df.withColumn("_key", F.col(key).cast("string"))
    merged = keyed.join(pairs, keyed["_key"] == pairs["src"], "left")
    return merged.withColumn(key, F.coalesce("dst", "_key")).drop("_key", "src", "dst")
