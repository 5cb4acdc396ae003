"""Filtered views, yearly trends, attention, places, network and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import attention, clusters, corpus, filters, network, ordering, places, trends
from ..sources import catalog
from . import roles
from .registry import query
from .roles import ATTENTION, INCIDENTS, LINKS, LOCATIONS, METADATA, META_VALUES, RECORDS, RISKS, table

YEARS = (1996, 1999)
PICKED_RISKS = ["1-URGENT", "2-HIGH"]
PICKED_DOMAINS = ["Brand#3", "Brand#7"]
TOP = 5


def _attention(spark, sf) -> DataFrame:
    return attention.attention(roles.incidents(spark, sf), roles.bare_links(spark, sf))


# --- filters ---------------------------------------------------------------

@query(f"WITH {INCIDENTS} SELECT incident_id, incident_year FROM inc WHERE coalesce(incident_year, -1) BETWEEN 1996 AND 1999")
def filter_year_range(spark, sf):
    return roles.incidents(spark, sf).filter(filters.year_between("incident_year", *YEARS)).select("incident_id", "incident_year")


@query(f"WITH {INCIDENTS} SELECT incident_id FROM inc WHERE contains(lower(search_text), 'status f')")
def filter_keyword(spark, sf):
    return roles.incidents(spark, sf).filter(filters.has_keyword("search_text", " Status F ")).select("incident_id")


@query(f"""WITH {RISKS} SELECT incident_id, risk_category FROM rsk
  WHERE incident_id IN (SELECT incident_id FROM rsk WHERE risk_category IN ('1-URGENT', '2-HIGH'))""")
def filter_risk(spark, sf):
    risks = roles.risks(spark, sf)
    chosen = risks.filter(F.col("risk_category").isin(PICKED_RISKS))
    return filters.restrict(risks, chosen).select("incident_id", "risk_category")


@query(f"""WITH {INCIDENTS}, {LINKS} SELECT incident_id FROM inc
  WHERE incident_id IN (SELECT incident_id FROM lnk WHERE source_domain IN ('Brand#3', 'Brand#7'))""")
def filter_domain(spark, sf):
    out = filters.filter_context(roles.context(spark, sf), domains=PICKED_DOMAINS)
    return out.incidents.select("incident_id")


@query(f"""WITH {INCIDENTS}, {LINKS}, {RISKS}, {LOCATIONS},
  fi AS (SELECT * FROM inc WHERE coalesce(incident_year, -1) BETWEEN 1996 AND 1999 AND contains(lower(search_text), 'status f')
    AND incident_id IN (SELECT incident_id FROM rsk WHERE risk_category IN ('1-URGENT', '2-HIGH'))),
  fl AS (SELECT * FROM lnk WHERE source_domain IN ('Brand#3', 'Brand#7') AND incident_id IN (SELECT incident_id FROM fi)),
  ff AS (SELECT * FROM fi WHERE incident_id IN (SELECT incident_id FROM fl))
  SELECT 'incidents' AS table_name, incident_id, incident_title AS detail FROM ff
  UNION ALL SELECT 'incident_reports', incident_id, report_title FROM fl
  UNION ALL SELECT 'risk_long', incident_id, risk_category FROM rsk WHERE incident_id IN (SELECT incident_id FROM ff)
  UNION ALL SELECT 'locations', incident_id, country FROM loc WHERE incident_id IN (SELECT incident_id FROM ff)""")
def filtered_context(spark, sf):
    out = filters.filter_context(roles.context(spark, sf), YEARS, PICKED_RISKS, PICKED_DOMAINS, "STATUS F")
    parts = [
        ("incidents", out.incidents, "incident_title"), ("incident_reports", out.incident_reports, "report_title"),
        ("risk_long", out.risk_long, "risk_category"), ("locations", out.locations, "country"),
    ]
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("table_name"), "incident_id", F.col(c).alias("detail")) for n, df, c in parts
    ])


@query(f"""WITH {RECORDS} SELECT doc_id FROM rec WHERE TRY_CAST(incident_year AS DOUBLE) BETWEEN 1200 AND 4000
  AND list_has_any(string_split(coalesce(mit_risk_domain, ''), ' | '), ['quality 1'])
  AND source_domain IN ('src1', 'src2', 'src3', 'src4', 'src5')
  AND contains(lower(input_text || ' ' || incident_title), 'th') AND cluster_label = 4""")
def filter_cluster_records(spark, sf):
    sources = [f"src{i}" for i in range(1, 6)]
    return filters.filter_cluster_records(
        roles.records(spark, sf), (1200, 4000), ["quality 1"], sources, "TH", "4"
    ).select("doc_id")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 400 AND CAST(doc_id AS VARCHAR) <> ''")
def filter_min_text(spark, sf):
    kept = table(spark, sf, "documents").filter(filters.long_enough("text", 400, "doc_id"))
    return kept.select("doc_id", F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 45)""")
def filter_min_support(spark, sf):
    return filters.min_support(table(spark, sf, "documents"), "source", 45).select("doc_id", "source")


# --- counts over the years ---------------------------------------------------

@query(f"WITH {INCIDENTS} SELECT incident_year AS year, count(*) AS count FROM inc WHERE incident_year IS NOT NULL GROUP BY 1")
def incidents_per_year(spark, sf):
    return trends.per_year(roles.incidents(spark, sf), "incident_year")


@query(f"WITH {LINKS} SELECT report_year AS year, count(*) AS count FROM lnk WHERE report_year IS NOT NULL GROUP BY 1")
def reports_per_year(spark, sf):
    return trends.per_year(roles.bare_links(spark, sf), "report_year")


@query(f"""WITH {INCIDENTS}, {LINKS}, i AS (SELECT incident_year AS year, count(*) AS incidents FROM inc WHERE incident_year IS NOT NULL GROUP BY 1),
  r AS (SELECT report_year AS year, count(*) AS reports FROM lnk GROUP BY 1)
  SELECT year, incidents, reports FROM i FULL JOIN r USING (year)""")
def overview_by_year(spark, sf):
    return trends.overview_by_year(roles.incidents(spark, sf), roles.bare_links(spark, sf))


@query(f"""WITH {LINKS}, y AS (SELECT report_year AS year, count(*) AS count FROM lnk GROUP BY 1)
  SELECT year, count, round(avg(count) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling FROM y""")
def rolling_average(spark, sf):
    out = trends.rolling_average(trends.per_year(roles.bare_links(spark, sf), "report_year"))
    return out.withColumn("rolling", F.round("rolling", 6))


_RISK_REPORTS = f"""{LINKS}, {RISKS}, c AS (
  SELECT report_year AS year, risk_category, count(*) AS count FROM lnk JOIN rsk USING (incident_id)
  WHERE report_year IS NOT NULL AND risk_category IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT risk_category FROM c GROUP BY 1 ORDER BY sum(count) DESC, risk_category LIMIT {TOP}),
  ry AS (SELECT * FROM c WHERE risk_category IN (SELECT risk_category FROM k))"""
_RISK_INCIDENTS = f"""{INCIDENTS}, {RISKS}, c AS (
  SELECT incident_year AS year, risk_category, count(*) AS count FROM inc JOIN rsk USING (incident_id)
  WHERE incident_year IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT risk_category FROM c GROUP BY 1 ORDER BY sum(count) DESC, risk_category LIMIT {TOP}),
  ry AS (SELECT * FROM c WHERE risk_category IN (SELECT risk_category FROM k))"""


def _risk_years(spark, sf, metric: str) -> DataFrame:
    incidents, links, risks = (f(spark, sf) for f in (roles.incidents, roles.bare_links, roles.risks))
    return trends.risk_by_year(incidents, links, risks, metric, TOP)


@query(f"WITH {_RISK_REPORTS} SELECT year, risk_category, count, round(count / sum(count) OVER (PARTITION BY year), 6) AS share FROM ry")
def risk_by_year_reports(spark, sf):
    return _risk_years(spark, sf, "reports").withColumn("share", F.round("share", 6))


@query(f"WITH {_RISK_INCIDENTS} SELECT year, risk_category, count, round(count / sum(count) OVER (PARTITION BY year), 6) AS share FROM ry")
def risk_by_year_incidents(spark, sf):
    return _risk_years(spark, sf, "incidents").withColumn("share", F.round("share", 6))


@query(f"WITH {_RISK_REPORTS} SELECT risk_category, sum(count)::BIGINT AS visible_count FROM ry GROUP BY 1")
def risk_summary(spark, sf):
    return trends.risk_totals(_risk_years(spark, sf, "reports"))


@query(f"""WITH {_RISK_INCIDENTS} SELECT c.risk_category, CAST(y.year AS VARCHAR) AS year, coalesce(sum(ry.count), 0)::BIGINT AS count
  FROM (SELECT DISTINCT risk_category FROM ry) c CROSS JOIN (SELECT DISTINCT year FROM ry WHERE year BETWEEN 1900 AND 2100) y
  LEFT JOIN ry ON ry.risk_category = c.risk_category AND ry.year = y.year GROUP BY 1, 2""")
def risk_heatmap(spark, sf):
    """The pivot over all years of the data, as rows, since the years are not known to the SQL."""
    counts = _risk_years(spark, sf, "incidents")
    years = trends.year_list(counts)
    wide = trends.pivot_years(counts, years)
    return wide.unpivot("risk_category", [str(y) for y in years], "year", "count")


@query(f"""WITH {_RISK_INCIDENTS}, g AS (SELECT * FROM (SELECT DISTINCT risk_category FROM ry), (SELECT DISTINCT year FROM ry))
  SELECT g.risk_category, g.year, coalesce(count, 0) AS count,
    round(coalesce(coalesce(count, 0) / nullif(sum(coalesce(count, 0)) OVER (PARTITION BY g.year), 0), 0), 6) AS share
  FROM g LEFT JOIN ry ON g.risk_category = ry.risk_category AND g.year = ry.year""")
def risk_heatmap_share(spark, sf):
    return trends.heatmap_share(_risk_years(spark, sf, "incidents")).withColumn("share", F.round("share", 6))


@query(f"""WITH {_RISK_REPORTS} SELECT year, risk_category, count, CAST(dense_rank() OVER (PARTITION BY year ORDER BY count DESC) AS INTEGER) AS rank FROM ry""")
def risk_rank(spark, sf):
    return trends.risk_rank(_risk_years(spark, sf, "reports")).select("year", "risk_category", "count", "rank")


@query("""WITH l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_type AS label FROM lineitem JOIN part ON p_partkey = l_partkey),
  c AS (SELECT year, label, count(*) AS count FROM l WHERE year >= 1998 GROUP BY 1, 2),
  k AS (SELECT label FROM c GROUP BY 1 ORDER BY sum(count) DESC, label LIMIT 3)
  SELECT year, label, count FROM c WHERE label IN (SELECT label FROM k)""")
def recent_top_labels(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("label"))
    lines = table(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"))
    return trends.recent_top_labels(lines.join(part, "l_partkey"), "label", 1998, 3)


@query(f"""WITH {INCIDENTS}, {RISKS} SELECT r.incident_id, incident_year AS year, incident_title, coalesce(r.label, 'Unknown') AS label
  FROM (SELECT incident_id, nullif(risk_category, '2-HIGH') AS label FROM rsk) r LEFT JOIN inc ON inc.incident_id = r.incident_id""")
def taxonomy_story(spark, sf):
    labels = roles.risks(spark, sf).select("incident_id", F.nullif("risk_category", F.lit("2-HIGH")).alias("label"))
    return trends.label_story(labels, roles.incidents(spark, sf), ["label"])


@query(f"""WITH {INCIDENTS}, {RISKS}, s AS (SELECT incident_year AS year, risk_category FROM rsk LEFT JOIN inc USING (incident_id))
  SELECT year, count(*) FILTER (risk_category = '1-URGENT') AS urgent, count(*) FILTER (risk_category = '5-LOW') AS low
  FROM s WHERE year >= 1997 AND risk_category IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def intent_by_year(spark, sf):
    story = trends.label_story(roles.risks(spark, sf), roles.incidents(spark, sf), ["risk_category"])
    return trends.value_by_year(story, "risk_category", ["1-URGENT", "5-LOW"], 1997).toDF("year", "urgent", "low")


# --- attention ---------------------------------------------------------------

@query(f"""WITH {INCIDENTS}, {LINKS}, {RISKS} SELECT (SELECT count(DISTINCT incident_id) FROM inc) AS total_incidents,
  (SELECT count(DISTINCT report_id) FROM lnk) AS total_reports,
  (SELECT min(incident_year) || ' - ' || max(incident_year) FROM inc) AS year_range,
  (SELECT count(DISTINCT risk_category) FROM rsk) AS risk_categories""")
def kpi_summary(spark, sf):
    incidents, links, risks = (f(spark, sf) for f in (roles.incidents, roles.bare_links, roles.risks))
    return attention.kpi_summary(incidents, links, risks)


@query(f"WITH {ATTENTION} SELECT incident_id, incident_title, incident_year, report_count FROM att")
def attention_per_incident(spark, sf):
    return _attention(spark, sf).select("incident_id", "incident_title", "incident_year", "report_count")


@query(f"WITH {ATTENTION} SELECT incident_id, incident_title, report_count FROM att ORDER BY report_count DESC, incident_id LIMIT 15")
def top_incidents(spark, sf):
    return attention.top_incidents(_attention(spark, sf), 15).select("incident_id", "incident_title", "report_count")


@query(f"""WITH {ATTENTION} SELECT incident_id, incident_title, incident_year, report_count FROM att
  ORDER BY incident_year DESC NULLS LAST, incident_title NULLS LAST, incident_id LIMIT 50""")
def evidence_table(spark, sf):
    top = attention.evidence_table(_attention(spark, sf), 50)
    return top.select("incident_id", "incident_title", "incident_year", "report_count")


@query(f"WITH {LINKS} SELECT source_domain, count(*) AS count FROM lnk WHERE source_domain IS NOT NULL GROUP BY 1 ORDER BY count DESC, source_domain LIMIT 10")
def top_domains(spark, sf):
    return attention.top_domains(roles.links(spark, sf), 10)


@query(f"""WITH {ATTENTION}, h AS (SELECT report_count, count(*) AS n FROM att GROUP BY 1),
  p AS (SELECT sum(n) OVER (ORDER BY report_count) AS a, sum(n) OVER () AS b, sum(n * report_count) OVER (ORDER BY report_count) AS c,
    sum(n * report_count) OVER () AS d FROM h)
  SELECT round(a / b, 6) AS incident_share, round(c / d, 6) AS report_share FROM p UNION ALL SELECT 0.0, 0.0""")
def lorenz_curve(spark, sf):
    curve = attention.lorenz_curve(_attention(spark, sf))
    return curve.select(F.round("incident_share", 6).alias("incident_share"), F.round("report_share", 6).alias("report_share"))


@query(f"""WITH {ATTENTION}, b AS (SELECT min(report_count) AS lo, max(report_count) AS hi,
    least(25, greatest(5, count(DISTINCT report_count))) AS bins FROM att),
  w AS (SELECT lo, bins, greatest(hi - lo, 1) / bins AS width FROM b),
  p AS (SELECT CAST(least(floor((report_count - lo) / width) + 1, bins) AS INTEGER) AS bin, lo, width FROM att, w)
  SELECT bin, round(min(lo + (bin - 1) * width), 6) AS bin_start, count(*) AS incidents FROM p GROUP BY 1""")
def attention_histogram(spark, sf):
    return attention.attention_histogram(_attention(spark, sf)).withColumn("bin_start", F.round("bin_start", 6))


@query("""SELECT l_returnflag, CAST(2 AS INTEGER) AS report_count, count(*) AS n FROM lineitem GROUP BY 1""")
def report_count_list(spark, sf):
    listed = F.format_string("[%d, %d]", "l_partkey", "l_suppkey")
    df = table(spark, sf, "lineitem").select("l_returnflag", F.size(text.parse_list(listed)).alias("report_count"))
    return df.groupBy("l_returnflag", "report_count").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ATTENTION}, {RISKS}, top AS (SELECT * FROM att ORDER BY report_count DESC, incident_id LIMIT 1),
  l AS (SELECT DISTINCT risk_category FROM rsk WHERE incident_id IN (SELECT incident_id FROM top) ORDER BY 1 LIMIT 5),
  s AS (SELECT DISTINCT report_title, report_url, source_domain FROM lnk WHERE incident_id IN (SELECT incident_id FROM top) ORDER BY 1, 2, 3 LIMIT 5)
  SELECT incident_id, incident_title, incident_year, report_count, (SELECT string_agg(risk_category, ', ' ORDER BY risk_category) FROM l) AS risk_categories,
    (SELECT string_agg(report_title || ' <' || report_url || '>', '; ' ORDER BY report_title || ' <' || report_url || '>') FROM s) AS source_examples FROM top""")
def incident_detail(spark, sf):
    return attention.incident_detail(_attention(spark, sf), roles.risks(spark, sf), roles.links(spark, sf)).drop("incident_description")


# --- places and network --------------------------------------------------------

_COUNTRIES = """cc AS (SELECT country AS country_label, sum(n)::BIGINT AS count FROM (
  SELECT country, location_label, count(DISTINCT id) AS n FROM src WHERE country IS NOT NULL AND location_label IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {LOCATIONS}, src AS (SELECT *, incident_id AS id FROM loc), {_COUNTRIES} SELECT * FROM cc")
def country_incidents(spark, sf):
    return places.country_counts(roles.locations(spark, sf))


@query(f"WITH {LOCATIONS}, {LINKS}, src AS (SELECT loc.*, report_id AS id FROM loc JOIN lnk USING (incident_id)), {_COUNTRIES} SELECT * FROM cc")
def country_reports(spark, sf):
    return places.country_counts(roles.locations(spark, sf), roles.bare_links(spark, sf))


@query(f"WITH {LOCATIONS}, src AS (SELECT *, incident_id AS id FROM loc), {_COUNTRIES} SELECT * FROM cc ORDER BY count DESC, country_label LIMIT 12")
def top_countries(spark, sf):
    return places.top_countries(places.country_counts(roles.locations(spark, sf)))


@query(f"""WITH {LOCATIONS}, src AS (SELECT *, incident_id AS id FROM loc), {_COUNTRIES},
  m AS (SELECT cc.*, 'NA' || chr(65 + n_nationkey) AS iso_alpha FROM cc LEFT JOIN nation ON n_name = country_label AND n_regionkey <> 0)
  SELECT country_label, count, iso_alpha, iso_alpha AS location, round(least(greatest(sqrt(count) * 5, 8), 28), 6) AS bubble_size FROM m WHERE iso_alpha IS NOT NULL""")
def map_table(spark, sf):
    letter = F.char(F.lit(65) + F.col("n_nationkey"))
    known = table(spark, sf, "nation").filter("n_regionkey <> 0").select(
        F.concat(F.lit("N"), letter).alias("code2"), F.concat(F.lit("NA"), letter).alias("code3"), F.col("n_name").alias("name")
    )
    counts = places.country_iso(places.country_counts(roles.locations(spark, sf)), known)
    return places.map_table(counts).withColumn("bubble_size", F.round("bubble_size", 6))


_NETWORK = f"""{ATTENTION}, {RISKS}, net AS (
  SELECT a.incident_id, incident_title, report_count, risk_category, source_domain, domain_reports FROM att a
  JOIN (SELECT DISTINCT incident_id, risk_category FROM rsk) r ON r.incident_id = a.incident_id
  LEFT JOIN (SELECT incident_id, source_domain, count(DISTINCT report_id) AS domain_reports FROM lnk GROUP BY 1, 2) d ON d.incident_id = a.incident_id),
  top AS (SELECT incident_id, incident_title, max(report_count) AS report_count FROM net GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 25),
  few AS (SELECT * FROM net WHERE incident_id IN (SELECT incident_id FROM top))"""


def _network(spark, sf) -> DataFrame:
    return network.network_table(_attention(spark, sf), roles.risks(spark, sf), roles.links(spark, sf))


@query(f"WITH {_NETWORK} SELECT * FROM net")
def network_table(spark, sf):
    return _network(spark, sf)


@query(f"WITH {_NETWORK} SELECT * FROM top")
def network_top_incidents(spark, sf):
    return network.top_network_incidents(_network(spark, sf), 25)


@query(f"""WITH {_NETWORK} SELECT DISTINCT 'incident::' || incident_id AS node, incident_title AS label, 'Incident' AS node_type FROM few
  UNION SELECT 'risk::' || risk_category, risk_category, 'Risk' FROM few
  UNION SELECT 'source::' || source_domain, source_domain, 'Source' FROM few WHERE source_domain <> ''""")
def network_nodes(spark, sf):
    return network.nodes(_attention(spark, sf), roles.risks(spark, sf), roles.links(spark, sf), 25)


@query(f"""WITH {_NETWORK} SELECT DISTINCT 'incident::' || incident_id AS src, 'risk::' || risk_category AS dst FROM few
  UNION SELECT 'incident::' || incident_id, 'source::' || source_domain FROM few WHERE source_domain <> ''""")
def network_edges(spark, sf):
    return network.edges(_attention(spark, sf), roles.risks(spark, sf), roles.links(spark, sf), 25)


# --- cluster views ---------------------------------------------------------------

def _summary(records: DataFrame) -> DataFrame:
    """A summary that names only some clusters."""
    base = records.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("size"))
    return base.filter("cluster_label <> 7").select(
        "cluster_label", clusters.default_name().alias("cluster_name"), F.lit("one, two").alias("top_keywords"), "size"
    )


_SUMMARY = f"""{RECORDS}, summ AS (SELECT cluster_label, 'Cluster ' || cluster_label AS cluster_name, 'one, two' AS top_keywords, count(*) AS size
  FROM rec WHERE cluster_label <> 7 GROUP BY 1)"""


@query(f"""WITH {_SUMMARY} SELECT summ.*, visible_records, visible_incidents FROM summ JOIN (
  SELECT cluster_label, count(*) AS visible_records, count(DISTINCT incident_id) AS visible_incidents FROM rec GROUP BY 1) v USING (cluster_label)""")
def visible_clusters(spark, sf):
    records = roles.records(spark, sf)
    return clusters.visible_clusters(_summary(records), records)


@query(f"""WITH {_SUMMARY} SELECT cluster_label, cluster_name, count(*) AS visible_records FROM summ JOIN rec USING (cluster_label) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 15""")
def largest_clusters(spark, sf):
    records = roles.records(spark, sf)
    top = clusters.largest_clusters(clusters.visible_clusters(_summary(records), records))
    return top.select("cluster_label", "cluster_name", "visible_records")


@query(f"""WITH {_SUMMARY} SELECT count(*) AS records, count(DISTINCT incident_id) AS incidents, count(DISTINCT cluster_label) AS clusters,
  (SELECT cluster_name FROM summ ORDER BY size DESC, cluster_label LIMIT 1) AS largest_cluster FROM rec""")
def cluster_kpi(spark, sf):
    records = roles.records(spark, sf)
    return clusters.cluster_kpi(_summary(records), records)


@query(f"""WITH {_SUMMARY} SELECT CAST(cluster_label AS VARCHAR) AS choice, cluster_name || ' (' || format('{{:,}}', size) || '): one, two' AS choice_text, size FROM summ""")
def cluster_choices(spark, sf):
    return clusters.cluster_choices(_summary(roles.records(spark, sf)))


@query(f"""WITH {_SUMMARY} SELECT doc_id, coalesce(cluster_name, 'Cluster ' || rec.cluster_label) AS cluster_name FROM rec
  LEFT JOIN summ USING (cluster_label)""")
def lookup_default(spark, sf):
    records = roles.records(spark, sf)
    return clusters.name_clusters(records, _summary(records)).select("doc_id", "cluster_name")


_CLUSTER_YEARS = f"""{RECORDS}, cy AS (SELECT CAST(incident_year AS INTEGER) AS year, cluster_label, count(*) AS count FROM rec
  WHERE CAST(incident_year AS INTEGER) BETWEEN 1900 AND 2100 GROUP BY 1, 2)"""


@query(f"""WITH {_CLUSTER_YEARS}, k AS (SELECT cluster_label FROM cy GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 2)
  SELECT * FROM cy WHERE cluster_label IN (SELECT cluster_label FROM k)""")
def cluster_timeline(spark, sf):
    return clusters.cluster_timeline(roles.records(spark, sf), top_n=2).select("year", "cluster_label", "count")


@query(f"""WITH {RECORDS}, {META_VALUES}, c AS (SELECT metadata_type, metadata_column, cluster_label, value, count(*) AS count FROM vals GROUP BY ALL)
  SELECT *, round(count / sum(count) OVER (PARTITION BY metadata_type, cluster_label), 6) AS share_within_cluster FROM c""")
def cluster_metadata_distribution(spark, sf):
    out = clusters.metadata_distribution(roles.records(spark, sf), METADATA)
    return out.withColumn("share_within_cluster", F.round("share_within_cluster", 6))


@query(f"""WITH {RECORDS}, {META_VALUES}, c AS (SELECT metadata_type, cluster_label, value, count(*) AS n FROM vals GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY metadata_type, cluster_label ORDER BY n DESC, value) AS rank FROM c)
  SELECT metadata_type, cluster_label, string_agg(value || ' (' || n || ')', ' | ' ORDER BY rank) AS top_values FROM r WHERE rank <= 3 GROUP BY 1, 2""")
def cluster_top_metadata(spark, sf):
    return clusters.top_metadata(roles.records(spark, sf), METADATA)


@query(f"""WITH {RECORDS}, {META_VALUES}, c AS (SELECT metadata_type AS metadata, value, count(*) AS count FROM vals GROUP BY 1, 2)
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY metadata ORDER BY count DESC, value) AS r FROM c) WHERE r <= 8""")
def metadata_profile(spark, sf):
    return clusters.metadata_profile(roles.records(spark, sf), METADATA)


@query(f"""WITH {RECORDS} SELECT 'Cluster ' || cluster_label AS "Theme", incident_id AS "Incident ID", incident_title AS "Incident title",
  incident_year AS "Year", source_domain AS "Source domain", mit_risk_domain AS "Risk category", substr(input_text, 1, 240) AS "Text preview"
  FROM rec ORDER BY doc_id LIMIT 60""")
def example_records(spark, sf):
    return clusters.example_records(roles.records(spark, sf), ["doc_id"], 60)


@query(f"""WITH {_SUMMARY}, v AS (SELECT cluster_label, count(*) AS n, count(DISTINCT incident_id) AS m FROM rec GROUP BY 1)
  SELECT cluster_name AS "Theme", n AS "Visible records", m AS "Visible incidents", top_keywords AS "Top keywords"
  FROM summ JOIN v USING (cluster_label) ORDER BY n DESC, cluster_label LIMIT 30""")
def cluster_summary_table(spark, sf):
    records = roles.records(spark, sf)
    return clusters.summary_table(clusters.visible_clusters(_summary(records), records))


# --- ordering and profiles -------------------------------------------------------

@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
  ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def dedup_keep_first(spark, sf):
    lines = table(spark, sf, "lineitem")
    kept = ordering.keep_first(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return kept.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 2000")
def sample_n(spark, sf):
    return ordering.sample_rows(table(spark, sf, "orders"), "o_orderkey", 2000).select("o_orderkey", "o_totalprice")


@query("SELECT source, count(*) AS count FROM documents GROUP BY 1 ORDER BY count DESC, source LIMIT 12")
def class_distribution(spark, sf):
    return trends.value_counts(table(spark, sf, "documents"), "source", 12)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM j" for c in ("text", "quality", "toxic")).join(
    ["WITH j AS (SELECT text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) ", ""]))
def missing_counts(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return corpus.missing_counts(docs.select("text", F.col("quality"), F.col("toxic")), ["text", "quality", "toxic"])


_PROFILED = (
    ("orders", 6, "incidents"), ("part", 6, "reports"), ("lineitem", 11, "links"), ("documents", 5, ""), ("region", 2, ""), ("nation", 3, ""),
    ("customer", 5, ""), ("supplier", 4, ""), ("events", 6, ""), ("embeddings", 3, ""), ("pages", 3, ""), ("benchmark", 2, ""), ("labels", 3, ""),
    ("conversations", 4, ""),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST({k} AS INTEGER) AS n_columns, '{r}' AS role FROM {n}"
  for n, k, r in _PROFILED))
def table_profile(spark, sf):
    tables = {n: table(spark, sf, n) for n, _, _ in _PROFILED}
    return catalog.table_profile(tables, {n: r for n, _, r in _PROFILED if r})


@query(f"""WITH {INCIDENTS}, {RISKS}, {LINKS}
  SELECT 'incident_year_min' AS kind, CAST(min(incident_year) AS VARCHAR) AS value FROM inc UNION ALL SELECT 'incident_year_max', CAST(max(incident_year) AS VARCHAR) FROM inc
  UNION ALL SELECT 'n_incidents', CAST(count(*) AS VARCHAR) FROM inc UNION ALL SELECT 'n_risks', CAST(count(*) AS VARCHAR) FROM rsk
  UNION ALL SELECT 'n_reports', CAST(count(*) AS VARCHAR) FROM rep
  UNION ALL SELECT DISTINCT 'risk_category', risk_category FROM rsk WHERE risk_category <> ''
  UNION ALL SELECT DISTINCT 'source_domain', source_domain FROM rep WHERE source_domain IS NOT NULL""")
def catalog_metadata(spark, sf):
    return corpus.catalog_metadata(roles.incidents(spark, sf), roles.risks(spark, sf), roles.reports(spark, sf))
