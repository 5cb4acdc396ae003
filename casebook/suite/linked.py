"""Canonical tables, joins between them, taxonomy labels and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, links, prepare, splits, taxonomy, trends
from . import roles
from .registry import query
from .roles import INCIDENTS, LINKS, RISKS, sql_clean, table


def _raw_incidents(spark, sf) -> DataFrame:
    """Orders under the headers of a loosely structured incident table."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("incident_id"),
        F.concat("o_orderpriority", F.lit(" order")).alias("title"),
        F.col("o_orderstatus").alias("description"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"),
        F.format_string("[%d, %d]", "o_custkey", "o_orderkey").alias("reports"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, o_orderpriority || ' order' AS incident_title, o_orderstatus AS incident_description,
  strftime(o_orderdate, '%Y-%m-%d') AS incident_date, CAST(year(o_orderdate) AS INTEGER) AS incident_year, CAST(2 AS INTEGER) AS report_count,
  o_orderpriority || ' order ' || o_orderstatus AS search_text FROM orders""")
def prepare_incidents(spark, sf):
    df = prepare.incidents(_raw_incidents(spark, sf))
    return df.select(
        "incident_id", "incident_title", "incident_description", F.date_format("incident_date", "yyyy-MM-dd").alias("incident_date"),
        "incident_year", "report_count", "search_text",
    )


@query(f"""SELECT CAST(page_id AS VARCHAR) AS report_id, {sql_clean("regexp_extract(html, '<title>([^<]*)', 1)")} AS report_title,
  {sql_clean('html')} AS report_text, regexp_replace(regexp_extract(lower({sql_clean('url')}), '://([^/?#]*)', 1), '^www\\.', '') AS source_domain,
  CAST(NULL AS INTEGER) AS report_year FROM pages""")
def prepare_reports(spark, sf):
    raw = table(spark, sf, "pages").select(
        F.col("page_id").alias("report_number"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
        F.col("html").alias("text"), "url",
    )
    return prepare.corpus_reports(raw).select("report_id", "report_title", "report_text", "source_domain", "report_year")


@query("""WITH l AS (SELECT l_orderkey, unnest([l_partkey, l_suppkey + 1000000000]) AS report_id FROM lineitem)
  SELECT CAST(l_orderkey AS VARCHAR) AS incident_id, CAST(report_id AS VARCHAR) AS report_id, p_name AS report_title, p_brand AS source_domain
  FROM l LEFT JOIN part ON p_partkey = report_id""")
def incident_reports(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"), F.lit("Order").alias("title"),
        F.format_string("['%d', \"%d\"]", "l_partkey", F.col("l_suppkey") + 1_000_000_000).alias("linked_reports"),
    )
    reports = prepare.reports(table(spark, sf, "part").select(
        F.col("p_partkey").alias("report_number"), F.col("p_name").alias("title"), F.col("p_brand").alias("source_domain")
    ))
    out = links.incident_reports(prepare.incidents(raw), reports)
    return out.select("incident_id", "report_id", "report_title", "source_domain")


def _customers(spark, sf) -> DataFrame:
    return prepare.corpus_incidents(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("incident_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("description"),
        F.format_string("%d, %d", "c_custkey", "c_nationkey").alias("report_ids"),
    ))


@query("""WITH l AS (SELECT c_custkey, c_name, unnest([c_custkey, c_nationkey]) AS report_id FROM customer)
  SELECT CAST(c_custkey AS VARCHAR) AS incident_id, c_name AS incident_title, CAST(report_id AS VARCHAR) AS report_id, p_name AS report_title
  FROM l JOIN part ON p_partkey = report_id""")
def report_level_links(spark, sf):
    reports = prepare.corpus_reports(table(spark, sf, "part").select(
        F.col("p_partkey").alias("report_number"), F.col("p_name").alias("title")
    ))
    return links.report_level(reports, _customers(spark, sf)).select("incident_id", "incident_title", "report_id", "report_title")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS incident_id, c_name AS incident_title, CAST(o_orderkey AS VARCHAR) AS report_id, o_orderpriority AS report_title
  FROM orders JOIN customer ON c_custkey = o_custkey""")
def report_level_direct(spark, sf):
    reports = prepare.corpus_reports(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("report_number"), F.col("o_custkey").alias("incident_id"), F.col("o_orderpriority").alias("title")
    ))
    return links.report_level(reports, _customers(spark, sf)).select("incident_id", "incident_title", "report_id", "report_title")


# --- taxonomies ----------------------------------------------------------------

def _taxonomies(spark, sf) -> dict[str, DataFrame]:
    """Orders and parts as classification tables of several kinds."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    return {
        "classifications_CSETv1": orders.select(
            F.col("o_orderkey").alias("incident_id"), F.nullif("o_orderstatus", F.lit("O")).alias("harm_domain"),
            F.col("o_orderpriority").alias("sector_of_deployment"), F.lit("long notes").alias("harm_notes"),
        ),
        "classifications_GMF": part.select(
            F.col("p_partkey").alias("incident_id"), F.concat("p_type", F.lit(", "), "p_brand", F.lit(", ")).alias("known_ai_technical_failure"),
            F.col("p_name").alias("known_ai_technology"),
        ),
        "classifications_other_list": part.select(
            F.col("p_partkey").alias("incident_id"), F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.col("p_brand")).alias("category"),
        ),
    }


_LONG = """SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, 'CSETv1' AS taxonomy_source, o_orderstatus AS risk_category, o_orderpriority AS secondary_label
    FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'GMF', unnest([p_type, p_brand]), p_name FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'other list', p_brand, '' FROM part WHERE p_size <= 25"""


@query(_LONG)
def risk_long_union(spark, sf):
    return taxonomy.risk_long(_taxonomies(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS incident_id, 'GMF' AS taxonomy_source, unnest([p_type, p_brand]) AS risk_category, p_name AS secondary_label FROM part")
def taxonomy_long(spark, sf):
    return taxonomy.taxonomy_long("classifications_GMF", _taxonomies(spark, sf)["classifications_GMF"])


def _place_tables(spark, sf) -> dict[str, DataFrame]:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    country = F.when(F.col("c_nationkey") > 20, F.lit("")).otherwise(F.col("c_nationkey").cast("string"))
    city = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    return {
        "classifications_A": joined.select(F.col("o_custkey").alias("incident_id"), country.alias("country"), city.alias("location_city")),
        "classifications_B": customer.select(F.col("c_custkey").alias("incident_id"), country.alias("country"), city.alias("location_city")),
    }


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_nationkey <= 20 THEN CAST(c_nationkey AS VARCHAR) END AS country, nullif(c_mktsegment, 'MACHINERY') AS city FROM customer)
  SELECT CAST(c_custkey AS VARCHAR) AS incident_id, country, city AS location_label,
    CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'classifications_A' ELSE 'classifications_B' END AS location_source
  FROM p WHERE country IS NOT NULL OR city IS NOT NULL""")
def locations(spark, sf):
    return taxonomy.locations(_place_tables(spark, sf))


# --- label aggregation -----------------------------------------------------------

def _label_rows(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("supplier"),
        F.when(F.col("l_returnflag") == "N", F.lit("n/a")).otherwise(F.col("l_returnflag")).alias("flag"),
        F.format_string("['%s', '%s', 'none']", F.col("l_linestatus"), F.lower("l_returnflag")).alias("listed"),
    )


def _sorted_sql(value: str, source: str) -> str:
    return f"SELECT l_suppkey AS supplier, string_agg(v, ' | ' ORDER BY lower(v), v) AS {value} FROM (SELECT DISTINCT l_suppkey, v FROM ({source})) GROUP BY 1"


_FLAGS = _sorted_sql("flag", "SELECT l_suppkey, l_returnflag AS v FROM lineitem WHERE l_returnflag <> 'N'")
_LISTED = _sorted_sql("listed", "SELECT l_suppkey, unnest([l_linestatus, lower(l_returnflag)]) AS v FROM lineitem")


@query(f"WITH f AS ({_FLAGS}), l AS ({_LISTED}) SELECT l.supplier, flag, listed FROM l LEFT JOIN f ON f.supplier = l.supplier")
def label_frame(spark, sf):
    return taxonomy.label_frame(_label_rows(spark, sf), "supplier", ["flag", "listed"])


@query(_LISTED)
def collapse_values(spark, sf):
    return taxonomy.label_frame(_label_rows(spark, sf), "supplier", ["listed"])


@query("""WITH a AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) AS status FROM orders GROUP BY 1),
  b AS (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer), c AS (SELECT p_partkey AS k, p_brand AS brand FROM part)
  SELECT k, status, segment, brand FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def merge_labels_outer(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"))
    return taxonomy.merge_label_frames([taxonomy.label_frame(orders, "k", ["status"]), customer, part], "k")


@query("""WITH a AS (SELECT o_orderkey AS k, nullif(o_orderstatus, 'O') AS h, o_orderpriority AS s FROM orders),
  g AS (SELECT p_partkey AS k, p_name AS t FROM part)
  SELECT CAST(k AS VARCHAR) AS incident_id, h AS csetv1_harm_domain, s AS csetv1_sector_of_deployment, f AS gmf_known_ai_technical_failure,
    t AS gmf_known_ai_technology
  FROM a FULL JOIN (SELECT *, (SELECT p_type || ', ' || p_brand || ',' FROM part p WHERE p.p_partkey = g.k) AS f FROM g) g USING (k)""")
def classification_labels(spark, sf):
    incident_labels, _, _ = taxonomy.classification_labels(_taxonomies(spark, sf))
    return incident_labels


_STATS = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "CAST(p_size AS VARCHAR)", "p_partkey": "CAST(p_partkey AS VARCHAR)", "p_retailprice": "CAST(p_retailprice AS VARCHAR)"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*)::BIGINT AS n_values, count(DISTINCT {e}) AS n_distinct,
  round(count(DISTINCT {e}) / count(*), 6) AS distinct_ratio, round(sum(length({e})) / count(*), 6) AS mean_length,
  count(DISTINCT {e}) <= 600 AND count(DISTINCT {e}) / count(*) <= 0.85 AND avg(length({e})) <= 160 AS kept FROM part""" for c, e in _STATS.items()))
def label_column_stats(spark, sf):
    part = table(spark, sf, "part")
    stats = taxonomy.value_statistics(part, list(_STATS))
    kept = taxonomy.categorical_columns(part, list(_STATS))  # by sketches, where they are clear
    return stats.withColumn("kept", F.col("column").isin(kept)).withColumns(
        {c: F.round(c, 6) for c in ("distinct_ratio", "mean_length")}
    )


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM part HAVING count(DISTINCT {e}) <= 100" for c, e in _STATS.items()))
def candidate_labels(spark, sf):
    part = table(spark, sf, "part").select(*_STATS)
    found = taxonomy.candidate_labels(part, [])
    # The statistics decide which columns stay; they are listed once each.
    stats = taxonomy.value_statistics(part, found)
    return stats.select("column")


@query(f"""WITH {INCIDENTS}, {RISKS}, {LINKS}, f AS (SELECT incident_id, string_agg(DISTINCT risk_category, ' | ' ORDER BY risk_category) AS risk_category FROM rsk GROUP BY 1)
  SELECT l.incident_id, report_id, report_year, risk_category FROM lnk l LEFT JOIN f ON f.incident_id = l.incident_id""")
def report_labels(spark, sf):
    frame = taxonomy.label_frame(roles.risks(spark, sf), "incident_id", ["risk_category"])
    rows = roles.links(spark, sf).select("incident_id", "report_id", "report_year")
    return rows.join(frame, "incident_id", "left")


@query(f"""WITH {INCIDENTS}, {LINKS}, d AS (SELECT incident_id, string_agg(DISTINCT source_domain, ' | ' ORDER BY lower(source_domain), source_domain) AS source_domains FROM lnk GROUP BY 1),
  t AS (SELECT incident_id, string_agg(DISTINCT report_title, ' | ' ORDER BY lower(report_title), report_title) AS titles, count(DISTINCT report_id) AS n FROM lnk GROUP BY 1)
  SELECT i.incident_id, coalesce(n, 0) AS joined_report_count, coalesce(source_domains, '') AS source_domains, coalesce(titles, '') AS linked_report_titles,
    'Incident title: ' || incident_title || ' Incident description: ' || incident_description
      || CASE WHEN coalesce(titles, '') <> '' THEN ' Report titles: ' || titles ELSE '' END
      || CASE WHEN coalesce(source_domains, '') <> '' THEN ' Source domains: ' || source_domains ELSE '' END AS input_text
  FROM inc i LEFT JOIN d ON d.incident_id = i.incident_id LEFT JOIN t ON t.incident_id = i.incident_id""")
def incident_level(spark, sf):
    out = corpus.incident_level(roles.incidents(spark, sf), roles.links(spark, sf))
    return out.select("incident_id", "joined_report_count", "source_domains", "linked_report_titles", "input_text")


@query(f"""WITH {INCIDENTS}, {LINKS}, {RISKS} SELECT 'incidents' AS level, count(*) AS n_rows FROM inc UNION ALL SELECT 'reports', count(*) FROM rep
  UNION ALL SELECT 'links', count(*) FROM lnk UNION ALL SELECT 'labels', count(*) FROM rsk""")
def join_level_counts(spark, sf):
    return trends.count_rows({
        "incidents": roles.incidents(spark, sf), "reports": roles.reports(spark, sf),
        "links": roles.links(spark, sf), "labels": roles.risks(spark, sf),
    })


# --- set operations and duplicates -------------------------------------------------

@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def leak_intersect(spark, sf):
    orders = table(spark, sf, "orders").withColumn("key", F.col("o_custkey"))
    return splits.overlap(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), "key")


@query("SELECT c_nationkey AS label FROM customer WHERE c_mktsegment = 'MACHINERY' EXCEPT SELECT s_nationkey FROM supplier")
def unseen_classes(spark, sf):
    test = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("label"))
    train = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("label"))
    return splits.unseen_classes(train, test, "label")


@query("""WITH RECURSIVE d AS (SELECT c_custkey AS src, CAST(c_custkey // 3 AS BIGINT) AS dst FROM customer WHERE c_mktsegment = 'FURNITURE'),
  r AS (SELECT o_orderkey, o_custkey AS cur FROM orders UNION ALL SELECT o_orderkey, dst FROM r JOIN d ON src = cur AND src <> dst)
  SELECT o_orderkey, CAST(min(cur) AS VARCHAR) AS incident_id FROM r GROUP BY 1""")
def resolve_duplicates(spark, sf):
    pairs = table(spark, sf, "customer").filter("c_mktsegment = 'FURNITURE' AND c_custkey > 0").select(
        F.col("c_custkey").alias("duplicate_incident_number"), F.floor(F.col("c_custkey") / 3).alias("true_incident_number")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("incident_id"))
    return prepare.resolve_duplicates(orders, pairs)
