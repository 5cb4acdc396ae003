"""The test tables in the roles of incidents, reports, links, labels and places.

Orders are incidents, parts are reports and line items are the links between
them. Every function reads a whole table. The SQL strings are the same roles
as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Context


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, as it is split by the reader."""
    return table(spark, sf_dir, name)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; low-priority pending ones have no known year."""
    title = F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string"))
    description = F.concat(
        F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" status "), F.col("o_orderstatus")
    )
    undated = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        title.alias("incident_title"),
        description.alias("incident_description"),
        F.when(~undated, F.year("o_orderdate")).alias("incident_year"),
        F.concat(title, F.lit(" "), description).alias("search_text"),
    )


INCIDENTS = """inc AS (
  SELECT o_orderkey AS incident_id, o_orderpriority || ' order ' || o_orderkey AS incident_title,
         'Customer ' || o_custkey || ' status ' || o_orderstatus AS incident_description,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
              ELSE CAST(year(o_orderdate) AS INTEGER) END AS incident_year,
         o_orderpriority || ' order ' || o_orderkey || ' Customer ' || o_custkey || ' status ' || o_orderstatus
           AS search_text
  FROM orders)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts; one brand has no known source."""
    domain = F.nullif("p_brand", F.lit("Brand#25"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("report_id"),
        F.col("p_name").alias("report_title"),
        F.concat("p_type", F.lit(" "), F.col("p_name")).alias("report_text"),
        F.concat(F.lit("https://parts.example/"), F.col("p_partkey").cast("string")).alias("report_url"),
        domain.alias("source_domain"),
    )


REPORTS = """rep AS (
  SELECT p_partkey AS report_id, p_name AS report_title, p_type || ' ' || p_name AS report_text,
         'https://parts.example/' || p_partkey AS report_url, nullif(p_brand, 'Brand#25') AS source_domain
  FROM part)"""


def bare_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without the report columns, for views that only count them."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"),
        F.col("l_partkey").alias("report_id"),
        F.year("l_shipdate").alias("report_year"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare_links(spark, sf_dir).join(reports(spark, sf_dir), "report_id", "left")


LINKS = REPORTS + """, lnk AS (
  SELECT l_orderkey AS incident_id, l_partkey AS report_id, CAST(year(l_shipdate) AS INTEGER) AS report_year,
         report_title, report_url, source_domain
  FROM lineitem LEFT JOIN rep ON report_id = l_partkey)"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels per incident: its priority and its status."""
    orders = table(spark, sf_dir, "orders")
    labels = F.array(
        F.struct(F.lit("PRIORITY").alias("taxonomy_source"), F.col("o_orderpriority").alias("risk_category"), F.col("o_orderstatus").alias("secondary_label")),
        F.struct(F.lit("STATUS").alias("taxonomy_source"), F.concat(F.lit("Status "), "o_orderstatus").alias("risk_category"), F.lit("").alias("secondary_label")),
    )
    return orders.select(F.col("o_orderkey").alias("incident_id"), F.explode(labels).alias("r")).select("incident_id", "r.*")


RISKS = """rsk AS (
  SELECT o_orderkey AS incident_id, 'PRIORITY' AS taxonomy_source, o_orderpriority AS risk_category,
         o_orderstatus AS secondary_label FROM orders
  UNION ALL
  SELECT o_orderkey, 'STATUS', 'Status ' || o_orderstatus, '' FROM orders)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and market segment of the customer; some of each are unknown."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("incident_id"),
            F.nullif("n_name", F.lit("NATION_3")).alias("country"),
            F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("location_label"),
        )
    )


LOCATIONS = """loc AS (
  SELECT o_orderkey AS incident_id, nullif(n_name, 'NATION_3') AS country,
         nullif(c_mktsegment, 'MACHINERY') AS location_label
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(*[f(spark, sf_dir) for f in (incidents, links, risks, locations)])


ATTENTION = f"""{INCIDENTS}, {LINKS}, att AS (
  SELECT inc.incident_id, incident_title, incident_year, incident_description, coalesce(n, 0) AS report_count
  FROM inc LEFT JOIN (SELECT incident_id, count(DISTINCT report_id) AS n FROM lnk GROUP BY 1) c
    ON inc.incident_id = c.incident_id)"""

# Whitespace as the text functions see it, for DuckDB's regular expressions.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85\x00]+"


def sql_clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{SPACE}', ' ', 'g'))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clustered records: the language is the cluster."""
    docs = texts(spark, sf_dir)
    quality = table(spark, sf_dir, "labels")
    return docs.join(quality, "doc_id", "left").select(
        F.col("doc_id"),
        F.md5("text").alias("incident_id"),
        F.concat(F.col("source"), F.lit(" in "), F.col("lang")).alias("incident_title"),
        F.col("text").alias("input_text"),
        F.col("source").alias("source_domain"),
        F.instr(F.lit("de en es fr"), F.col("lang")).alias("cluster_label"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("mit_risk_domain"),
        F.concat_ws(" | ", "source", "lang").alias("gmf_known_ai_technical_failure"),
        F.col("lang").alias("csetv1_sector_of_deployment"),
        (F.col("n_chars") % 100 + 1950).cast("string").alias("incident_year"),
    )


RECORDS = """rec AS (
  SELECT d.doc_id, md5(text) AS incident_id, source || ' in ' || lang AS incident_title, text AS input_text,
         source AS source_domain, CAST(instr('de en es fr', lang) AS INTEGER) AS cluster_label,
         'quality ' || quality AS mit_risk_domain, source || ' | ' || lang AS gmf_known_ai_technical_failure,
         lang AS csetv1_sector_of_deployment, CAST(n_chars % 100 + 1950 AS VARCHAR) AS incident_year
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
METADATA = {
    "risk_category": "mit_risk_domain", "sector": "csetv1_sector_of_deployment",
    "failure_type": "gmf_known_ai_technical_failure", "source_domain": "source_domain",
}
META_VALUES = """vals AS (
  SELECT 'risk_category' AS metadata_type, 'mit_risk_domain' AS metadata_column, cluster_label, mit_risk_domain AS value FROM rec WHERE mit_risk_domain IS NOT NULL
  UNION ALL SELECT 'sector', 'csetv1_sector_of_deployment', cluster_label, csetv1_sector_of_deployment FROM rec
  UNION ALL SELECT 'failure_type', 'gmf_known_ai_technical_failure', cluster_label, unnest(string_split(gmf_known_ai_technical_failure, ' | ')) FROM rec
  UNION ALL SELECT 'source_domain', 'source_domain', cluster_label, source_domain FROM rec)"""
