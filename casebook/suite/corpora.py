"""Splits, cleaning, modelling rows and the whole corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, splits
from ..plans.corpus import build_corpus
from ..session import shared_dir
from ..sources import sinks
from . import roles
from .registry import query
from .roles import sql_clean, table

# Orders are incidents and their customer is the group they must stay in.
_RANKED = """g AS (SELECT DISTINCT o_custkey AS component FROM orders),
  k AS (SELECT component, row_number() OVER (ORDER BY md5('42|' || component), component) AS r, count(*) OVER () AS n FROM g)"""
_SPLIT2 = f"{_RANKED}, s AS (SELECT component, CASE WHEN r <= n - ceil(round(n * 0.2, 9)) THEN 'train' ELSE 'test' END AS split FROM k)"
_SPLIT3 = f"""{_RANKED}, h AS (SELECT *, ceil(round(n * (0.15 + 0.15), 9)) AS held FROM k), s AS (SELECT component,
  CASE WHEN r <= n - held THEN 'train' WHEN r <= n - ceil(round(held * (0.15 / (0.15 + 0.15)), 9)) THEN 'val' ELSE 'test' END AS split FROM h)"""


def _groups(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("incident_id"), F.col("o_custkey").alias("component"))


@query(f"WITH {_SPLIT2} SELECT o_orderkey AS incident_id, split FROM orders JOIN s ON component = o_custkey")
def group_split_2way(spark, sf):
    return splits.group_split(_groups(spark, sf), splits.parse_split_spec("80/20"))


@query(f"WITH {_SPLIT3} SELECT o_orderkey AS incident_id, split FROM orders JOIN s ON component = o_custkey")
def group_split_3way(spark, sf):
    return splits.group_split(_groups(spark, sf), splits.parse_split_spec("70/15/15"), min_groups=3)


@query(f"""WITH {_SPLIT2}, tg AS (SELECT DISTINCT component FROM s WHERE split = 'train'),
  tk AS (SELECT component, row_number() OVER (ORDER BY md5('42|' || component), component) AS r, count(*) OVER () AS n FROM tg),
  v AS (SELECT component FROM tk WHERE r > n - ceil(round(n * 0.1, 9)))
  SELECT o_orderkey AS incident_id, CASE WHEN split = 'train' AND o_custkey IN (SELECT component FROM v) THEN 'val' ELSE split END AS split
  FROM orders JOIN s ON component = o_custkey""")
def carve_validation(spark, sf):
    groups = _groups(spark, sf)
    named = splits.group_split(groups, (0.8, 0.0, 0.2))
    return splits.carve_validation(named, groups, 0.1)


@query(f"""WITH {_SPLIT3} SELECT split, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_incidents, count(DISTINCT l_partkey) AS n_reports
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN s ON component = o_custkey GROUP BY 1""")
def split_summary(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("report_id"))
    split_map = splits.group_split(_groups(spark, sf), (0.7, 0.15, 0.15))
    return corpus.split_summary(splits.apply_split(links, split_map).filter("split IS NOT NULL"))


@query(f"""WITH {_SPLIT2} SELECT l_partkey AS report_id, count(DISTINCT split) AS n_splits FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN s ON component = o_custkey GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leak_check(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("report_id"))
    return splits.leaks(splits.apply_split(links, splits.group_split(_groups(spark, sf), (0.8, 0.0, 0.2))), "report_id")


_CLEAN = f"{sql_clean('text')} AS input_text"


@query(f"""WITH c AS (SELECT d.doc_id, source AS incident_id, {_CLEAN} FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id, input_text ORDER BY doc_id) AS r FROM c WHERE length(input_text) >= 40)
  SELECT doc_id, incident_id, input_text FROM r WHERE r = 1""")
def clean_examples(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source").alias("incident_id"), F.col("text").alias("input_text"), "quality", "toxic"
    )
    kept = corpus.clean_examples(docs, 40, ["quality", "toxic"], ["doc_id"])
    return kept.select("doc_id", "incident_id", "input_text")


@query(f"""WITH c AS (SELECT d.doc_id, source AS incident_id, {_CLEAN}, lang AS target_label FROM documents d),
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id, input_text, target_label ORDER BY doc_id) AS r FROM c WHERE length(input_text) >= 40)
  SELECT doc_id, target_label, length(input_text) AS n FROM r WHERE r = 1""")
def modeling_frame(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("incident_id"), F.col("text").alias("input_text"), F.concat("lang", F.lit(" | "), "source").alias("raw")
    )
    frame = corpus.modeling_frame(docs, "raw", "first", 40, ["doc_id"])
    return frame.select("doc_id", "target_label", F.length("input_text").cast("long").alias("n"))


@query(f"""WITH c AS (SELECT doc_id, source AS incident_id, {_CLEAN} FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id, input_text ORDER BY doc_id) AS r FROM c WHERE length(input_text) >= 80)
  SELECT doc_id, incident_id, length(input_text) AS n FROM r WHERE r = 1""")
def cluster_input(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("incident_id"), F.col("text").alias("input_text"))
    kept = corpus.cluster_input(docs, order=["doc_id"])
    return kept.select("doc_id", "incident_id", F.length("input_text").cast("long").alias("n"))


@query("""WITH m AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT source FROM documents))
  SELECT doc_id, label FROM documents JOIN m USING (source)""")
def encode_labels(spark, sf):
    return corpus.encode_labels(table(spark, sf, "documents"), "source")[0].select("doc_id", "label")


@query(f"""WITH c AS (SELECT doc_id, md5(text) AS report_id, {_CLEAN}, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY md5(text)) AS component,
    source || ' ' || lang AS title, lang, source FROM documents),
  t AS (SELECT *, 'Incident title: ' || title || ' Report text: ' || input_text || ' Source domain: Unknown' AS full_text FROM c WHERE input_text <> ''),
  g AS (SELECT DISTINCT component FROM c),
  k AS (SELECT component, row_number() OVER (ORDER BY md5('42|' || component), component) AS r, count(*) OVER () AS n FROM g),
  s AS (SELECT component, CASE WHEN r <= n - ceil(round(n * 0.2, 9)) THEN 'train' ELSE 'test' END AS split FROM k)
  SELECT CAST(doc_id AS VARCHAR) AS incident_id, report_id, split, lang AS csetv1_sector_of_deployment, full_text AS input_text
  FROM t JOIN s USING (component) WHERE length(full_text) >= 40""")
def build_text_corpus(spark, sf):
    """Documents as incidents, their distinct texts as reports, language as label."""
    docs = table(spark, sf, "documents")
    incidents = docs.select(
        F.col("doc_id").cast("string").alias("incident_id"), F.concat("source", F.lit(" "), "lang").alias("incident_title"),
        F.lit("").alias("incident_description"), F.array(F.md5("text")).alias("incident_report_ids"),
    )
    reports = docs.groupBy(F.md5("text").alias("report_id")).agg(F.min("text").alias("report_text")).select(
        "report_id", F.lit("").alias("direct_incident_id"), F.lit("").alias("report_title"),
        text.normalize_text("report_text").alias("report_text"), F.lit("").alias("report_url"), F.lit("Unknown").alias("source_domain"),
    )
    labels = {"classifications_CSETv1": docs.select(F.col("doc_id").alias("incident_id"), F.col("lang").alias("sector_of_deployment"))}
    built = build_corpus(incidents, reports, labels)
    return built.classification_ready.select("incident_id", "report_id", "split", "csetv1_sector_of_deployment", "input_text")


@query(f"WITH {_SPLIT2} SELECT o_orderkey AS incident_id, split FROM orders JOIN s ON component = o_custkey WHERE split = 'test'")
def sink_by_split(spark, sf):
    """Write the split corpus and read one split back."""
    named = splits.group_split(_groups(spark, sf), (0.8, 0.0, 0.2))
    path = f"{shared_dir(spark)}/sinks/{uuid.uuid4().hex}"
    sinks.write_by_split(named, path)
    return sinks.read_split(spark, path, "test").select("incident_id", "split")
