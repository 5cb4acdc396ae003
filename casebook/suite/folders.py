"""Tables that are written, found in a folder and read back: CSV datasets, split corpora, cluster results and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, features, models
from ..plans import clustering
from ..session import shared_dir
from ..sources import catalog, names, sinks
from . import roles
from .learned import _settings
from .registry import query
from .roles import sql_clean, table
from .texts import stop_words


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/folders/{name}-{uuid.uuid4().hex}"


def _folder(spark, sf) -> str:
    """Documents, nations and customers as CSV datasets with headers as people type them."""
    folder = _fresh(spark, "csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias(" Ref Number"), F.col("text").alias("Text"), F.col("source").alias("Source-Domain"), F.col("lang").alias("text "))
    sinks.write_csv(docs, f"{folder}/reports.csv")
    sinks.write_csv(table(spark, sf, "customer").select(F.col("c_custkey").alias("Incident ID"), F.col("c_mktsegment").alias("Risk Domain")), f"{folder}/classifications_MIT.csv")
    sinks.write_csv(table(spark, sf, "nation").select(F.col("n_nationkey").alias("Incident ID"), F.col("n_name").alias("Country")), f"{folder}/classifications_CSETv1.csv")
    return folder


@query("""SELECT 'reports' AS table_name, count(*) AS n_rows, CAST(4 AS INTEGER) AS n_columns, 'ref_number,text,source_domain,text_2' AS headers FROM documents
  UNION ALL SELECT 'classifications_MIT', count(*), 2, 'incident_id,risk_domain' FROM customer
  UNION ALL SELECT 'classifications_CSETv1', count(*), 2, 'incident_id,country' FROM nation""")
def csv_folder(spark, sf):
    """Datasets found in a folder, with their rows and their headers after normalising."""
    tables = catalog.load_folder(spark, _folder(spark, sf)).tables
    headers = F.create_map(*(F.lit(x) for name, df in tables.items() for x in (name, ",".join(df.columns))))
    return catalog.table_profile(tables).select("table_name", "n_rows", "n_columns", headers[F.col("table_name")].alias("headers"))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, md5(text) AS text_md5, length(text) AS n_chars, source AS source_domain FROM documents")
def csv_round_trip(spark, sf):
    """Whole texts with quotes, commas and line breaks, and columns found by their meaning."""
    reports = catalog.load_folder(spark, _folder(spark, sf)).get("reports")
    key, body, domain = (names.require_column(reports.columns, c, "reports", m) for c, m in ((names.REPORT_ID, "key"), (names.TEXT, "text"), (names.DOMAIN, "source")))
    return reports.select(F.col(key).alias("report_id"), F.md5(body).alias("text_md5"), F.length(body).cast("long").alias("n_chars"), F.col(domain).alias("source_domain"))


@query("""SELECT 'mit' AS taxonomy, CAST(c_custkey AS VARCHAR) AS incident_id, c_mktsegment AS label FROM customer
  UNION ALL SELECT 'csetv1', CAST(n_nationkey AS VARCHAR), n_name FROM nation""")
def csv_taxonomies(spark, sf):
    """Labels of all classification datasets of a folder, named by their source."""
    found = catalog.load_folder(spark, _folder(spark, sf)).taxonomies()
    parts = [df.toDF("incident_id", "label").select(F.lit(names.taxonomy_name(name)).alias("taxonomy"), "incident_id", "label") for name, df in found.items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT 'customers' AS name, record FROM (
    SELECT c_custkey || ',' || c_name || CASE WHEN c_custkey % 5 = 0 THEN ',' || c_nationkey || ',extra' ELSE '' END AS record, c_custkey FROM customer)
  WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0""")
def csv_bad_records(spark, sf):
    """Records with a cell too many or too few, as rows."""
    folder = _fresh(spark, "bad")
    cells = [F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.expr("c_custkey % 5 = 0 OR c_custkey % 7 <> 0"), F.col("c_nationkey").cast("string"))]
    lines = F.concat_ws(",", *cells, F.when(F.expr("c_custkey % 5 = 0"), "extra"))
    # one column whose header and values hold the commas, apart by tabs, of which there are none
    table(spark, sf, "customer").select(lines.alias("Customer ID,Name,Nation")).write.options(header=True, sep="\t").csv(f"{folder}/customers.csv")
    sinks.write_csv(table(spark, sf, "nation"), f"{folder}/nations.csv")
    return catalog.load_folder(spark, folder).bad_records(spark).select("name", "record")


@query("SELECT doc_id, true AS same_label, true AS same_score, true AS same_ranking FROM documents")
def reload_classifier(spark, sf):
    """Predictions of a classifier against those after it was saved and read by another session."""
    words = features.stored_words(table(spark, sf, "documents"), "text", _settings(), "doc_id", "lang")
    tfidf = features.fit_tfidf(words, "words", _settings())
    stored = tfidf.vector_table(tfidf.transform(words, "words").select("doc_id", "lang", "term_ids", "weights"))
    fitted = models.train_classifier(stored, tfidf, "lang")
    folder = _fresh(spark, "classifier")
    fitted.save(spark, folder)
    back = models.TextClassifier.load(spark.newSession(), folder)
    texts = table(spark, sf, "documents").select("doc_id", "text")
    before = fitted.predict_text(texts, "text", 3).select("doc_id", F.col("predicted_label").alias("a"), F.col("predicted_confidence").alias("p"), F.col("top_predictions").alias("s"))
    after = back.predict_text(texts, "text", 3).select("doc_id", "predicted_label", "predicted_confidence", "top_predictions")
    return before.join(after, "doc_id").select(
        "doc_id", F.equal_null("a", "predicted_label").alias("same_label"), (F.abs(F.col("p") - F.col("predicted_confidence")) < 1e-9).alias("same_score"),
        (F.col("s")["label"] == F.col("top_predictions")["label"]).alias("same_ranking"),
    )


def _clustered(spark, sf) -> clustering.ClusterOutputs:
    return clustering.cluster_texts(
        roles.records(spark, sf).drop("cluster_label"), order=["doc_id"], n_clusters=6, n_components=8, stop_words=list(stop_words()),
        max_features=2000, keyword_features=2000,
    )


@query("""SELECT unnest(['cluster_keywords', 'cluster_metadata_distribution', 'cluster_summary', 'cluster_year_distribution', 'clustered_records']) AS table_name,
  CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, true AS any_rows""")
def reload_clusters(spark, sf):
    """Rows of each cluster table that are lost or added when it is saved and loaded."""
    saved = _clustered(spark, sf)
    folder = _fresh(spark, "clusters")
    clustering.save_clusters(saved, folder, {"n_clusters": 6})
    loaded = clustering.load_clusters(spark.newSession(), folder).tables()
    return _changes(saved.tables(), loaded)


def _changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows lost and added by table, told by a hash of the whole row and counted on the map side."""
    out = None
    for name, df in before.items():
        sides = [x.select(F.xxhash64(*(F.col(c) for c in sorted(df.columns))).alias("row"), F.lit(side).alias("side")) for x, side in ((df, 1), (after[name], -1))]
        net = sides[0].unionByName(sides[1]).groupBy("row").agg(F.sum("side").alias("net"))
        sums = net.agg(
            F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("added"),
            (F.count(F.lit(1)) > 0).alias("any_rows"),
        ).select(F.lit(name).alias("table_name"), "lost", "added", "any_rows")
        out = sums if out is None else out.unionByName(sums)
    return out


_CLEAN = f"""c AS (SELECT doc_id, source AS incident_id, {sql_clean('text')} AS input_text FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id, input_text ORDER BY doc_id) AS r FROM c WHERE length(input_text) >= 80)"""


@query(f"WITH {_CLEAN} SELECT doc_id, length(input_text) AS n_chars FROM r WHERE r = 1")
def sink_tables(spark, sf):
    """A cleaned corpus written as a named table and read back."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("incident_id"), F.col("text").alias("input_text"))
    folder = _fresh(spark, "tables")
    sinks.write_tables({"cluster_input": corpus.cluster_input(docs, order=["doc_id"])}, folder)
    return spark.newSession().read.parquet(f"{folder}/cluster_input").select("doc_id", F.length("input_text").cast("long").alias("n_chars"))
