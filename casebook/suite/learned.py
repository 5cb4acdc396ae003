"""Queries that fit models. Results depend on optimisers, so most have no SQL equivalent."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, models
from ..plans import clustering, scoring, training
from ..session import written_table
from . import roles
from .registry import query
from .roles import table, texts
from .texts import _terms_sql, _vocab_sql, _weights_sql, near_sql, stop_words

N_COMPONENTS = 16
N_SMALL = 12
_PAIRS_OF_WORDS = "list_concat(w,\n      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def _labelled(spark, sf) -> DataFrame:
    docs = texts(spark, sf)
    return docs.select(
        F.md5("text").alias("incident_id"), F.md5("text").alias("report_id"), F.col("text").alias("input_text"),
        F.col("lang").alias("target"), "doc_id",
    )


def _settings() -> features.TermSettings:
    return features.TermSettings(stop_words=stop_words(), min_df=2, max_df=0.95, max_features=5000, sublinear=True)


@query()
def train_text_classifier(spark, sf):
    """Language classifier: one row per class with its intercept."""
    words = features.stored_words(texts(spark, sf), "text", _settings(), "doc_id", "lang")
    tfidf = features.fit_tfidf(words, "words", _settings())
    weights = tfidf.transform(words, "words").select("lang", "term_ids", "weights")
    fitted = models.train_classifier(tfidf.vector_table(weights), tfidf, "lang")
    rows = [(name, float(b)) for name, b in zip(fitted.labels, fitted.model.interceptVector)]
    return spark.createDataFrame(rows, "label string, intercept double")


@query()
def predict_topk(spark, sf):
    """Top three languages of every document, in and out of the training rows."""
    words = features.stored_words(texts(spark, sf), "text", _settings(), "doc_id", "lang")
    tfidf = features.fit_tfidf(words, "words", _settings())
    stored = tfidf.vector_table(tfidf.transform(words, "words").select("doc_id", "lang", "term_ids", "weights"))
    fitted = models.train_classifier(stored, tfidf, "lang")
    return fitted.predict(stored, 3).select(
        "doc_id", "predicted_label", "predicted_confidence", F.explode("top_predictions").alias("p")
    ).select("doc_id", "predicted_label", "predicted_confidence", F.col("p.label").alias("label"), F.col("p.score").alias("score"))


@query()
def train_evaluate(spark, sf):
    """Train on one part of the documents, evaluate on the other."""
    result = training.train_evaluate(_labelled(spark, sf), "target", settings=_settings(), order=["doc_id"])
    return result.predictions.select("doc_id", "target_label", "predicted_label", "predicted_confidence", "top_3_predictions")


@query(f"""WITH {_terms_sql('d', 'doc_id', 'documents').replace(_PAIRS_OF_WORDS, 'w')}, {_vocab_sql('d_t', 'documents', 2, 0.95, 5000)}
  SELECT doc_id, CAST({N_COMPONENTS} AS INTEGER) AS n_dims, CASE WHEN doc_id IN (SELECT doc_id FROM d_t JOIN vocab USING (term)) THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents""")
def svd_embeddings(spark, sf):
    """Size and length of the embedding of every document: 1, or 0 without any term."""
    words = features.stored_words(texts(spark, sf), "text", _settings(), "doc_id")
    tfidf = features.fit_tfidf(words, "words", _settings())
    weights = written_table(tfidf.transform(words, "words").select("doc_id", "term_ids", "weights"))
    out = models.svd_embeddings(weights, len(tfidf.terms), N_COMPONENTS)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return out.select("doc_id", F.size("embedding").alias("n_dims"), F.round(F.sqrt(squares), 4).alias("length"))


def _energy_sql(k: int) -> str:
    """Leading eigenvalues of the Gram matrix: repeated squaring leaves the first direction, which is then taken out."""
    parts = [f"""g0 AS MATERIALIZED (SELECT list(r ORDER BY a) AS m FROM (SELECT a.term AS a, list(coalesce(v, 0.0) ORDER BY b.term) AS r FROM vocab a CROSS JOIN vocab b
      LEFT JOIN (SELECT p.term AS a, q.term AS b, sum(p.weight * q.weight) AS v FROM x p JOIN x q USING (doc_id) GROUP BY 1, 2) c ON c.a = a.term AND c.b = b.term GROUP BY 1))"""]
    for i in range(k):
        parts.append(f"""p{i} AS (SELECT 0 AS step, m FROM g{i} UNION ALL SELECT step + 1, list_transform(s, lambda r: list_transform(r, lambda y: y / t)) FROM (
      SELECT step, s, list_sum(list_transform(range(1, len(s) + 1), lambda j: s[j][j])) AS t FROM (
        SELECT step, list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c))) AS s FROM p{i} WHERE step < 24))),
    d{i} AS (SELECT list_transform(c, lambda y: y / sqrt(list_inner_product(c, c))) AS v FROM (SELECT list_extract(list_sort(list_transform(m, lambda r: {{'n': list_inner_product(r, r), 'r': r}}), 'DESC'), 1)['r'] AS c FROM p{i} WHERE step = 24)),
    e{i} AS MATERIALIZED (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS energy FROM g{i}, d{i}),
    g{i + 1} AS MATERIALIZED (SELECT list_transform(range(1, len(v) + 1), lambda a: list_transform(range(1, len(v) + 1), lambda b: m[a][b] - energy * v[a] * v[b])) AS m FROM g{i}, e{i})""")
    return ",\n    ".join(parts)


@query(f"""WITH RECURSIVE {_terms_sql('d', 'doc_id', 'documents').replace(_PAIRS_OF_WORDS, 'w')}, {_vocab_sql('d_t', 'documents', 2, 0.95, N_SMALL)}, {_weights_sql('x', 'doc_id', 'd_t')},
    {_energy_sql(3)}
  {' UNION ALL '.join(f'SELECT CAST({i + 1} AS INTEGER) AS direction, round(energy, 4) AS energy, round(energy, 4) AS captured, true AS orthonormal FROM e{i}' for i in range(3))}""")
def svd_directions(spark, sf):
    """Energy of the leading directions over a small vocabulary, what projections on them capture, and whether they are orthonormal."""
    settings = dataclasses.replace(_settings(), max_features=N_SMALL)
    words = features.stored_words(texts(spark, sf), "text", settings, "doc_id")
    tfidf = features.fit_tfidf(words, "words", settings)
    rows = tfidf.transform(words, "words").select("doc_id", "term_ids", "weights")
    directions, energies = models.svd_directions(rows, len(tfidf.terms), 3)
    size = directions.shape[1]
    off = abs(directions.T @ directions - np.eye(size)).max(axis=0)
    table = spark.createDataFrame(
        [(j + 1, float(energies[j]), bool(off[j] < 1e-9), directions[:, j].tolist()) for j in range(size)],
        "direction int, energy double, orthonormal boolean, v array<double>",
    )
    dot = F.aggregate(F.arrays_zip("term_ids", "weights"), F.lit(0.0), lambda s, z: s + z["weights"] * F.get("v", z["term_ids"]))
    captured = rows.crossJoin(F.broadcast(table)).groupBy("direction").agg(F.sum(F.pow(dot, 2)).alias("captured"))  # three directions
    return table.join(captured, "direction").select("direction", F.round("energy", 4).alias("energy"), F.round("captured", 4).alias("captured"), "orthonormal")


@query()
def kmeans_clusters(spark, sf):
    return models.kmeans_clusters(table(spark, sf, "embeddings"), k=12).select("vec_id", "cluster_label")


@query()
def pca_2d(spark, sf):
    """Plane coordinates with the columns shown on hover."""
    return models.pca_2d(table(spark, sf, "embeddings")).select("vec_id", "x", "y", "label")


@query()
def cluster_texts(spark, sf):
    """The whole clustering of the documents, as its summary table."""
    docs = roles.records(spark, sf)
    out = clustering.cluster_texts(
        docs.drop("cluster_label"), order=["doc_id"], n_clusters=6, n_components=N_COMPONENTS, stop_words=list(stop_words()),
        max_features=5000, keyword_features=5000,
    )
    return out.summary


def by_examples_sql(asked: str) -> str:
    """Votes of the nearest examples of the texts in ``asked``, a table of (item_id, text)."""
    near = near_sql(asked).replace("coalesce(mit_risk_domain = 'quality 1', false)", "false")
    return f"""WITH {near}, vt AS (
    SELECT item_id, 'risk' AS kind, mit_risk_domain AS label, similarity FROM nn JOIN rec USING (doc_id) WHERE mit_risk_domain IS NOT NULL
    UNION ALL SELECT item_id, 'problem', unnest(string_split(gmf_known_ai_technical_failure, ' | ')), similarity FROM nn JOIN rec USING (doc_id)
    UNION ALL SELECT item_id, 'sector', csetv1_sector_of_deployment, similarity FROM nn JOIN rec USING (doc_id)),
  w AS (SELECT item_id, kind, label, row_number() OVER (PARTITION BY item_id, kind ORDER BY round(sum(similarity), 8) DESC, label) AS r FROM vt GROUP BY 1, 2, 3)
  SELECT item_id, coalesce(max(label) FILTER (kind = 'risk' AND r = 1), 'Not available') AS predicted_risk,
    coalesce(max(label) FILTER (kind = 'problem' AND r = 1), 'Not available') AS predicted_problem,
    coalesce(max(label) FILTER (kind = 'sector' AND r = 1), 'Not available') AS predicted_sector
  FROM benchmark LEFT JOIN w USING (item_id) GROUP BY 1"""


@query(by_examples_sql("benchmark"))
def classify_by_examples(spark, sf):
    """New reports decided by their nearest examples alone."""
    records = roles.records(spark, sf)
    fitted = scoring.fit_report_classifier(records, "doc_id", stop_words=list(stop_words()), with_models=False)
    predictions, _ = scoring.classify_reports(fitted, table(spark, sf, "benchmark"), "item_id")
    return predictions.select("item_id", "predicted_risk", "predicted_problem", "predicted_sector")


@query()
def classify_new_reports(spark, sf):
    """New reports decided by the models, with votes where those are unsure."""
    records = roles.records(spark, sf)
    fitted = scoring.fit_report_classifier(records, "doc_id", stop_words=list(stop_words()), max_features=5000)
    predictions, _ = scoring.classify_reports(fitted, table(spark, sf, "benchmark"), "item_id")
    return predictions.select("item_id", "predicted_risk", "risk_confidence", "predicted_problem", "problem_confidence", "predicted_sector")
