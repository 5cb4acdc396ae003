"""Terms, TF-IDF, keywords, neighbours, votes and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clusters, evaluate, features, neighbours
from ..session import written_table
from . import roles
from .registry import query
from .roles import METADATA, META_VALUES, RECORDS, table, texts

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
MAX_FEATURES = 18_000


# Stop words of the suite, shared by the Spark settings and the SQL.
STOP_WORDS = tuple(
    "a about after all also am an and any are as at be been before being but by can could did do does for from had has have he her his how i "
    "if in into is it its just me more most my no nor not of on only or other our out over own same she should so some such than that the "
    "their them then there these they this those through to too under until up very was we were what when where which while who why will "
    "with would you your".split()
)


def stop_words() -> tuple[str, ...]:
    return STOP_WORDS


STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + "]"


def _terms_sql(name: str, key: str, source: str) -> str:
    """Common table expressions down to (key, term, tf) with pairs of neighbouring words."""
    return f"""{name}_w AS MATERIALIZED (SELECT {key}, list_filter({WORDS}, lambda w: NOT list_contains({STOP}, w)) AS w FROM {source}),
  {name}_t AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w) GROUP BY 1, 2)"""


def _weights_sql(name: str, key: str, terms: str, tf: str = "1 + ln(tf)") -> str:
    return f"""{name}_raw AS (SELECT {key}, term, ({tf}) * idf AS v FROM {terms} JOIN vocab USING (term)),
  {name} AS MATERIALIZED (SELECT {key}, term, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"""


def _vocab_sql(terms: str, source: str, min_df: int, max_df: float, limit: int) -> str:
    return f"""vocab AS MATERIALIZED (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf
    FROM {terms} GROUP BY 1 HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT count(*) FROM {source}) ORDER BY 2 DESC, 1 LIMIT {limit})"""


def report_settings() -> features.TermSettings:
    return features.TermSettings(
        stop_words=stop_words(), bigrams=True, min_df=2, max_features=MAX_FEATURES, sublinear=True
    )


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, list_filter({WORDS}, lambda w: NOT list_contains({STOP}, w)) AS w FROM documents)")
def tokenize(spark, sf):
    words = text.tokens("text", list(stop_words()))
    return texts(spark, sf).select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words")
    )


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w)
  SELECT doc_id, CAST(len(g) AS INTEGER) AS n_terms, md5(array_to_string(g, '|')) AS terms FROM g""")
def ngrams(spark, sf):
    terms = features.row_terms("text", features.TermSettings(bigrams=True))
    return texts(spark, sf).select("doc_id", terms.alias("g")).select(
        "doc_id", F.size("g").alias("n_terms"), F.md5(F.array_join("g", "|")).alias("terms")
    )


@query(f"""WITH {_terms_sql('d', 'doc_id', 'documents')}, {_vocab_sql('d_t', 'documents', 3, 0.4, 5000)} SELECT term, cf, df FROM vocab""")
def vocabulary(spark, sf):
    settings = features.TermSettings(stop_words=stop_words(), bigrams=True, min_df=3, max_df=0.4, max_features=5000)
    words = features.stored_words(texts(spark, sf), "text", settings, "doc_id")
    return features.vocabulary(words, "words", settings, words.count())


@query(f"""WITH {_terms_sql('d', 'doc_id', 'documents')}, {_vocab_sql('d_t', 'documents', 2, 1.0, MAX_FEATURES)}, {_weights_sql('x', 'doc_id', 'd_t')}
  SELECT doc_id, term, round(weight, 6) AS weight FROM x""")
def tfidf(spark, sf):
    words = features.stored_words(texts(spark, sf), "text", report_settings(), "doc_id")
    model = features.fit_tfidf(words, "words", report_settings())
    long = features.weights_long(model.transform(words, "words"), "doc_id")
    return features.with_terms(long, model).select("doc_id", "term", F.round("weight", 6).alias("weight"))


_KEYWORDS = f"""{_terms_sql('d', 'doc_id', 'documents')}, {_vocab_sql('d_t', 'documents', 2, 0.9, 12_000)}, {_weights_sql('x', 'doc_id', 'd_t', 'tf')},
  m AS (SELECT lang, term, sum(weight) / any_value(n) AS score FROM x JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang) GROUP BY 1, 2),
  kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rank FROM m WHERE score > 0) WHERE rank <= 12)"""


def _keywords(spark, sf) -> DataFrame:
    docs = roles.records(spark, sf)
    settings = features.TermSettings(stop_words=stop_words(), bigrams=True, min_df=2, max_df=0.9, max_features=12_000)
    words = features.stored_words(docs, "input_text", settings, "doc_id", "cluster_label")
    model = features.fit_tfidf(words, "words", settings)
    return clusters.cluster_keywords(model.transform(words, "words"), model)


@query(f"WITH {_KEYWORDS} SELECT CAST(instr('de en es fr', lang) AS INTEGER) AS cluster_label, term AS keyword, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kw")
def cluster_keywords(spark, sf):
    return _keywords(spark, sf).withColumn("score", F.round("score", 6))


_CENTROIDS = """v AS (SELECT vec_id, label AS cluster_label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  c AS (SELECT cluster_label, pos, avg(v) AS c FROM v GROUP BY 1, 2)"""


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("label", "cluster_label")


@query(f"WITH {_CENTROIDS} SELECT cluster_label, CAST(pos AS INTEGER) AS pos, round(c, 5) AS value FROM c")
def cluster_centroids(spark, sf):
    centres = clusters.centroids(_vectors(spark, sf))
    return centres.select("cluster_label", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 5))


_EXAMPLES = f"""{_CENTROIDS}, dist AS (SELECT vec_id, cluster_label, sqrt(sum((v - c) * (v - c))) AS distance FROM v JOIN c USING (cluster_label, pos) GROUP BY 1, 2),
  ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY round(distance, 9), vec_id) AS rank FROM dist) WHERE rank <= 5)"""


@query(f"WITH {_EXAMPLES} SELECT vec_id, cluster_label, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM ex")
def cluster_examples(spark, sf):
    near = clusters.cluster_examples(_vectors(spark, sf), "vec_id")
    return near.select("vec_id", "cluster_label", F.round("distance", 5).alias("distance"), "rank")


_TOP = ", ".join(f"max(CASE WHEN metadata_type = '{k}' THEN top_values END) AS top_{k}" for k in METADATA)


@query(f"""WITH {_KEYWORDS}, {RECORDS}, {META_VALUES}, mc AS (SELECT metadata_type, cluster_label, value, count(*) AS n FROM vals GROUP BY ALL),
  mr AS (SELECT *, row_number() OVER (PARTITION BY metadata_type, cluster_label ORDER BY n DESC, value) AS r FROM mc),
  mt AS (SELECT metadata_type, cluster_label, string_agg(value || ' (' || n || ')', ' | ' ORDER BY r) AS top_values FROM mr WHERE r <= 3 GROUP BY 1, 2),
  mw AS (SELECT cluster_label, {_TOP} FROM mt GROUP BY 1),
  b AS (SELECT cluster_label, count(*) AS size, count(DISTINCT incident_id) AS unique_incidents FROM rec GROUP BY 1),
  k AS (SELECT CAST(instr('de en es fr', lang) AS INTEGER) AS cluster_label, string_agg(term, ', ' ORDER BY rank) AS top_keywords FROM kw GROUP BY 1),
  e AS (SELECT cluster_label, doc_id, incident_title, row_number() OVER (PARTITION BY cluster_label ORDER BY doc_id) AS r FROM rec),
  xs AS (SELECT cluster_label, string_agg(CAST(doc_id AS VARCHAR), ' | ' ORDER BY r) AS example_incident_ids, string_agg(incident_title, ' | ' ORDER BY r) AS example_titles FROM e WHERE r <= 5 GROUP BY 1)
  SELECT b.*, 'Cluster ' || cluster_label AS cluster_name, top_keywords, example_incident_ids, example_titles, {', '.join('top_' + k for k in METADATA)}
  FROM b JOIN k USING (cluster_label) JOIN xs USING (cluster_label) JOIN mw USING (cluster_label)""".replace("count(DISTINCT incident_id)", "count(DISTINCT doc_id)"))
def cluster_summary(spark, sf):
    """Summary of the language clusters, with the lowest ids as examples."""
    from ..operators.ordering import top_per_group

    records = roles.records(spark, sf).drop("incident_id").withColumnRenamed("doc_id", "incident_id")
    examples = top_per_group(records, ["cluster_label"], ["incident_id"], 5)
    return clusters.cluster_summary(records, _keywords(spark, sf), examples, METADATA)


# --- neighbours --------------------------------------------------------------------

def near_sql(asked: str) -> str:
    """Common table expressions down to the nearest documents of the texts in ``asked``, a table of (item_id, text)."""
    return f"""{_terms_sql('d', 'doc_id', 'documents')}, {_vocab_sql('d_t', 'documents', 2, 1.0, MAX_FEATURES)}, {_weights_sql('dw', 'doc_id', 'd_t')},
  {_terms_sql('q', 'item_id', asked)}, {_weights_sql('qw', 'item_id', 'q_t')},
  sh AS (SELECT item_id, doc_id, sum(qw.weight * dw.weight) AS s FROM qw JOIN dw USING (term) GROUP BY 1, 2),
  sc AS (SELECT item_id, doc_id, round(coalesce(s, 0), 9) AS similarity FROM benchmark b CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN sh USING (item_id, doc_id)),
  {RECORDS},
  nn AS (SELECT * FROM (SELECT item_id, doc_id, similarity, coalesce(mit_risk_domain = 'quality 1', false) AS same_label,
      row_number() OVER (PARTITION BY item_id ORDER BY coalesce(mit_risk_domain = 'quality 1', false) DESC, similarity DESC, doc_id) AS rank
    FROM sc JOIN rec USING (doc_id)) WHERE rank <= 8)"""


_NEAR = near_sql("benchmark")


def _near(spark, sf) -> DataFrame:
    records = roles.records(spark, sf)
    words = features.stored_words(records, "input_text", report_settings(), "doc_id", "mit_risk_domain")
    model = features.fit_tfidf(words, "words", report_settings())
    corpus = model.transform(words, "words")
    asked = table(spark, sf, "benchmark").withColumn("preferred", F.lit("quality 1"))
    queries = written_table(model.transform(asked, "text"))
    return neighbours.nearest_examples(
        queries, corpus, "item_id", "doc_id", preferred="preferred", corpus_label="mit_risk_domain"
    )


@query(f"WITH {_NEAR} SELECT item_id, doc_id, round(similarity, 6) AS similarity, same_label, CAST(rank AS INTEGER) AS rank FROM nn")
def knn_examples(spark, sf):
    return _near(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_NEAR}, v AS (SELECT item_id, unnest(string_split(gmf_known_ai_technical_failure, ' | ')) AS label, similarity FROM nn JOIN rec USING (doc_id)),
  s AS (SELECT item_id, label, sum(greatest(similarity, 0)) AS weight FROM v GROUP BY 1, 2)
  SELECT item_id, label, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 8) DESC, label) AS r FROM s) WHERE r = 1""")
def weighted_vote(spark, sf):
    records = roles.records(spark, sf).select("doc_id", "gmf_known_ai_technical_failure")
    near = written_table(_near(spark, sf)).join(records, "doc_id")
    vote = neighbours.weighted_vote(near, "item_id", "gmf_known_ai_technical_failure")
    return vote.withColumn("weight", F.round("weight", 6))


# --- evaluation ----------------------------------------------------------------------

_PREDICTED = "CASE WHEN value < 5 THEN 'click' WHEN value < 15 THEN 'view' WHEN value < 25 THEN event_type ELSE 'other' END"
_PAIRS = f"pairs AS (SELECT event_type AS t, {_PREDICTED} AS p, count(*) AS n FROM events GROUP BY 1, 2), lab AS (SELECT t AS label FROM pairs UNION SELECT p FROM pairs)"
_REPORT = f"""{_PAIRS}, cr AS (SELECT label, coalesce(tp / nullif(pr, 0), 0) AS precision, coalesce(tp / nullif(su, 0), 0) AS recall,
    coalesce(2 * tp / nullif(pr + su, 0), 0) AS f1_score, su::BIGINT AS support FROM (SELECT label,
      coalesce((SELECT sum(n) FROM pairs WHERE t = label AND p = label), 0) AS tp, coalesce((SELECT sum(n) FROM pairs WHERE p = label), 0) AS pr,
      coalesce((SELECT sum(n) FROM pairs WHERE t = label), 0) AS su FROM lab))"""


def _pairs(spark, sf) -> DataFrame:
    return evaluate.pair_counts(table(spark, sf, "events").withColumn("p", F.expr(_PREDICTED)), "event_type", "p")


@query(f"""WITH {_PAIRS} SELECT a.label AS true_label, b.label AS predicted_label, coalesce((SELECT n FROM pairs WHERE t = a.label AND p = b.label), 0) AS count FROM lab a, lab b""")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_pairs(spark, sf))


@query(f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM cr")
def classification_report(spark, sf):
    out = evaluate.classification_report(_pairs(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@query(f"""WITH {_REPORT} SELECT round((SELECT sum(n) FROM pairs WHERE t = p) / (SELECT sum(n) FROM pairs), 6) AS accuracy, round(avg(f1_score), 6) AS macro_f1,
  round(sum(f1_score * support) / sum(support), 6) AS weighted_f1 FROM cr""")
def classification_metrics(spark, sf):
    out = evaluate.classification_metrics(_pairs(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {_REPORT} SELECT 'macro avg' AS label, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1_score), 6) AS f1_score, sum(support)::BIGINT AS support FROM cr
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6), sum(support)::BIGINT FROM cr""")
def report_averages(spark, sf):
    out = evaluate.report_averages(evaluate.classification_report(_pairs(spark, sf)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@query(f"""WITH {_PAIRS} SELECT label, coalesce((SELECT sum(n) FROM pairs WHERE t = label), 0)::BIGINT AS n_true, coalesce((SELECT sum(n) FROM pairs WHERE p = label), 0)::BIGINT AS n_predicted FROM lab""")
def prediction_distribution(spark, sf):
    return evaluate.distributions(_pairs(spark, sf))
