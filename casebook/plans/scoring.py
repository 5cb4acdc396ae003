"""Classification of new reports from models, similar examples and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import features, models, neighbours
from ..session import written_table

RISK = "mit_risk_domain"
PROBLEM = "gmf_known_ai_technical_failure"
SECTOR = "csetv1_sector_of_deployment"
LOW_CONFIDENCE = 0.18
NOT_AVAILABLE = "Not available"


@dataclass
class ReportClassifier:
    """Vectorised corpus records with the optional risk and problem models."""

    tfidf: features.TfidfModel
    records: DataFrame
    key: str
    risk_model: models.TextClassifier | None = None
    problem_model: models.TextClassifier | None = None
    summary: DataFrame | None = None


def fit_report_classifier(
    records: DataFrame,
    key: str = "report_id",
    text_column: str = "input_text",
    summary: DataFrame | None = None,
    stop_words: list[str] | None = None,
    max_features: int = 18_000,
    with_models: bool = True,
) -> ReportClassifier | None:
    """Fit on all records with text. A model needs 20 rows and two classes."""
    rows = records.filter(F.trim(F.coalesce(F.col(text_column), F.lit(""))) != "")
    if rows.isEmpty():
        return None
    words = features.english_stop_words() if stop_words is None else stop_words
    settings = features.TermSettings(
        stop_words=tuple(words), bigrams=True, min_df=2, max_features=max_features, sublinear=True
    )
    split = features.stored_words(rows, text_column, settings, key, *(c for c in rows.columns if c not in (key, text_column, "words")))
    tfidf = features.fit_tfidf(split, "words", settings)
    stored = tfidf.vector_table(tfidf.transform(split, "words").drop("words"))
    risk_model = problem_model = None
    if with_models and RISK in stored.columns:
        risk_model = models.train_classifier(stored, tfidf, RISK, c=3.0, min_rows=models.MIN_ROWS)
    if with_models and PROBLEM in stored.columns:
        supported = models.primary_problem(stored, PROBLEM)
        problem_model = models.train_classifier(supported, tfidf, "problem_label", c=2.5, min_rows=models.MIN_ROWS)
    return ReportClassifier(tfidf, stored.drop("features"), key, risk_model, problem_model, summary)


def new_report_text(title: Column | str, body: Column | str, domain: Column | str | None = None) -> Column:
    """Labelled non-empty parts of a new report."""
    parts = [("Report title", title), ("Report text", body)] + ([("Source domain", domain)] if domain is not None else [])
    texts = []
    for name, column in parts:
        value = F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
        texts.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws(" ", *texts)


def classify_reports(
    classifier: ReportClassifier, reports: DataFrame, key: str, text_column: str = "text", top_k: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(predictions, nearest examples) of a batch of new reports.

    The risk model decides where there is one, and puts examples of its risk
    first; otherwise the examples vote. The problem model gives way to the
    vote when it is missing or unsure, and a cluster's usual failure is the
    last resort.
    """
    asked = reports.filter(F.trim(F.coalesce(F.col(text_column), F.lit(""))) != "")
    queries = classifier.tfidf.vector_table(classifier.tfidf.transform(asked, text_column))

    def with_model(df: DataFrame, model: models.TextClassifier | None, name: str) -> DataFrame:
        if model is None:
            return df.withColumns({
                f"{name}_model": F.lit(None).cast("string"), f"{name}_confidence": F.lit(None).cast("double"),
                f"{name}_predictions": F.lit(None).cast("array<struct<label:string,score:double>>"),
            })
        return model.predict(df, top_k).withColumnsRenamed({
            "predicted_label": f"{name}_model", "predicted_confidence": f"{name}_confidence",
            "top_predictions": f"{name}_predictions",
        })

    scored = with_model(with_model(queries, classifier.risk_model, "risk"), classifier.problem_model, "problem")
    has_risk = RISK in classifier.records.columns
    near = neighbours.nearest_examples(
        scored, classifier.records, key, classifier.key,
        preferred="risk_model" if has_risk else None, corpus_label=RISK if has_risk else None,
    )
    columns = [c for c in (RISK, PROBLEM, SECTOR, "cluster_label", "cluster_name", "incident_title", "report_title", "source_domain", "incident_year") if c in classifier.records.columns]
    examples = written_table(near.join(classifier.records.select(classifier.key, *columns), classifier.key))

    out = scored.drop("features", "term_ids", "weights")
    for column, name in ((RISK, "risk_vote"), (PROBLEM, "problem_vote"), (SECTOR, "sector_vote")):
        if column in columns:
            vote = neighbours.weighted_vote(examples, key, column).select(key, F.col("label").alias(name))
            out = out.join(vote, key, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("string"))

    risk = F.coalesce("risk_model", "risk_vote", F.lit(NOT_AVAILABLE))
    # A missing vote counts as an answer of its own for an unsure model.
    problem = F.when(F.coalesce("problem_confidence", F.lit(0.0)) < LOW_CONFIDENCE, F.col("problem_vote")).otherwise(
        F.col("problem_model")
    )
    out = out.withColumns({"predicted_risk": risk, "_problem": problem})
    if classifier.summary is not None and "cluster_label" in columns and "top_failure_type" in classifier.summary.columns:
        first = examples.filter("rank = 1").select(key, "cluster_label")
        hint = first.join(classifier.summary.select("cluster_label", "top_failure_type"), "cluster_label").drop("cluster_label")
        out = out.join(hint, key, "left").withColumn(
            "_problem", F.coalesce("_problem", labels.summary_label("top_failure_type", "predicted_risk"))
        ).drop("top_failure_type")
    predictions = out.select(
        key, text_column, "predicted_risk", "risk_confidence", "risk_predictions",
        F.coalesce("_problem", F.lit(NOT_AVAILABLE)).alias("predicted_problem"),
        "problem_confidence", "problem_predictions",
        F.coalesce("sector_vote", F.lit(NOT_AVAILABLE)).alias("predicted_sector"),
    )
    return predictions, examples


def example_table(examples: DataFrame, key: str) -> DataFrame:
    """Examples with display headers, ranked per query."""
    headers = {
        "cluster_name": "Theme", "incident_title": "Incident title", "report_title": "Report title",
        "source_domain": "Source domain", "incident_year": "Year", RISK: "Risk category", PROBLEM: "Related problem",
    }
    shown = [F.col(c).alias(h) for c, h in headers.items() if c in examples.columns]
    return examples.select(key, "rank", *shown, F.format_string("%.3f", "similarity").alias("Similarity"))
