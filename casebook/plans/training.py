"""Train and evaluate a text classifier on a processed corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import corpus, evaluate, features, models, splits, taxonomy
from ..session import written_table
from ..sources import sinks
from ..sources.catalog import check_columns

# Columns that are never a target.
NOT_A_TARGET = [
    "input_text", "incident_id", "report_id", "split", "report_title", "report_text", "report_url",
    "source_domain", "incident_title", "incident_description", "incident_date", "incident_year",
]


@dataclass
class Evaluation:
    classifier: models.TextClassifier
    predictions: DataFrame
    pairs: DataFrame
    unseen: DataFrame
    part_sizes: DataFrame
    train_distribution: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "predictions": self.predictions,
            "confusion_matrix": evaluate.confusion_matrix(self.pairs),
            "classification_report": evaluate.classification_report(self.pairs),
            "evaluation_metrics": evaluate.classification_metrics(self.pairs),
            "prediction_distribution": evaluate.distributions(self.pairs),
            "part_sizes": self.part_sizes,
            "train_distribution": self.train_distribution,
        }


def train_test(df: DataFrame, test_size: float = 0.2, seed: int = 42, split_column: str | None = "split") -> tuple[DataFrame, DataFrame]:
    """Existing train and test rows when both exist, else a split by incident."""
    if split_column and split_column in df.columns:
        named = df.withColumn("split", splits.canonical_split(split_column))
        train, test = named.filter("split = 'train'"), named.filter("split = 'test'")
        if not train.isEmpty() and not test.isEmpty():
            return train, test
    ids = splits.split_groups(df, "incident_id", (1 - test_size, 0.0, test_size), seed)
    named = splits.apply_split(df, ids)
    return named.filter("split = 'train'"), named.filter("split = 'test'")


def verify_disjoint(train: DataFrame, test: DataFrame) -> None:
    for key in ("incident_id", "report_id"):
        if key in train.columns and key in test.columns:
            shared = [str(r[key]) for r in splits.overlap(train, test, key).limit(10).collect()]
            if shared:
                raise ValueError(f"{key} values appear in both train and test: {', '.join(sorted(shared))}")


def train_evaluate(
    df: DataFrame,
    target: str,
    strategy: str = "as_label",
    settings: features.TermSettings | None = None,
    c: float = 1.0,
    test_size: float = 0.2,
    seed: int = 42,
    min_chars: int = 40,
    order: list[str] | None = None,
) -> Evaluation:
    """Clean, split, check, fit on the training part and predict the test part."""
    required = ["input_text", "incident_id", target]
    if set(required) - set(df.columns):
        check_columns(df, required, taxonomy.candidate_labels(df, NOT_A_TARGET))
    frame = written_table(corpus.modeling_frame(df, target, strategy, min_chars, order))
    corpus.require_classes(frame)
    train, test = train_test(frame, test_size, seed)
    verify_disjoint(train, test)
    if settings is None:
        settings = features.TermSettings(
            stop_words=tuple(features.english_stop_words()), bigrams=True, min_df=2, max_df=0.95, sublinear=True
        )
    words = features.stored_words(train, "input_text", settings, "incident_id", "target_label")
    tfidf = features.fit_tfidf(words, "words", settings)
    weights = tfidf.transform(words, "words").select("target_label", "term_ids", "weights")
    classifier = models.train_classifier(tfidf.vector_table(weights), tfidf, "target_label", c)
    if classifier is None:
        raise ValueError("Need at least two target classes in the training part.")
    predicted = classifier.predict_text(test, "input_text", 3)
    predictions = written_table(
        predicted.withColumn("top_3_predictions", vectors.scores_text("top_predictions")).drop("top_predictions")
    )
    pairs = evaluate.pair_counts(predictions, "target_label", "predicted_label")
    return Evaluation(
        classifier, predictions, pairs, splits.unseen_classes(train, test), evaluate.part_sizes(train, test),
        evaluate.label_counts(train, "target_label"),
    )


def save_evaluation(result: Evaluation, folder: str) -> None:
    spark = result.predictions.sparkSession
    sinks.write_tables(result.tables(), folder)
    result.classifier.save(spark, f"{folder}/classifier")


def predict_logits(df: DataFrame, logits: str, names: list[str], top_k: int = 3) -> DataFrame:
    """Label, confidence and ranked top-k from a column of raw scores per class."""
    ranked = vectors.top_scores(vectors.softmax(logits), top_k, names)
    best = F.get("top_predictions", F.lit(0))
    return df.withColumn("top_predictions", ranked).withColumns(
        {"predicted_label": best["label"], "predicted_confidence": best["score"]}
    )
