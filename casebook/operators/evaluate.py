"""Evaluation tables for classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(predictions: DataFrame, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """Rows per (true, predicted) pair; everything else is derived from these."""
    return predictions.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("count")
    )


def label_union(pairs: DataFrame) -> DataFrame:
    """Labels that occur as a true or as a predicted value."""
    return (
        pairs.select(F.explode(F.array("true_label", "predicted_label")).alias("label"))
        .filter("label IS NOT NULL").distinct()
    )


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Every combination of two labels with its count; the size is classes squared."""
    names = label_union(pairs)
    all_names = names.agg(F.array_sort(F.collect_set("label"))).scalar()
    grid = names.select(F.col("label").alias("true_label"), F.explode(all_names).alias("predicted_label"))
    return grid.join(pairs, ["true_label", "predicted_label"], "left").na.fill(0, ["count"])


def classification_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    count = F.col("count")
    none = F.lit(0).cast("long")

    def side(label: str, support, predicted, hits):
        return F.struct(
            F.col(label).alias("label"), support.alias("support"), predicted.alias("predicted"), hits.alias("tp")
        )

    hit = F.when(F.col("true_label") == F.col("predicted_label"), count).otherwise(none)
    sides = F.array(side("true_label", count, none, hit), side("predicted_label", none, count, none))
    joined = (
        pairs.select(F.explode(sides).alias("s")).filter("s.label IS NOT NULL")
        .groupBy(F.col("s.label").alias("label"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")])
    )

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return joined.select(
        "label",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"),
        "support",
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of the per-class rows."""
    n = F.sum("support")

    def both(column: str):
        return F.avg(column), F.sum(F.col(column) * F.col("support")) / n

    macro_p, weighted_p = both("precision")
    macro_r, weighted_r = both("recall")
    macro_f, weighted_f = both("f1_score")
    one = report.agg(
        F.array(
            F.struct(F.lit("macro avg").alias("label"), macro_p.alias("precision"), macro_r.alias("recall"), macro_f.alias("f1_score"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), weighted_p.alias("precision"), weighted_r.alias("recall"), weighted_f.alias("f1_score"), n.alias("support")),
        ).alias("rows")
    )
    return one.select(F.explode("rows").alias("r")).select("r.*")


def classification_metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1 and weighted F1."""
    hits = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("count")).otherwise(0))
    accuracy = pairs.agg(hits / F.sum("count")).scalar()
    return classification_report(pairs).agg(
        F.avg("f1_score").alias("macro_f1"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    ).select(accuracy.alias("accuracy"), "macro_f1", "weighted_f1")


def part_sizes(train: DataFrame, test: DataFrame, group: str = "incident_id") -> DataFrame:
    """Rows and groups of the training and the test part."""
    sizes = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups")]
    return train.agg(*sizes).select(F.lit("train").alias("part"), "*").unionByName(test.agg(*sizes).select(F.lit("test").alias("part"), "*"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


def distributions(pairs: DataFrame) -> DataFrame:
    """Test and predicted counts per class."""
    true = pairs.groupBy(F.col("true_label").alias("label")).agg(F.sum("count").alias("n_true"))
    predicted = pairs.groupBy(F.col("predicted_label").alias("label")).agg(F.sum("count").alias("n_predicted"))
    return true.join(predicted, "label", "full_outer").na.fill(0)
