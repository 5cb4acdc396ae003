"""Clustering of report texts with keyword and metadata profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, corpus, features, models, ordering
from ..session import written_table
from ..sources import sinks
from ..sources.catalog import cast_cluster_label


@dataclass
class ClusterOutputs:
    records: DataFrame
    summary: DataFrame
    keywords: DataFrame
    metadata_distribution: DataFrame
    year_distribution: DataFrame | None
    notes: list[str] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        named = {
            "clustered_records": self.records,
            "cluster_summary": self.summary,
            "cluster_keywords": self.keywords,
            "cluster_metadata_distribution": self.metadata_distribution,
        }
        if self.year_distribution is not None:
            named["cluster_year_distribution"] = self.year_distribution
        return named


def term_settings(min_df: int, max_df: float, stop_words: list[str] | None, max_features: int) -> features.TermSettings:
    words = features.english_stop_words() if stop_words is None else stop_words
    return features.TermSettings(
        stop_words=tuple(words), bigrams=True, min_df=min_df, max_df=max_df,
        max_features=max_features,
    )


def cluster_texts(
    df: DataFrame,
    key: str = "incident_id",
    text_column: str = "input_text",
    order: list[str] | None = None,
    n_clusters: int = 12,
    n_components: int = 384,
    max_records: int | None = None,
    min_chars: int = 80,
    min_df: int = 2,
    seed: int = 42,
    stop_words: list[str] | None = None,
    max_features: int = 20_000,
    keyword_features: int = 12_000,
) -> ClusterOutputs:
    """TF-IDF, truncated SVD, k-means and PCA, then the profiles of the clusters.

    ``max_records`` asks for a seeded sample. It is off by default. Terms in
    fewer than ``min_df`` texts are left out, whatever the size of the table.
    """
    records = corpus.cluster_input(df, text_column, key, min_chars, order)
    records = written_table(records.withColumn("_row", F.monotonically_increasing_id()))
    if max_records is not None:
        records = written_table(ordering.sample_rows(records, "_row", max_records, seed))

    # The models work on row numbers; texts and metadata join back once.
    settings = term_settings(min_df, 0.95, stop_words, max_features)
    split = features.stored_words(records, text_column, settings, "_row")
    tfidf = features.fit_tfidf(split, "words", settings)
    weights = written_table(tfidf.transform(split, "words").select("_row", "term_ids", "weights"))
    embedded = written_table(
        models.svd_embeddings(weights, len(tfidf.terms), n_components).select("_row", "embedding")
    )
    placed = models.pca_2d(models.kmeans_clusters(embedded, k=n_clusters, seed=seed))
    placed = written_table(placed)
    clustered = written_table(records.join(placed, "_row").drop("_row"))

    words = features.fit_tfidf(split, "words", term_settings(min_df, 0.9, stop_words, keyword_features))
    keywords = clusters.cluster_keywords(words.transform(split.join(placed.select("_row", "cluster_label"), "_row"), "words"), words)
    examples = clusters.cluster_examples(clustered, key)
    metadata = {k: c for k, c in clusters.metadata_columns(clustered).items() if c}
    year = metadata.get("year")
    return ClusterOutputs(
        records=clustered,
        summary=clusters.cluster_summary(clustered, keywords, examples, metadata, key),
        keywords=keywords,
        metadata_distribution=clusters.metadata_distribution(clustered, metadata),
        year_distribution=clusters.cluster_years(clustered, year) if year else None,
    )


def save_clusters(outputs: ClusterOutputs, folder: str, config: dict) -> None:
    sinks.write_tables(outputs.tables(), folder)
    sinks.write_config(outputs.records.sparkSession, config, f"{folder}/cluster_config")


def load_clusters(spark, folder: str) -> ClusterOutputs:
    """Saved cluster tables; a missing one is empty and leaves a note."""
    notes: list[str] = []

    def read(name: str) -> DataFrame:
        try:
            df = spark.read.parquet(f"{folder}/{name}")
            return cast_cluster_label(df) if "cluster_label" in df.columns else df
        except AnalysisException as exc:
            notes.append(f"`{folder}/{name}` could not be loaded: {exc.getCondition()}")
            return spark.createDataFrame([], "cluster_label int, cluster_name string")

    summary = read("cluster_summary")
    records = read("clustered_records")
    if "cluster_name" not in records.columns:
        records = clusters.name_clusters(records, summary)
    return ClusterOutputs(
        records, summary, read("cluster_keywords"), read("cluster_metadata_distribution"),
        read("cluster_year_distribution"), notes,
    )
