"""Text classifier, embeddings, clusters and projection with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import labels, vectors
from ..session import ship, written_table
from . import filters
from .features import TfidfModel

MIN_ROWS = 20
MIN_CLASSES = 2


@dataclass(frozen=True)
class TextClassifier:
    """Logistic regression over TF-IDF rows, with its class names in index order."""

    tfidf: TfidfModel
    labels: list[str]
    model: LogisticRegressionModel

    def predict(self, vectorised: DataFrame, top_k: int = 3) -> DataFrame:
        """Add predicted label, confidence and the ranked top-k, for rows with ``features``."""
        scored = self.model.transform(vectorised).drop("rawPrediction", "prediction")
        ranked = vectors.top_scores(vector_to_array("probability"), top_k, self.labels)
        return scored.withColumn("top_predictions", ranked).select(
            *vectorised.columns,
            F.get("top_predictions", F.lit(0))["label"].alias("predicted_label"),
            F.get("top_predictions", F.lit(0))["score"].alias("predicted_confidence"),
            "top_predictions",
        )

    def predict_text(self, df: DataFrame, column: str = "input_text", top_k: int = 3) -> DataFrame:
        """Vectorise and predict; the vectors are written once to the shared folder."""
        stored = self.tfidf.vector_table(self.tfidf.transform(df, column))
        return self.predict(stored, top_k).drop("features", "term_ids", "weights")

    def save(self, spark: SparkSession, path: str) -> None:
        self.tfidf.save(spark, f"{path}/tfidf")
        self.model.write().overwrite().save(f"{path}/model")
        names = [(i, v) for i, v in enumerate(self.labels)]
        spark.createDataFrame(names, "label int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextClassifier:
        names = [r["name"] for r in spark.read.parquet(f"{path}/labels").orderBy("label").collect()]
        return TextClassifier(TfidfModel.load(spark, f"{path}/tfidf"), names, LogisticRegressionModel.load(f"{path}/model"))


def class_counts(df: DataFrame, column: str) -> dict[str, int]:
    """Rows per class, in sorted order. Classes are what the model holds anyway."""
    rows = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()
    return dict(sorted((r[column], r["n"]) for r in rows))


def train_classifier(
    vectorised: DataFrame, tfidf: TfidfModel, target: str, c: float = 1.0, max_iter: int = 500, tol: float = 1e-4,
    min_rows: int = 0,
) -> TextClassifier | None:
    """Class-balanced L2 logistic regression on rows with ``features``.

    Balanced weights n / (k n_class) add up to n, so an inverse strength c
    over summed losses equals regParam 1 / (c n) over the mean loss. Returns
    None below the row or class minimum.
    """
    rows = vectorised.filter(F.trim(F.coalesce(target, F.lit(""))) != "")
    counts = class_counts(rows, target)
    n, k = sum(counts.values()), len(counts)
    if k < MIN_CLASSES or n < min_rows:
        return None
    classes = vectorised.sparkSession.createDataFrame(
        [(name, float(i), n / (k * size)) for i, (name, size) in enumerate(counts.items())],
        f"`{target}` string, _label double, _weight double",
    )
    # One row per class.
    train = rows.join(F.broadcast(classes), target).select("features", "_label", "_weight")
    estimator = LogisticRegression(
        featuresCol="features", labelCol="_label", weightCol="_weight", family="auto", maxIter=max_iter,
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=tol,
    )
    return TextClassifier(tfidf, list(counts), estimator.fit(train))


def primary_problem(df: DataFrame, column: str, min_support: int = 3) -> DataFrame:
    """Rows with their first problem label, where that label has enough rows."""
    first = df.withColumn("problem_label", labels.primary_label(column)).filter("problem_label IS NOT NULL")
    return filters.min_support(first, "problem_label", min_support)


def svd_directions(rows: DataFrame, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, energies): the leading right singular vectors, terms × k, and the squared singular values.

    The rows become a distributed matrix of sparse vectors in the JVM, whose
    Gram matrix is applied to vectors row by row until the directions settle;
    only vectors of the vocabulary's size reach the driver. Fewer directions
    than asked come out when the rows span fewer. The largest component of
    each direction is positive.
    """
    layout = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(n_terms).alias("size"), F.col("term_ids").alias("indices"), F.col("weights").alias("values")
    )
    table = written_table(rows.select(layout.alias("features")), StructType([StructField("features", VectorUDT())]))
    table.persist()  # read once for every product
    found = RowMatrix(table, 0, n_terms).computeSVD(min(k, max(n_terms - 1, 1)))
    table.unpersist()
    directions = found.V.toArray()
    largest = np.abs(directions).argmax(axis=0)
    return directions * np.sign(directions[largest, np.arange(directions.shape[1])]), found.s.toArray() ** 2


def _projected(batches: Iterator[pa.RecordBatch], directions: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows times the directions, scaled to unit length; about a million products at a time."""
    v = directions.value
    for batch in batches:
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("term_ids")).fill_null(0).to_numpy())])
        ids, weights = (batch.column(c).flatten().to_numpy() for c in ("term_ids", "weights"))
        out, i = np.zeros((batch.num_rows, v.shape[1])), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(first, first[i] + (1 << 20) // v.shape[1], "right")) - 1)
            some = np.flatnonzero(first[i + 1 : j + 1] > first[i:j]) + i
            if len(some):
                products = v[ids[first[i] : first[j]]] * weights[first[i] : first[j], None]
                out[some] = np.add.reduceat(products, first[some] - first[i])
            i = j
        length = np.linalg.norm(out, axis=1, keepdims=True)
        unit = np.divide(out, length, out=out, where=length > 0).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * v.shape[1]), pa.array(unit.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "embedding"])


def svd_embeddings(rows: DataFrame, n_terms: int, k: int = 384) -> DataFrame:
    """Add ``embedding``: rows projected on the k leading directions, unit length; a row without terms stays zero.

    ``rows`` is a stored table with ``term_ids`` and ``weights``, without a
    vector column. The products with a shared matrix have no built-in
    expression, so Arrow batches go through NumPy.
    """
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(svd_directions(rows, n_terms, k)[0])
    schema = StructType([*rows.schema, StructField("embedding", ArrayType(FloatType()))])
    return rows.mapInArrow(partial(_projected, directions=shared), schema)


def _embedding_vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))


def fit_kmeans(
    df: DataFrame, column: str = "embedding", k: int = 12, seed: int = 42, max_iter: int = 20, tol: float = 1e-4
) -> tuple[DataFrame, list[list[float]]]:
    """Rows with ``cluster_label`` from k-means with at most one cluster per row, and the centres in label order."""
    n = df.count()
    if min(k, n) < 2:
        raise ValueError("Need at least two rows to create clusters.")
    vectors_df = _embedding_vectors(df, column)
    estimator = KMeans(k=min(k, n), seed=seed, featuresCol="_v", predictionCol="cluster_label", maxIter=max_iter, tol=tol)
    model = estimator.fit(vectors_df)
    return model.transform(vectors_df).drop("_v"), [c.tolist() for c in model.clusterCenters()]


def kmeans_clusters(df: DataFrame, column: str = "embedding", k: int = 12, seed: int = 42) -> DataFrame:
    """Add ``cluster_label`` from k-means with at most one cluster per row."""
    return fit_kmeans(df, column, k, seed)[0]


def pca_2d(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Add ``x`` and ``y``: the two leading principal components, centred."""
    vectors_df = _embedding_vectors(df, column)
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors_df)
    flat = model.transform(vectors_df).withColumn("_p", vector_to_array("_p")).drop("_v")
    # The model projects without centring, so the mean projection is removed.
    centre = flat.agg(F.struct(F.avg(F.get("_p", F.lit(0))).alias("x"), F.avg(F.get("_p", F.lit(1))).alias("y"))).scalar()
    return (
        flat.withColumn("_c", centre)
        .withColumns({
            "x": F.get("_p", F.lit(0)) - F.col("_c.x"),
            "y": F.get("_p", F.lit(1)) - F.col("_c.y"),
        })
        .drop("_p", "_c")
    )
