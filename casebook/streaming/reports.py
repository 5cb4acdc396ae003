"""Counting, de-duplicating and classifying reports as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scoring import ReportClassifier, classify_reports


def read_reports(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of files that arrive in a folder, oldest first; a micro-batch takes at most ``files_per_batch`` of them."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def report_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Reports per time window and group; windows close after the lateness limit.

    Counts stand in the state store from batch to batch and over restarts. A
    report is late, and left out, if an earlier batch has closed its window.
    Reports without a time have no window and are left out.
    """
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = timed.groupBy(F.window("_t", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n_reports"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n_reports")


def distinct_reports(stream: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """First arrival of each key; keys are forgotten after the lateness limit, and later copies then come again."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_t")


def to_files(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what has arrived into Parquet files and read them back.

    Each micro-batch has its own folder, which a repeated batch replaces. In
    update mode a row may come again with a later ``batch``. Called again with
    the same folders, it goes on from the checkpoint with the files that have
    come since.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    for_each_batch(stream, handle, checkpoint, mode)
    return stream.sparkSession.read.parquet(output)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key of an update stream."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rows.columns if c not in (*keys, "batch")])


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def classify_stream(
    stream: DataFrame, classifier: ReportClassifier, key: str, text: Column | str, output: str, checkpoint: str
) -> None:
    """Classify each micro-batch and write it under its own batch folder.

    A batch that is run again after a failure replaces its earlier output.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_text", F.col(text) if isinstance(text, str) else text)
        predictions, _ = classify_reports(classifier, rows.select(key, "_text"), key, "_text")
        predictions.drop("_text").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    for_each_batch(stream, handle, checkpoint)
