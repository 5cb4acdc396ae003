"""Writing corpora, cluster results, evaluations and models."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_by_split(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split, so that a reader of one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def read_split(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df if split is None else df.filter(df["split"] == split)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Named result tables below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """Part files that ``catalog.read_csv`` reads back: quotes doubled, white space at either end kept; empty texts come back as null."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_config(spark: SparkSession, config: dict[str, Any], path: str) -> None:
    """Run settings as one JSON row."""
    row = [(json.dumps(config, sort_keys=True, default=str),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
