"""From documents to token sequences: quality rules, near and exact duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on,
with the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import contamination, near, packing, quality, repeats
from casebook.llm.tables import read, ship
from casebook.session import written_table

#: The line field, near duplicates and packing are not SQL; tests compare the pipeline with plain Python.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the line field keep."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).filter("kept").select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; five words a shingle.

    Of rows with the same doc_id and text one stays.
    """
    ship(spark.sparkContext)
    gone = near.near_classes(docs, near.NearSettings(width=5)).filter("NOT kept").select("doc_id").distinct()
    rank = F.expr("row_number() OVER (PARTITION BY doc_id, xxhash64(text) ORDER BY lang, source, n_chars)")
    return docs.join(gone, "doc_id", "leftanti").withColumn("_rank", rank).filter("_rank = 1").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier; texts of which nothing is left go."""
    ship(spark.sparkContext)
    left = repeats.remove_repeats(docs, decode=True).withColumn("text", F.col("kept_text"))
    return left.filter("text <> ''").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return contamination.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, packed into sequences of at most 4096 tokens."""
    ship(spark.sparkContext)
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_of_near),
    ("repeated strings", cut_repeats),
    ("benchmark passages", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
