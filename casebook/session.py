"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Settings every plan in this package assumes. Partition counts are left to
# the cluster and to AQE, which coalesces small shuffle partitions and splits
# skewed ones at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_SHIPPED: set[str] = set()


def build_session(app_name: str = "casebook", **conf: str) -> SparkSession:
    """Session with the package defaults; keyword arguments override them."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because executors elsewhere could not
    read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can read.")
    folder = tempfile.mkdtemp(prefix="casebook-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result no longer depends on its inputs."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application: functions inside tasks are found by name."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # stays for the life of the application, whose file server reads it
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="casebook-")), "casebook_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def few(df: DataFrame, what: str, limit: int = 100_000) -> DataFrame:
    """A table of at most ``limit`` rows, written once and marked for broadcast; more rows raise.

    For one row per class, cluster or country that joins a large table: the
    large side is then not shuffled on a key with few values.
    """
    small = written_table(df.limit(limit + 1))
    if small.count() > limit:
        raise ValueError(f"More than {limit} {what}.")
    return F.broadcast(small)


def written_table(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Used where several later jobs read the same expensive rows. ``schema``
    may declare a user-defined type stored with the same layout, which is how
    struct columns become ML vectors without leaving the JVM.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
