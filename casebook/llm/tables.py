"""Reading the shared tables, and the package on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(context: SparkContext) -> None:
    """Send this package to the Python workers, once for each application.

    Functions that run inside tasks are pickled by name, so a worker has to be
    able to import them wherever it was started.
    """
    if context.applicationId in _SHIPPED:
        return
    spark = SparkSession.active()
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default; texts are long rows
        spark.conf.set(BATCH_ROWS, "1000")
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="casebook-")), "casebook_tasks.zip")
    with open(path, "wb") as f:  # stays for the life of the application, whose file server reads it
        f.write(content.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark.sparkContext)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
