"""A folder of CSV datasets as DataFrames, with load failures kept as data."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import names


@dataclass
class Catalog:
    """Datasets by stem and where they lie; ``errors`` holds the ones that could not be read."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def get(self, *stems: str) -> DataFrame | None:
        """First of the named datasets that was loaded."""
        return next((self.tables[s] for s in stems if s in self.tables), None)

    def taxonomies(self) -> dict[str, DataFrame]:
        return {n: df for n, df in sorted(self.tables.items()) if n.startswith("classifications_")}

    def load_errors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.errors.items()), "name string, message string")

    def bad_records(self, spark: SparkSession, multi_line: bool = True) -> DataFrame:
        """(name, file_name, record) of the records with a cell too many or too few, over all datasets."""
        empty = spark.createDataFrame([], "name string, file_name string, record string")
        found = [bad_records(spark, path, multi_line).select(F.lit(name).alias("name"), "file_name", "record") for name, path in self.paths.items()]
        return reduce(DataFrame.unionByName, found, empty)

    def register(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


#: Column of the records that do not have as many cells as the header; part of no header, because names are snake case.
BAD = "_bad_record"
CSV_OPTIONS = {"quote": '"', "escape": '"'}


def _read_cells(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The cells of one dataset under unique names, and the text of a record with a cell too many or too few in ``BAD``."""
    options = CSV_OPTIONS | {"multiLine": multi_line}
    header = spark.read.options(**options).csv(path).first()  # as a record, because headers read as such come renamed
    if header is None:
        raise ValueError("no columns to parse from file")
    columns = names.unique_snake(h or "" for h in header)
    schema = StructType([StructField(c, StringType()) for c in [*columns, BAD]])
    return spark.read.options(**options, header=True, columnNameOfCorruptRecord=BAD).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One CSV file, or a folder of part files, all columns as strings.

    Reading strings avoids an inference pass over the data. ``multi_line``
    allows line breaks inside quotes, but then a file is one task; large
    datasets should come as many part files, or without such breaks. Missing
    cells at the end of a record are null, and cells beyond the header are
    left out; ``bad_records`` lists both kinds.
    """
    return _read_cells(spark, path, multi_line).drop(BAD)


def bad_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file_name, record) of the records that do not have as many cells as the header."""
    found = _read_cells(spark, path, multi_line)
    cells = F.concat_ws("", *(F.col(c) for c in found.columns if c != BAD))
    # the length of the cells makes the reader parse all of them; asked for the records alone it refuses
    rows = found.filter(F.col(BAD).isNotNull() & (F.length(cells) >= 0))
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), F.col(BAD).alias("record"))


def _list_csv(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """(stem, path, whether it holds any byte) of each ``*.csv`` entry, a file or a folder of part files.

    Only names and sizes are listed, no content is read.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    top = posixpath.normpath(re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", folder)).lstrip("./")
    entry = re.compile(rf"(?:.*?/)?{re.escape(top)}/([^/]*)\.csv(?=/|$)" if top else r"(?:.*/)?([^/]*)\.csv(?=/|$)")
    # all names, also of empty files, which a scan leaves out
    found = {m[0]: m[1] for path in files.inputFiles() if (m := entry.match(unquote(path)))}
    scanned = F.regexp_extract("path", rf"^{entry.pattern}", 0)
    filled = {r[0] for r in files.select(scanned).distinct().collect()} if found else set()
    return sorted((stem, path, path.replace("///", "/", 1) in filled) for path, stem in found.items())


def load_folder(spark: SparkSession, folder: str, multi_line: bool = True) -> Catalog:
    """Every ``*.csv`` of a folder. A missing folder gives an empty catalog."""
    catalog = Catalog()
    for stem, path, filled in _list_csv(spark, folder):
        try:
            if not filled:
                raise ValueError("no columns to parse from file")
            catalog.tables[stem] = read_csv(spark, path, multi_line)
            catalog.paths[stem] = path
        except (PySparkException, ValueError) as exc:
            catalog.errors[stem] = str(exc)
    return catalog


def read_optional(spark: SparkSession, path: str, notes: list[str]) -> DataFrame | None:
    """A CSV that may be absent; the reason is added to ``notes``."""
    try:
        return read_csv(spark, path)
    except AnalysisException as exc:
        missing = exc.getCondition() == "PATH_NOT_FOUND"
        notes.append(f"`{path}` was not found." if missing else f"`{path}` could not be loaded: {exc}")
    except (PySparkException, ValueError) as exc:
        notes.append(f"`{path}` could not be loaded: {exc}")
    return None


def check_columns(df: DataFrame, required: list[str], candidates: list[str] | None = None) -> DataFrame:
    """The frame itself, or an error naming missing columns and label candidates."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        hint = f" Candidate label columns: {', '.join(candidates)}." if candidates else ""
        raise ValueError(f"Missing required column(s): {', '.join(missing)}.{hint}")
    return df


def table_profile(tables: dict[str, DataFrame], roles: dict[str, str] | None = None) -> DataFrame:
    """Rows and columns of each table, with the role it plays."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.lit((roles or {}).get(name, "")).alias("role"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def cast_cluster_label(df: DataFrame, column: str = "cluster_label") -> DataFrame:
    """Integer cluster labels; rows whose label is not a number are dropped."""
    number = F.col(column).cast("string").try_cast("double").try_cast("int")
    return df.withColumn(column, number).filter(F.col(column).isNotNull())
