"""WARC records, and a Merkle audit of two replicas.

Each record is hashed where it is read, and only digests, lengths and offsets
are shuffled. A node covers an ordered range of ``fanout`` nodes below it and
hashes their places, offsets, lengths and digests, up to one root for each
file. The audit compares the roots of two replicas and descends, level by
level, into the ranges that differ, until it reaches the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

RECORDS_PER_FILE = 512
FANOUT = 16


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, page_id, record): one response record for each page, as bytes.

    Files hold ranges of ``per_file`` page ids. Null html is an empty body and
    a null url an empty target. Pages without an id go to 1024 further files,
    with negative numbers, by a hash.
    """
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1024))).cast("bigint")
    return pages.select(file.alias("file"), "page_id", F.encode(text, "UTF-8").alias("record"))


def index(rows: DataFrame) -> DataFrame:
    """``rows`` without the bytes, with length and digest, and with ordinal and offset in their file.

    Records of a file follow by page_id, then digest; equal records keep both places.
    """
    return _placed(digests(rows))


def _placed(narrow: DataFrame) -> DataFrame:
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return narrow.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint")).withColumn("offset", before)


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` with length and digest in place of the record."""
    return rows.withColumn("length", F.octet_length("record").cast("bigint")).withColumn("digest", F.sha2("record", 256)).drop("record")


def tree(leaves: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (file, node, hash) from the records up to the roots; those above the records are written once."""
    out = [leaves.select("file", F.col("ordinal").alias("node"), F.sha2(F.concat_ws("|", "ordinal", "offset", "length", "digest"), 256).alias("hash"))]
    for _ in range(levels):
        below = out[-1].groupBy("file", F.floor(F.col("node") / fanout).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("below"))
        whole = F.array_join(F.transform("below", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "|")
        out.append(written_table(below.select("file", F.col("up").alias("node"), F.sha2(whole, 256).alias("hash"))))
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, ordinal, page_id, offset, length, state) of the records in which two replicas differ.

    Both have file, ordinal, page_id, offset, length and digest; places are
    unique in a file. Offset and length are those of ``left``, or of ``right``
    where it alone has the record. state is altered, missing (from ``right``)
    or extra. Equal or empty replicas give no rows.
    """
    top = left.select("ordinal").unionByName(right.select("ordinal")).agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("n")).first()["n"]
    levels = 1
    while fanout**levels <= top:
        levels += 1
    a, b = tree(left, levels, fanout), tree(right, levels, fanout)
    wrong = None
    for level in range(levels, -1, -1):
        x, y = a[level].withColumnRenamed("hash", "hash_a"), b[level].withColumnRenamed("hash", "hash_b")
        if wrong is not None:  # only the children of ranges that differ
            up = F.floor(F.col("node") / fanout).cast("bigint")
            x, y = (t.withColumn("up", up).join(wrong.withColumnRenamed("node", "up"), ["file", "up"], "leftsemi").drop("up") for t in (x, y))
        both = x.join(y, ["file", "node"], "full").filter("NOT hash_a <=> hash_b")
        wrong = both.select("file", "node")
    state = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("altered")
    found = both.select("file", F.col("node").alias("ordinal"), state.alias("state"))
    sides = [t.select("file", "ordinal", *(F.col(c).alias(f"{c}_{s}") for c in ("page_id", "offset", "length"))) for s, t in (("a", left), ("b", right))]
    for side in sides:
        found = found.join(side, ["file", "ordinal"], "left")
    return found.select("file", "ordinal", *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("page_id", "offset", "length")), "state")


def _damage(flip: Column, cut: Column) -> Column:
    """The record with a byte changed, or cut in half, by conditions."""
    n = F.octet_length("record")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring("record", 1, half), F.encode(F.lit("\x00"), "UTF-8"), F.substring("record", half + 2, n))
    return F.when(flip, changed).when(cut, F.substring("record", 1, half)).otherwise(F.col("record"))


def damaged(replica: DataFrame, flip: Column, lose: Column, cut: Column) -> DataFrame:
    """A replica of (…, record) rows with a byte changed, records lost, or records cut in half, by conditions."""
    return replica.filter(~F.coalesce(lose, F.lit(False))).withColumn("record", _damage(flip, cut))


def damaged_pair(archive: DataFrame, flip: Column, lose: Column, cut: Column) -> tuple[DataFrame, DataFrame]:
    """(archive, damaged replica) with digests and places.

    The archive is numbered once, and the replica keeps the places of its
    records, whatever ids repeat or are missing; what its bytes say is hashed again.
    """
    other = digests(archive.select("file", "page_id", F.coalesce(lose, F.lit(False)).alias("lost"), "record", _damage(flip, cut).alias("changed")).withColumns(
        {"other_length": F.octet_length("changed").cast("bigint"), "other_digest": F.sha2("changed", 256)}
    ).drop("changed"))
    placed = written_table(_placed(other))
    names = ["file", "page_id", "ordinal", "offset"]
    replica = placed.filter("NOT lost").select(*names, F.col("other_length").alias("length"), F.col("other_digest").alias("digest"))
    return placed.select(*names, "length", "digest"), replica
