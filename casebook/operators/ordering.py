"""Row order: stable indexes, keep-first, per-group top-k and seeded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 1 << 16


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Consecutive 0-based index in scan order.

    The position inside a partition comes from the row id, and the offset of a
    partition from a count per partition. That offset table has one row per
    partition, which bounds the broadcast.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_id", 33)
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position)
        .drop("_id", "_part", "_offset")
    )


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order.

    The rank filter is pushed below the shuffle as a group limit, so that a
    key with very many copies sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_per_group(
    df: DataFrame, groups: list[str], order: list[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """At most k rows of each group with their rank; limited before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= k)


#: So many rows of one count, or fewer, are sorted to find the last name that is taken.
FEW_TIES = 10_000


def largest(df: DataFrame, count: str, name: str, n: int) -> DataFrame:
    """The ``n`` rows of a stored table with the largest counts; equal counts are taken in the order of the unique name.

    Histograms find where the cut falls: first over the exponent and four more
    bits of a count, then over the counts of that step, then over ever longer
    beginnings of the names that share the count, until few names are left.
    Each histogram has few rows, whatever the table holds, and the cut itself
    is a filter.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    found = _boundary(df, step, n, descending=True)
    if found is None:
        return df
    bucket, n, _ = found
    value, n, size = _boundary(df.filter(step == bucket), F.col(count), n, descending=True)
    ties, tied, length = df.filter(F.col(count) == value), F.lit(False), 0
    while n and size > FEW_TIES:
        length += 2
        prefix = F.substring(name, 1, length)
        start, n, size = _boundary(ties, prefix, n, descending=False)
        ties, tied = ties.filter(prefix == start), tied | (prefix < start)
        if n and ties.filter(F.col(name) == start).count():  # a name that ends here comes before all that go on
            ties, tied, n = ties.filter(F.col(name) != start), tied | (F.col(name) == start), n - 1
    if n:
        last = ties.orderBy(name).limit(n).agg(F.max(name)).first()[0]
        tied |= F.col(name) <= last
    return df.filter((F.col(count) > value) | ((F.col(count) == value) & tied))


def _boundary(df: DataFrame, key: Column, n: int, descending: bool) -> tuple | None:
    """(key at which the first ``n`` rows end, how many of its rows belong to them, how many it has); None when all rows do."""
    rows = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    for row in sorted(rows, key=lambda r: r["k"], reverse=descending):
        if row["n"] > n:
            return row["k"], n, row["n"]
        n -= row["n"]
    return None


def hash_rank(df: DataFrame, key: str, seed: int, rank: str = "hash_rank", total: str = "n_rows") -> DataFrame:
    """Rank of each row in a seeded pseudo-random order, and the row count.

    ``key`` is unique. The order is that of md5(seed|key). Rows are counted
    per hash prefix (at most 65,536 counts, hence the broadcast), and ranked
    inside their prefix, so that no task sorts more than one prefix.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    hashed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    )
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    starts = counts.select(
        "_bucket",
        (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"),
        F.sum("_n").over(everything).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    return (
        hashed.join(F.broadcast(starts), "_bucket")
        .withColumn(rank, F.col("_before") + inside)
        .drop("_digest", "_bucket", "_before")
    )


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of at most n rows; the same rows whatever the partitioning."""
    return hash_rank(df, key, seed).filter(F.col("hash_rank") <= n).drop("hash_rank", "n_rows")
