"""Leak-free train, validation and test splits over groups of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import hash_rank

TOLERANCE = 1e-6


def parse_split_spec(spec: str) -> tuple[float, float, float]:
    """``80/20``, ``0.7/0.15/0.15`` and the like to (train, validation, test)."""
    values = [float(part) for part in spec.split("/") if part.strip()]
    if len(values) not in (2, 3):
        raise ValueError("A split looks like `80/20`, `0.8/0.2`, `70/15/15` or `0.7/0.15/0.15`.")
    if min(values) <= 0:
        raise ValueError("Split values must be positive.")
    if sum(values) > 1.5:
        values = [v / 100 for v in values]
    if abs(sum(values) - 1.0) > TOLERANCE:
        raise ValueError(f"Split values must sum to 1.0 or 100. Received total={sum(values):.4f}.")
    return (values[0], 0.0, values[1]) if len(values) == 2 else (values[0], values[1], values[2])


def _part(count: Column, fraction: float) -> Column:
    """Size of a held-out part, rounded up; float noise does not add a row."""
    return F.ceil(F.round(count * F.lit(fraction), 9))


def split_groups(groups: DataFrame, key: str, fractions: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """(key, split) for distinct groups, cut by count in a seeded order.

    The held-out part comes last and its own second part is the test set. A
    single group goes to training.
    """
    train, val, test = fractions
    if abs(train + val + test - 1.0) > TOLERANCE:
        raise ValueError("Split fractions must sum to 1.0.")
    ranked = hash_rank(groups.select(key).distinct(), key, seed)
    n = F.col("n_rows")
    held = _part(n, val + test)
    tested = _part(held, test / (val + test)) if val > 0 else held
    split = (
        F.when((n <= 1) | (F.col("hash_rank") <= n - held), F.lit("train"))
        .when(F.col("hash_rank") <= n - tested, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return ranked.select(key, split.alias("split"))


def group_split(
    components: DataFrame, fractions: tuple[float, float, float], seed: int = 42, min_groups: int = 1
) -> DataFrame:
    """(incident_id, split): every incident follows its component."""
    if min_groups > 1 and components.select("component").distinct().limit(min_groups).count() < min_groups:
        raise ValueError(f"Need at least {min_groups} incident groups to create these splits.")
    parts = split_groups(components, "component", fractions, seed)
    return components.join(parts, "component").select("incident_id", "split")


def apply_split(df: DataFrame, split_map: DataFrame) -> DataFrame:
    return df.drop("split").join(split_map, "incident_id", "left")


def carve_validation(df: DataFrame, components: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Move some training groups to validation; other splits stay as they are.

    The fraction is kept between 0.01 and 0.5.
    """
    share = min(0.5, max(fraction, 0.01))
    train = df.filter("split = 'train'").select("incident_id").distinct()
    train_groups = components.join(train, "incident_id", "left_semi").select("component").distinct()
    parts = split_groups(train_groups, "component", (1 - share, 0.0, share), seed)
    moved = components.join(parts.filter("split = 'test'"), "component", "left_semi").select(
        "incident_id", F.lit("val").alias("_moved")
    )
    return (
        df.join(moved, "incident_id", "left")
        .withColumn("split", F.when(F.col("split") == "train", F.coalesce("_moved", "split")).otherwise(F.col("split")))
        .drop("_moved")
    )


def canonical_split(column: str = "split") -> Column:
    """Lower-case split names, with ``validation`` spelled ``val``."""
    value = F.lower(F.col(column).cast("string"))
    return F.when(value == "validation", F.lit("val")).otherwise(value)


def assign_splits(
    df: DataFrame, components: DataFrame, fractions: tuple[float, float, float], seed: int = 42, split_column: str | None = "split"
) -> DataFrame:
    """Keep a complete split, carve validation out of train/test, or split afresh."""
    if split_column and split_column in df.columns:
        named = df.withColumn("split", canonical_split(split_column))
        present = {
            r["split"] for r in named.filter(F.col("split").isin("train", "val", "test")).select("split").distinct().collect()
        }
        if present == {"train", "val", "test"}:
            return named
        if {"train", "test"} <= present:
            return carve_validation(named, components, fractions[1], seed)
    return apply_split(df, group_split(components, fractions, seed, min_groups=3))


def leaks(df: DataFrame, key: str) -> DataFrame:
    """Keys found in more than one split; empty when the split is clean."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.countDistinct("split").alias("n_splits"))
        .filter("n_splits > 1")
    )


def verify_no_leaks(df: DataFrame, name: str, keys: tuple[str, ...] = ("incident_id", "report_id")) -> None:
    for key in keys:
        if key not in df.columns:
            continue
        examples = [str(r[key]) for r in leaks(df, key).orderBy(key).limit(10).collect()]
        if examples:
            raise ValueError(f"Data leakage in {name}: {key} appears in multiple splits: {', '.join(examples)}")


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys common to two parts."""
    return train.select(key).dropna().intersect(test.select(key).dropna())


def unseen_classes(train: DataFrame, test: DataFrame, column: str = "target_label") -> DataFrame:
    """Classes of the test part that training has never seen."""
    return test.select(column).distinct().join(train.select(column).distinct(), column, "left_anti")
