"""Classification tables as long labels, wide label columns and locations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..sources import names
from .ordering import keep_first

LONG_COLUMNS = "incident_id string, taxonomy_source string, risk_category string, secondary_label string"
LOCATION_COLUMNS = "incident_id string, country string, location_label string, location_source string"

# How the known taxonomies are read. Name prefix -> (source
# name, category candidates, secondary candidates, comma-separated category).
KNOWN = {
    "classifications_mit": ("MIT", ["risk_domain"], ["risk_subdomain"], False),
    "classifications_gmf": (
        "GMF", ["known_ai_technical_failure", "known_ai_goal"], ["known_ai_technology"], True,
    ),
    "classifications_csetv1": (
        "CSETv1", ["ai_harm_level", "tangible_harm", "harm_domain"],
        ["sector_of_deployment", "location_region"], False,
    ),
}

# Header parts that mark a label column, and parts that rule it out.
LABEL_WORDS = [
    "risk", "harm", "failure", "sector", "intent", "goal", "technology", "technique", "application",
    "task", "function", "domain", "subdomain", "severity", "near_miss", "deployed", "autonomy",
    "public_sector", "physical_system", "problem_nature", "infrastructure", "location_region",
    "protected_characteristic", "rights_violation", "detrimental_content", "minor", "critical_services",
]
NON_LABEL_WORDS = [
    "id", "namespace", "published", "date", "month", "day", "year", "annotator", "reviewer", "quality",
    "status", "snippet", "discussion", "notes", "description", "text", "title", "url", "source_domain",
    "source_url", "location_city", "location_state", "location_country", "entities", "lives_lost",
    "injuries", "financial_cost", "quantity", "quantities", "image", "downloaded", "modified",
    "submitted", "mongodb",
]
MAX_DISTINCT = 600
MAX_RATIO = 0.85
MAX_MEAN_LENGTH = 160


def _spec(name: str) -> tuple[str, list[str], list[str], bool]:
    key = names.snake(name)
    if key.startswith("classifications_csetv1"):
        return KNOWN["classifications_csetv1"]
    if name in ("classifications_MIT", "classifications_GMF"):
        return KNOWN[name.lower()]
    source = name.replace("classifications_", "").replace("_", " ")
    return source, names.RISK, [], False


def taxonomy_long(name: str, df: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """(incident_id, taxonomy_source, risk_category, secondary_label) of one dataset."""
    key = names.find_column(df.columns, names.INCIDENT_ID)
    source, wanted, secondary, commas = _spec(name)
    category = names.find_column(df.columns, wanted)
    if key is None or category is None:
        if key is None and notes is not None:
            notes.append(f"`{name}` has no detectable incident ID and was skipped.")
        return df.sparkSession.createDataFrame([], LONG_COLUMNS)
    second = names.find_column(df.columns, secondary) if secondary else None
    value = text.safe_string(category)
    out = df.select(
        F.trim(text.safe_string(key)).alias("incident_id"),
        F.lit(source).alias("taxonomy_source"),
        (F.explode(labels.split_commas(value)) if commas else value).alias("risk_category"),
        (text.safe_string(second) if second else F.lit("")).alias("secondary_label"),
    )
    return out.filter("incident_id <> '' AND risk_category <> ''")


def risk_long(taxonomies: dict[str, DataFrame], notes: list[str] | None = None) -> DataFrame:
    """Long labels of the preferred taxonomy, or of all others when it has none."""
    frames = {n: taxonomy_long(n, df, notes) for n, df in taxonomies.items()}
    preferred = frames.pop("classifications_MIT", None)
    if preferred is not None and not preferred.isEmpty():
        return preferred
    if notes is not None and frames:
        notes.append("The preferred risk taxonomy is missing; the other classifications are used.")
    return reduce(DataFrame.unionByName, frames.values()) if frames else preferred


def locations(taxonomies: dict[str, DataFrame], notes: list[str] | None = None) -> DataFrame | None:
    """Country and place of each incident over all datasets, first mention kept."""
    frames = []
    for position, (name, df) in enumerate(taxonomies.items()):
        key = names.find_column(df.columns, names.INCIDENT_ID)
        country = names.find_column(df.columns, names.COUNTRY)
        place = names.find_column(df.columns, names.LOCATION)
        if key is None or (country is None and place is None):
            continue
        frames.append(
            df.select(
                F.trim(text.safe_string(key)).alias("incident_id"),
                F.nullif(text.safe_string(country) if country else F.lit(""), F.lit("")).alias("country"),
                F.nullif(text.safe_string(place) if place else F.lit(""), F.lit("")).alias("location_label"),
                F.lit(name).alias("location_source"),
                F.lit(position).alias("_order"),
            )
        )
    if not frames:
        if notes is not None:
            notes.append("No country or location columns were found for map views.")
        return None
    return merge_locations(reduce(DataFrame.unionByName, frames))


def merge_locations(df: DataFrame, order: str = "_order") -> DataFrame:
    """Drop rows without any place, then keep the first of equal places."""
    kept = df.filter("incident_id <> ''").dropna("all", subset=["country", "location_label"])
    return keep_first(kept, ["incident_id", "country", "location_label"], [order, "location_source"]).drop(order)


def value_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: non-empty values, distinct values, their ratio and mean length.

    Columns are unpivoted and counted by (column, digest of the value) first,
    so that the shuffle carries 16 bytes for each distinct value of a task,
    however long the values are.
    """
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), text.normalize_text(c).alias("value")) for c in columns])
        ).alias("cell")
    ).select("cell.*")
    values = cells.filter("value <> ''").groupBy("column", F.unhex(F.md5("value")).alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars")
    )
    stats = values.groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("chars").alias("n_chars"),
    )
    return stats.select(
        "column",
        "n_values",
        "n_distinct",
        (F.col("n_distinct") / F.col("n_values")).alias("distinct_ratio"),
        (F.col("n_chars") / F.col("n_values")).alias("mean_length"),
    )


# 2**14 registers: a standard error of 0.8 %. Estimates this far from a limit, six times that, settle a column.
SKETCH_BITS = 14
SKETCH_MARGIN = 0.05


def sketched_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, float, float]]:
    """(non-empty values, characters, least and most distinct values) of each column, in one pass with mergeable sketches."""
    aggregates = []
    for c in columns:
        value = F.nullif(text.normalize_text(c), F.lit(""))
        distinct = F.hll_sketch_estimate(F.hll_sketch_agg(value, SKETCH_BITS))
        aggregates += [F.count(value), F.sum(F.length(value)), distinct]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()
    out = {}
    for i, c in enumerate(columns):
        n, chars, distinct = row[3 * i : 3 * i + 3]
        out[c] = (n, chars or 0, (distinct or 0) * (1 - SKETCH_MARGIN), (distinct or 0) * (1 + SKETCH_MARGIN))
    return out


def _settled(df: DataFrame, columns: list[str], meets: Callable[[int, int, float], bool], condition: str) -> list[str]:
    """Columns that meet a condition on (values, characters, distinct values) which ever more distinct values can only break.

    Sketches settle most columns; those near a limit are counted exactly, by
    the same condition over ``value_statistics``.
    """
    if not columns:
        return []
    sketched = sketched_statistics(df, columns)
    kept = {c for c, (n, chars, _, most) in sketched.items() if meets(n, chars, most)}
    near = [c for c, (n, chars, least, _) in sketched.items() if c not in kept and meets(n, chars, least)]
    if near:
        kept |= {r["column"] for r in value_statistics(df, near).filter(condition).select("column").collect()}
    return [c for c in columns if c in kept]


def categorical_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with values that look like categories: few, repeated and short."""

    def meets(n: int, chars: int, distinct: float) -> bool:
        return n > 0 and distinct <= MAX_DISTINCT and distinct / n <= MAX_RATIO and chars / n <= MAX_MEAN_LENGTH

    return _settled(df, columns, meets, is_categorical())


def is_categorical() -> str:
    """Condition on ``value_statistics`` rows that a label column must meet."""
    return f"n_distinct <= {MAX_DISTINCT} AND distinct_ratio <= {MAX_RATIO} AND mean_length <= {MAX_MEAN_LENGTH}"


def name_suggests_label(column: str) -> bool:
    snake = names.snake(column)
    return not any(w in snake for w in NON_LABEL_WORDS) and any(w in snake for w in LABEL_WORDS)


def label_columns(df: DataFrame, key: str) -> list[str]:
    """Columns whose name and values look like categorical labels."""
    return categorical_columns(df, [c for c in df.columns if c != key and name_suggests_label(c)])


def candidate_labels(df: DataFrame, excluded: list[str], max_distinct: int = 100) -> list[str]:
    """Possible target columns: known prefixes, or few distinct values."""
    rest = [c for c in df.columns if c not in excluded]
    known = [c for c in rest if c.startswith(("mit_", "gmf_", "cset"))]
    unknown = [c for c in rest if c not in known]
    # a column without any value has no distinct ones, which is few
    stats = df.select(*[F.col(c).cast("string").alias(c) for c in unknown])
    few = _settled(stats, unknown, lambda n, chars, distinct: distinct <= max_distinct, f"n_distinct <= {max_distinct}")
    return [c for c in rest if c in known or c in few]


def label_frame(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct clean values per key and column, joined; none gives null.

    Sets are merged on the map side, so a key with many rows sends its
    distinct values only. Their union is what the result row holds.
    """
    sets = [F.nullif(labels.collapse(c), F.lit("")).alias(c) for c in columns]
    return df.groupBy(key).agg(*sets)


def merge_label_frames(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge on one key, as a union and one aggregate."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in stacked.columns if c != key])


def classification_labels(
    taxonomies: dict[str, DataFrame],
) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """Wide labels per incident and per report over all datasets, and their names."""
    by_key: dict[str, list[DataFrame]] = {"incident_id": [], "report_id": []}
    found: list[str] = []
    for name, df in sorted(taxonomies.items()):
        incident = names.find_column(df.columns, names.INCIDENT_ID_STRICT)
        column = incident or names.find_column(df.columns, names.REPORT_ID_STRICT)
        if column is None:
            continue
        key = "incident_id" if incident else "report_id"
        chosen = label_columns(df, column)
        if not chosen:
            continue
        prefix = names.taxonomy_name(name)
        renamed = {c: f"{prefix}_{names.snake(c)}" for c in chosen}
        keyed = df.select(
            text.normalize_text(column).alias(key), *[F.col(c).alias(n) for c, n in renamed.items()]
        ).filter(F.col(key) != "")
        by_key[key].append(label_frame(keyed, key, list(renamed.values())))
        found += renamed.values()
    merged = [merge_label_frames(by_key[k], k) if by_key[k] else None for k in ("incident_id", "report_id")]
    return merged[0], merged[1], sorted(set(found))
