"""Operators on small frames: ordering, filters, counts, splits, components and evaluation."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook.operators import attention, components, corpus, evaluate, filters, network, ordering, places, splits, taxonomy, trends


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- ordering ---------------------------------------------------------------------

def test_row_index_is_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 <> 1")
    indexed = ordering.with_row_index(df).collect()
    assert sorted(r["row_index"] for r in indexed) == list(range(len(indexed)))
    assert [r["id"] for r in sorted(indexed, key=lambda r: r["row_index"])] == sorted(r["id"] for r in indexed)


def test_hash_rank_is_a_seeded_total_order(spark):
    df = spark.range(500)
    first = {r["id"]: r["hash_rank"] for r in ordering.hash_rank(df, "id", 42).collect()}
    again = {r["id"]: r["hash_rank"] for r in ordering.hash_rank(df.repartition(5), "id", 42).collect()}
    other = {r["id"]: r["hash_rank"] for r in ordering.hash_rank(df, "id", 7).collect()}
    assert sorted(first.values()) == list(range(1, 501)) and first == again and first != other


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 9), (1, 2)], "k int, o int")
    kept = ordering.keep_first(df, ["k"], ["o"])
    assert rows(kept) == [(1, 2), (2, 9)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_sample_is_whole_when_small(spark):
    assert ordering.sample_rows(spark.range(5), "id", 10).count() == 5
    assert ordering.sample_rows(spark.range(50), "id", 10).count() == 10


# --- filters ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def ctx(spark):
    incidents = spark.createDataFrame(
        [(1, "Robot A.B", 2020), (2, "Robot AxB", 2021), (3, "Car", None), (4, "robot a.b again", 2022)],
        "incident_id int, search_text string, incident_year int",
    )
    links = spark.createDataFrame(
        [(1, 10, "x.com", 2020), (1, 11, "y.com", 2021), (2, 12, "y.com", 2021), (4, 13, None, 2022), (4, 13, None, 2022)],
        "incident_id int, report_id int, source_domain string, report_year int",
    )
    risks = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (4, "p"), (4, "r")], "incident_id int, risk_category string")
    return filters.Context(incidents, links, risks, spark.createDataFrame([(1, "US"), (2, "DE"), (4, "US")], "incident_id int, country string"))


def ids(df):
    return sorted(r["incident_id"] for r in df.collect())


def test_filters(ctx):
    assert ids(filters.filter_context(ctx, years=(2020, 2021)).incidents) == [1, 2]
    # The keyword is literal, so the dot matches only a dot.
    assert ids(filters.filter_context(ctx, keyword=" A.B ").incidents) == [1, 4]
    by_risk = filters.filter_context(ctx, risks=["p"])
    assert ids(by_risk.incidents) == [1, 4] and rows(by_risk.risk_long) == [(1, "p"), (1, "q"), (4, "p"), (4, "r")]
    by_domain = filters.filter_context(ctx, risks=["q"], domains=["x.com"])
    assert ids(by_domain.incidents) == [1] and ids(by_domain.incident_reports) == [1] and ids(by_domain.locations) == [1]
    everything = filters.filter_context(ctx)
    assert ids(everything.incidents) == [1, 2, 3, 4] and ids(everything.incident_reports) == [1, 1, 2, 4, 4]


def test_filter_cluster_records(spark):
    df = spark.createDataFrame(
        [(0, "2020", "a | b", "x", "Text One"), (1, "bad", "b", "y", "two"), (1, "2022", None, "x", "THREE")],
        "cluster_label int, incident_year string, mit_risk_domain string, source_domain string, input_text string",
    )
    assert filters.filter_cluster_records(df, years=(2020, 2022)).count() == 2
    assert filters.filter_cluster_records(df, risks=["b"]).count() == 2
    assert filters.filter_cluster_records(df, keyword="three", cluster="1").count() == 1
    assert filters.filter_cluster_records(df, cluster="one").count() == 3
    assert filters.filter_cluster_records(df, cluster="__all__", domains=["x"]).count() == 2


# --- counts -----------------------------------------------------------------------

def test_risk_by_year(ctx):
    out = trends.risk_by_year(ctx.incidents, ctx.incident_reports, ctx.risk_long, "reports", 2)
    got = {(r["year"], r["risk_category"]): (r["count"], r["share"]) for r in out.collect()}
    # p: 1 + 0 + 2, q: 1 + 2, r: 2; the two largest stay and shares are theirs.
    assert got == {(2020, "p"): (1, 0.5), (2020, "q"): (1, 0.5), (2021, "p"): (1, 1 / 3), (2021, "q"): (2, 2 / 3), (2022, "p"): (2, 1.0)}
    by_incident = trends.risk_by_year(ctx.incidents, ctx.incident_reports, ctx.risk_long, "incidents", 1)
    assert rows(by_incident.select("year", "risk_category", "count")) == [(2020, "p", 1), (2022, "p", 1)]


def test_rolling_average_skips_missing_years(spark):
    df = spark.createDataFrame([(2010, 3), (2015, 5), (2016, 10), (2020, 0)], "year int, count long")
    got = {r["year"]: r["rolling"] for r in trends.rolling_average(df).collect()}
    assert got == {2010: 3.0, 2015: 4.0, 2016: 6.0, 2020: 5.0}


def test_heatmap_and_rank(spark):
    df = spark.createDataFrame([(2020, "a", 3), (2020, "b", 3), (2021, "a", 1)], "year int, risk_category string, count long")
    assert rows(trends.heatmap_share(df)) == [("a", 2020, 3, 0.5), ("a", 2021, 1, 1.0), ("b", 2020, 3, 0.5), ("b", 2021, 0, 0.0)]
    assert {r["rank"] for r in trends.risk_rank(df).collect()} == {1}
    assert rows(trends.pivot_years(df, trends.year_list(df))) == [("a", 3, 1), ("b", 3, 0)]


def test_attention_and_lorenz(ctx):
    table = attention.attention(ctx.incidents, ctx.incident_reports)
    assert rows(table.select("incident_id", "report_count")) == [(1, 2), (2, 1), (3, 0), (4, 1)]
    curve = rows(attention.lorenz_curve(table))
    assert curve == [(0.0, 0.0), (0.25, 0.0), (0.75, 0.5), (1.0, 1.0)]
    assert [r["incident_id"] for r in attention.top_incidents(table, 2).collect()] == [1, 2]
    assert [r["incident_id"] for r in attention.evidence_table(table.withColumn("incident_title", F.lit("t"))).collect()] == [4, 2, 1, 3]
    bins = rows(attention.attention_histogram(table))
    assert sum(b[2] for b in bins) == 4 and bins[-1][0] == 5
    empty = attention.lorenz_curve(table.withColumn("report_count", F.lit(0)))
    assert empty.isEmpty()


def test_kpi_keeps_unfiltered_categories(ctx):
    few = filters.filter_context(ctx, years=(2020, 2020))
    row = attention.kpi_summary(few.incidents, few.incident_reports, ctx.risk_long).first()
    assert tuple(row) == (1, 2, "2020 - 2020", 3)
    none = filters.filter_context(ctx, years=(1900, 1901))
    assert attention.kpi_summary(none.incidents, none.incident_reports, ctx.risk_long).first()["year_range"] == "N/A"


def test_incident_detail(ctx):
    links = ctx.incident_reports.withColumns({"report_title": F.lit("t"), "report_url": F.lit("u")})
    table = attention.attention(ctx.incidents, links)
    assert attention.incident_detail(table, ctx.risk_long, links).first()["incident_id"] == 1
    named = attention.incident_detail(table, ctx.risk_long, links, 4).first()
    assert named["incident_id"] == 4 and named["risk_categories"] == "p, r" and named["source_examples"] == "t <u>"
    assert attention.incident_detail(table, ctx.risk_long, links, 99).first()["incident_id"] == 1


def test_countries(spark):
    df = spark.createDataFrame(
        [(1, "US", "Boston"), (1, "US", "NYC"), (2, "US", "Boston"), (3, None, "Paris"), (4, "DE", None)],
        "incident_id int, country string, location_label string",
    )
    assert rows(places.country_counts(df)) == [("US", 3)]
    assert rows(places.country_counts(df, fallback=True)) == [("DE", 1), ("Paris", 1), ("US", 3)]


def test_country_codes_and_map(spark):
    countries = spark.createDataFrame([("US", "USA", "United States"), ("DE", "DEU", "Germany")], "code2 string, code3 string, name string")
    df = spark.createDataFrame([("us", 1), ("Germany", 100), ("global", 5), ("--", 1), ("", 1), ("XX", 2)], "country_label string, count long")
    coded = places.country_iso(df, countries)
    assert {r["country_label"]: r["iso_alpha"] for r in coded.collect()} == {"us": "USA", "Germany": "DEU", "global": None, "--": None, "": None, "XX": None}
    assert {(r["location"], r["bubble_size"]) for r in places.map_table(coded).collect()} == {("USA", 8.0), ("DEU", 28.0)}
    unknown = places.map_table(coded.withColumn("iso_alpha", F.lit(None).cast("string")))
    assert unknown.count() == 6


def test_network(ctx):
    incidents = ctx.incidents.withColumn("incident_title", F.lit(""))
    table = attention.attention(incidents, ctx.incident_reports)
    pairs = network.network_table(table, ctx.risk_long, ctx.incident_reports)
    assert pairs.count() == 2 * 2 + 1 + 2
    assert [r["incident_id"] for r in network.top_network_incidents(pairs, 2).collect()] == [1, 2]
    assert rows(network.edges(table, ctx.risk_long, ctx.incident_reports, 2)) == [
        ("incident::1", "risk::p"), ("incident::1", "risk::q"), ("incident::1", "source::x.com"), ("incident::1", "source::y.com"),
        ("incident::2", "risk::q"), ("incident::2", "source::y.com"),
    ]
    assert len(rows(network.nodes(table, ctx.risk_long, ctx.incident_reports, 2))) == 6
    # A missing source is no node.
    last = [r[1] for r in rows(network.edges(table, ctx.risk_long, ctx.incident_reports, 9)) if r[0] == "incident::4"]
    assert last == ["risk::p", "risk::r"]


# --- taxonomies -------------------------------------------------------------------

def test_taxonomy_variants(spark):
    gmf = spark.createDataFrame([(1, "a, b,", "t"), (2, None, "t"), (None, "c", "t")], "incident_id int, known_ai_technical_failure string, known_ai_technology string")
    assert rows(taxonomy.taxonomy_long("classifications_GMF", gmf)) == [("1", "GMF", "a", "t"), ("1", "GMF", "b", "t")]
    mit = spark.createDataFrame([(1, "Privacy", None)], "incident_id int, risk_domain string, risk_subdomain string")
    assert rows(taxonomy.risk_long({"classifications_GMF": gmf, "classifications_MIT": mit})) == [("1", "MIT", "Privacy", "")]
    notes = []
    assert taxonomy.risk_long({"classifications_GMF": gmf, "classifications_MIT": mit.limit(0)}, notes).count() == 2 and notes
    no_key = spark.createDataFrame([("x",)], "category string")
    assert taxonomy.taxonomy_long("classifications_other", no_key, notes).isEmpty() and len(notes) == 2


def test_label_columns(spark):
    data = [(i, "ab"[i % 2], f"unique {i}", "notes", None) for i in range(40)]
    df = spark.createDataFrame(data, "incident_id int, harm_level string, risk_detail string, sector_notes string, task string")
    assert taxonomy.label_columns(df, "incident_id") == ["harm_level"]
    assert taxonomy.label_columns(df.select("incident_id"), "incident_id") == []


def test_merge_label_frames(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, b string")
    assert rows(taxonomy.merge_label_frames([a, b], "k").na.fill("-")) == [(1, "x", "y"), (2, "-", "z")]


# --- components and splits -----------------------------------------------------------

def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, h in pairs:
        a, b = find(("u", u)), find(("h", h))
        if a != b:
            parent[a] = b
    groups = {}
    for u in {u for u, _ in pairs}:
        groups.setdefault(find(("u", u)), []).append(u)
    return sorted((u, min(g)) for g in groups.values() for u in g)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components_match_union_find(spark, pairs):
    df = spark.createDataFrame(pairs, "incident_id int, report_id int")
    assert rows(components.connected_components(df)) == union_find(pairs)


def test_components_long_chain_and_hub(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    chain = [(order[i], 1000 + i) for i in range(60)] + [(order[i + 1], 1000 + i) for i in range(59)]
    hub = [(100 + i, 5000) for i in range(200)]
    pairs = chain + hub
    df = spark.createDataFrame(pairs, "incident_id int, report_id int")
    assert rows(components.connected_components(df)) == union_find(pairs)


def test_hub_gives_no_pairs(spark):
    hub = spark.createDataFrame([(i, 1) for i in range(300)], "incident_id int, report_id int")
    assert components._hub_edges(hub, "incident_id", "report_id").count() == 299


def test_label_limits_by_sketch(spark, monkeypatch):
    """Sketches settle clear columns; one at a limit is counted exactly."""
    rows = [(f"v{i % 600}", f"w{i % 601}", f"x{i}", "y" * 200 + str(i % 3), str(i % 5), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "at string, over string, unique string, long string, clear string, none string")
    assert taxonomy.categorical_columns(df, df.columns) == ["at", "clear"]
    asked = []
    exact = taxonomy.value_statistics
    monkeypatch.setattr(taxonomy, "value_statistics", lambda d, c: asked.append(c) or exact(d, c))
    assert taxonomy.categorical_columns(df, df.columns) == ["at", "clear"] and asked == [["at", "over"]]
    assert taxonomy.candidate_labels(df, ["at"], max_distinct=5) == ["long", "clear", "none"]
    assert taxonomy.categorical_columns(df, []) == []


def test_hub_is_not_gathered(spark):
    """Two thirds of the edges end in one node; no task gets twice the rows of the median task."""
    pairs = [(i, 0) for i in range(1, 20_001)] + [(30_000 + i, 29_999 - i) for i in range(9_000)]
    edges = spark.createDataFrame(pairs, "v int, u int").repartition(8)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hubs = components._hubs(edges, len(pairs))
        joined = components._with_least(edges, hubs)
        sizes = sorted(r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        assert {(r["u"], r["m"]) for r in joined.filter("u = 0 OR u = 29999").collect()} == {(0, 1), (29_999, 30_000)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert hubs == [0] and sum(sizes) == len(pairs) and sizes[-1] < 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("spec,expected", [
    ("80/20", (0.8, 0.0, 0.2)), ("0.8/0.2", (0.8, 0.0, 0.2)), ("70/15/15", (0.7, 0.15, 0.15)), ("0.7/0.2/0.1", (0.7, 0.2, 0.1)),
])
def test_split_spec(spec, expected):
    assert splits.parse_split_spec(spec) == pytest.approx(expected)


@pytest.mark.parametrize("spec", ["80", "80/30", "1/2/3/4", "-1/2", "a/b"])
def test_bad_split_spec(spec):
    with pytest.raises(ValueError):
        splits.parse_split_spec(spec)


@pytest.mark.parametrize("n,fractions,sizes", [
    (1, (0.8, 0.0, 0.2), {"train": 1}), (7, (0.8, 0.0, 0.2), {"train": 5, "test": 2}),
    (10, (0.7, 0.2, 0.1), {"train": 7, "val": 2, "test": 1}), (33, (0.7, 0.15, 0.15), {"train": 23, "val": 5, "test": 5}),
])
def test_split_sizes(spark, n, fractions, sizes):
    groups = spark.range(n).select(F.col("id").alias("component"))
    got = {r["split"]: r["count"] for r in splits.split_groups(groups, "component", fractions).groupBy("split").count().collect()}
    assert got == sizes


def test_group_split_keeps_groups_together(spark):
    groups = spark.range(200).select(F.col("id").alias("incident_id"), (F.col("id") % 23).alias("component"))
    named = groups.join(splits.group_split(groups, (0.7, 0.15, 0.15)), "incident_id")
    assert splits.leaks(named, "component").isEmpty()
    splits.verify_no_leaks(named, "t")
    with pytest.raises(ValueError, match="at least three|at least 3"):
        splits.group_split(groups.filter("component < 2"), (0.7, 0.15, 0.15), min_groups=3)


def test_assign_splits(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["Train"] * 10 + ["TEST"] * 3)], "incident_id int, split string")
    groups = df.select("incident_id", F.col("incident_id").alias("component"))
    carved = {r["split"]: r["count"] for r in splits.assign_splits(df, groups, (0.7, 0.15, 0.15)).groupBy("split").count().collect()}
    assert carved == {"train": 8, "val": 2, "test": 3}
    done = df.union(spark.createDataFrame([(20, "validation")], df.schema))
    assert {r["split"] for r in splits.assign_splits(done, groups, (0.7, 0.15, 0.15)).collect()} == {"train", "val", "test"}
    fresh = splits.assign_splits(df.filter("split = 'Train'"), groups, (0.6, 0.2, 0.2))
    assert {r["split"] for r in fresh.collect()} == {"train", "val", "test"}


def test_leak_message(spark):
    df = spark.createDataFrame([(1, 5, "train"), (1, 6, "test")], "incident_id int, report_id int, split string")
    with pytest.raises(ValueError, match="incident_id appears in multiple splits: 1"):
        splits.verify_no_leaks(df, "x")


def test_clean_and_modeling(spark):
    df = spark.createDataFrame(
        [("1", "r", "long  enough text", "a", 2), ("1", "r", "long enough text", None, 1), ("2", "r", "short", "b", 1)],
        "incident_id string, report_id string, input_text string, lab string, o int",
    )
    assert [r["o"] for r in corpus.clean_examples(df, 10, order=["o"]).collect()] == [1]
    assert [r["o"] for r in corpus.clean_examples(df, 10, ["lab"], ["o"]).collect()] == [2]
    with pytest.raises(ValueError):
        corpus.clean_examples(df, 10, [])
    frame = corpus.modeling_frame(df, "lab", min_chars=3)
    assert frame.count() == 2
    with pytest.raises(ValueError, match="at least 2"):
        corpus.require_classes(frame.filter("target_label = 'a'"))
    encoded, mapping = corpus.encode_labels(frame)
    assert rows(mapping) == [(0, "a"), (1, "b")] and encoded.count() == 2


# --- evaluation ----------------------------------------------------------------------

# Published confusion matrix of a seven-class text classifier, rows are true classes.
MATRIX = [
    [151, 2, 8, 2, 1, 0, 28], [2, 58, 3, 46, 0, 0, 0], [2, 3, 77, 15, 2, 0, 3], [5, 7, 13, 325, 0, 0, 2],
    [1, 0, 5, 1, 3, 0, 20], [0, 0, 0, 0, 0, 8, 1], [60, 3, 17, 3, 5, 0, 204],
]


def test_published_metrics(spark):
    pairs = spark.createDataFrame(
        [(str(i), str(j), n) for i, row in enumerate(MATRIX) for j, n in enumerate(row) if n], "true_label string, predicted_label string, count long"
    )
    row = evaluate.classification_metrics(pairs).first()
    assert row["accuracy"] == pytest.approx(0.7605893186003683)
    assert row["macro_f1"] == pytest.approx(0.6794334254906735)
    assert row["weighted_f1"] == pytest.approx(0.7520088196923811)
    report = {r["label"]: r for r in evaluate.classification_report(pairs).collect()}
    assert report["5"]["f1_score"] == pytest.approx(0.9411764705882353) and report["4"]["support"] == 30
    averages = {r["label"]: r for r in evaluate.report_averages(evaluate.classification_report(pairs)).collect()}
    assert averages["macro avg"]["precision"] == pytest.approx(0.7137573294941115)
    assert averages["weighted avg"]["precision"] == pytest.approx(0.7564863650373223)
    assert evaluate.confusion_matrix(pairs).count() == 49


def test_classes_on_one_side_only(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "true_label string, predicted_label string")
    report = {r["label"]: tuple(r)[1:] for r in evaluate.classification_report(evaluate.pair_counts(df)).collect()}
    assert report == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 0)}


def test_largest(spark, monkeypatch):
    counts = [(f"{'w' * (i % 9)}{i}", 1 + i % 7) for i in range(400)] + [("w", 4), ("ww", 4), ("wwé", 4), ("big", 1000)]
    df = spark.createDataFrame(counts, "name string, n bigint")
    want = sorted(counts, key=lambda r: (-r[1], r[0].encode()))
    for few in (0, 10_000):
        monkeypatch.setattr(ordering, "FEW_TIES", few)
        for n in (0, 1, 59, 183, 404) if few else (2, 61, 180, 300):
            got = ordering.largest(df, "n", "name", n).collect()
            assert sorted(map(tuple, got)) == sorted(want[:n]), (few, n)


# --- plans that do their work once -----------------------------------------------

def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_filtered_tables_follow_ids_found_once(spark):
    incidents = spark.createDataFrame([(1, 2020, "a"), (1, 2021, "a"), (2, 2020, "a"), (None, 2020, "a")], "incident_id int, incident_year int, search_text string")
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "x")], "incident_id int, source_domain string")
    risks = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (None, "p")], "incident_id int, risk_category string")
    ctx = filters.Context(incidents, links, risks, spark.createDataFrame([(1, "aa"), (2, "bb")], "incident_id int, country string"))
    out = filters.filter_context(ctx, years=(2020, 2020), risks=["p"], domains=["x"])
    assert [plan(df).count("Join") for df in (out.incidents, out.incident_reports, out.risk_long, out.locations)] == [1, 1, 1, 1]
    assert rows(out.incidents) == [(1, 2020, "a")] and rows(out.incident_reports) == [(1, "x")]
    assert rows(out.risk_long) == [(1, "p"), (1, "q")] and rows(out.locations) == [(1, "aa")]
    assert filters.filter_context(ctx, years=(2020, 2020)).incidents.count() == 3  # an incident without id stays


def test_rollup_moves_links_once(spark):
    links = spark.createDataFrame([(1, 7, "a", "T"), (1, 7, "b", "t"), (1, 8, None, " T "), (2, None, "nan", "['u', 'N/A']")], "incident_id int, report_id int, source_domain string, report_title string")
    out = corpus.incident_rollup(links.repartition(3, "report_id"))
    assert rows(out) == [(1, 2, "a | b", "T | t"), (2, 0, "", "u")]
    assert plan(corpus.incident_rollup(links), "executedPlan").count("Exchange") == 1


def test_fields_of_a_text_are_cleaned_once(spark):
    df = spark.createDataFrame([(" a  b ", "A B", "c")], "u string, v string, w string")
    out = corpus.add_text(df, [("One", "u"), ("Two", "v"), ("Three", "w")])
    assert rows(out.select("input_text")) == [("One: a b Three: c",)] and out.columns == ["u", "v", "w", "input_text"]
    kept = spark.range(1).select(F.concat("id", F.lit(" x")).alias("u"), F.col("id").cast("string").alias("v"), F.lit("y").alias("w"))
    assert plan(corpus.add_text(kept, [("One", "u"), ("Two", "v")])).count("regexp_replace") == 2


def test_checked_corpus_rows_are_made_once(spark):
    from casebook.plans.corpus import build_corpus

    incidents = spark.createDataFrame([(str(i), f"title {i}", "", [f"r{i}"]) for i in range(6)], "incident_id string, incident_title string, incident_description string, incident_report_ids array<string>")
    reports = spark.createDataFrame(
        [(f"r{i}", "", "", f"a text of some length, long enough to be kept {i}", "", "Unknown") for i in range(6)],
        "report_id string, direct_incident_id string, report_title string, report_text string, report_url string, source_domain string",
    )
    labels = {"classifications_CSETv1": spark.createDataFrame([(i, "s") for i in range(6)], "incident_id int, sector_of_deployment string")}
    built = build_corpus(incidents, reports, labels)
    assert built.classification_ready.count() == 6 and "Window" not in plan(built.classification_ready)
