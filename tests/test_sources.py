"""Headers, folders of CSV files, canonical tables and sinks."""

import pytest
from pyspark.sql import functions as F

from casebook.operators import links, prepare, taxonomy
from casebook.plans import corpus, dashboard
from casebook.sources import catalog, names, sinks


def test_headers():
    assert names.unique_snake([" Incident ID", "incident-id", "", "!!", "A__b"]) == [
        "incident_id", "incident_id_2", "column", "column_2", "a_b",
    ]
    assert names.unique_snake(["a", "a", "a_2", "a", "a_2"]) == ["a", "a_2", "a_2_2", "a_3", "a_2_3"]
    assert names.taxonomy_name("classifications_CSETv1") == "csetv1"


def test_find_column():
    columns = ["evidence", "the_title", "name"]
    assert names.find_column(columns, names.TITLE) == "name"
    # A containing match accepts any header with the candidate inside it.
    assert names.find_column(columns, ["id"]) == "evidence"
    assert names.find_column(["x"], names.TITLE) is None
    with pytest.raises(ValueError, match="Looked for title.*among x"):
        names.require_column(["x"], names.TITLE, "incidents", "title")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "incidents.csv").write_text(
        "Incident ID,Title,Description,Date,Reports,Alleged deployer of AI system\n"
        '1,First,"Line one\nline two with ""quotes""",2020-05-01,"[11, 12]",Acme\n'
        "2,Second,Other,2021-01-01,[12],\n"
        "2,Second again,Other,2021-01-01,[13],\n"
        ",No id,x,2021-01-01,[13],\n"
        "3,Third,,unknown,[99],\n"
    )
    (tmp_path / "reports.csv").write_text(
        "report_number,title,text,url,date_published\n"
        "11,R1,some report text that is long enough to stay in,https://www.a.com/x,2020-06-01\n"
        "12,R2,another report text that is long enough to stay,https://b.org/y,2021-02-01\n"
        "13,R3,third report text that is long enough to stay in,,2021-02-01\n"
    )
    (tmp_path / "classifications_MIT.csv").write_text(
        "Incident ID,Risk Domain,Risk Subdomain\n1,Privacy,p1\n2,Safety,s1\n3,,\n"
    )
    (tmp_path / "classifications_CSETv1.csv").write_text(
        "Incident ID,Sector of Deployment,Location Country (two letters),Location City\n1,transport,US,Boston\n1,transport,US,Boston\n2,,,\n3,health,DE,\n"
    )
    (tmp_path / "empty.csv").write_text("")
    return str(tmp_path)


def test_catalog(spark, folder):
    loaded = catalog.load_folder(spark, folder)
    assert sorted(loaded.tables) == ["classifications_CSETv1", "classifications_MIT", "incidents", "reports"]
    assert [r["name"] for r in loaded.load_errors(spark).collect()] == ["empty"]
    assert loaded.get("missing", "reports").columns[0] == "report_number"
    first = loaded.tables["incidents"].filter("incident_id = '1'").first()
    assert first["description"] == 'Line one\nline two with "quotes"'
    assert catalog.load_folder(spark, folder + "/nowhere").tables == {}
    notes = []
    assert catalog.read_optional(spark, folder + "/nothing.csv", notes) is None and "not found" in notes[0]


def test_records_with_a_cell_too_many_or_too_few(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,name\n1,"x, y",u\n2,b,c,d\n3\n\n4,,""\n')
    part = tmp_path / "b.csv"
    part.mkdir()
    (part / "part-0").write_text("id\n7\n")
    (part / "part-1").write_text("id\n8\n9,9\n")
    deeper = tmp_path / "more"
    deeper.mkdir()
    (deeper / "c.csv").write_text("id\n1\n")
    loaded = catalog.load_folder(spark, str(tmp_path) + "/")
    assert sorted(loaded.tables) == ["a", "b"] and loaded.tables["a"].columns == ["id", "name", "name_2"]
    assert [tuple(r) for r in loaded.tables["a"].orderBy("id").collect()] == [("1", "x, y", "u"), ("2", "b", "c"), ("3", None, None), ("4", None, None)]
    assert sorted(r["id"] for r in loaded.tables["b"].collect()) == ["7", "8", "9"]
    bad = loaded.bad_records(spark)
    assert sorted(tuple(r) for r in bad.collect()) == [("a", "a.csv", "2,b,c,d"), ("a", "a.csv", "3"), ("b", "part-1", "9,9")]
    assert sorted(r["record"] for r in bad.select("record").collect()) == ["2,b,c,d", "3", "9,9"]
    assert bad.count() == 3 and catalog.Catalog().bad_records(spark).isEmpty()


def test_csv_round_trip_of_odd_texts(spark, tmp_path):
    odd = ["", None, ' "q" ', "a,b", "line\nbreak\r\nand \\ slash", '"', "\\"]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, text string")
    sinks.write_csv(df, str(tmp_path / "odd.csv"))
    back = catalog.load_folder(spark, str(tmp_path))
    assert [r["text"] for r in back.tables["odd"].orderBy("id").collect()] == [x or None for x in odd]
    assert back.bad_records(spark).isEmpty()


def test_check_columns(spark):
    df = spark.createDataFrame([(1, "a")], "a int, mit_x string")
    with pytest.raises(ValueError, match="Missing required column.*b.*Candidate label columns: mit_x"):
        catalog.check_columns(df, ["a", "b"], taxonomy.candidate_labels(df, ["a"]))


def test_dashboard_tables(spark, folder):
    data = dashboard.prepare_data(spark, folder)
    incidents = {(r["incident_id"], r["incident_title"]): r for r in data.incidents.collect()}
    assert len(incidents) == 4
    assert incidents[("1", "First")]["report_ids"] == ["11", "12"] and incidents[("3", "Third")]["incident_year"] is None
    found = {(r["incident_id"], r["report_id"], r["source_domain"]) for r in data.incident_reports.collect()}
    assert ("1", "11", "www.a.com") in found and ("2", "13", "Unknown") in found and ("3", "99", None) in found
    assert {(r["incident_id"], r["risk_category"]) for r in data.risk_long.collect()} == {("1", "Privacy"), ("2", "Safety")}
    places = {(r["incident_id"], r["country"], r["location_label"]) for r in data.locations.collect()}
    assert places == {("1", "US", "Boston"), ("3", "DE", None)}
    meta = {(r["kind"], r["value"]) for r in data.metadata().collect()}
    assert {("incident_year_min", "2020"), ("incident_year_max", "2021"), ("risk_category", "Privacy"), ("risk_category", "Safety")} <= meta


def test_empty_folder(spark, tmp_path):
    data = dashboard.prepare_data(spark, str(tmp_path))
    assert data.incidents.isEmpty() and data.risk_long.isEmpty() and data.locations is None and len(data.notes) >= 4


def test_corpus_from_folder(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    built = corpus.corpus_from_folder(spark, folder, out, "50/50")
    rows = {(r["incident_id"], r["report_id"]): r for r in built.report_level.collect()}
    # The first of two equal incident ids is kept, so report 13 has no incident.
    assert set(rows) == {("1", "11"), ("1", "12"), ("2", "12")}
    # All risk domains differ, which is too many for a label column.
    assert built.label_columns == ["csetv1_sector_of_deployment"]
    assert rows[("1", "11")]["input_text"].startswith("Report title: R1 Incident title: First Incident description: Line one line two")
    # Incidents 1 and 2 share report 12, so they share a split.
    splits = {r["incident_id"]: r["split"] for r in built.incident_level.collect()}
    assert splits["1"] == splits["2"] and set(splits) == {"1", "2", "3"} and set(splits.values()) == {"train", "test"}
    levels = {r["incident_id"]: r for r in built.incident_level.collect()}
    assert levels["3"]["joined_report_count"] == 0 and levels["1"]["source_domains"] == "a.com | b.org"
    back = spark.read.parquet(out + "/report_level")
    assert back.count() == 3


def test_generated_report_ids(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c")], "incident_id string, title string").repartition(3)
    ids = sorted(r["report_id"] for r in prepare.corpus_reports(df).collect())
    assert ids == ["generated_report_0", "generated_report_1", "generated_report_2"]
    with pytest.raises(ValueError, match="either a report ID or an incident ID"):
        prepare.corpus_reports(spark.createDataFrame([("a",)], "title string"))


def test_join_strategies(spark):
    incidents = spark.createDataFrame([("1", "t", ["7"]), ("2", "u", [])], "incident_id string, incident_title string, incident_report_ids array<string>")
    direct = spark.createDataFrame([("7", "2"), ("8", "")], "report_id string, direct_incident_id string")
    assert [r["incident_id"] for r in links.report_level(direct, incidents).collect()] == ["2"]
    listed = spark.createDataFrame([("7", ""), ("8", "")], "report_id string, direct_incident_id string")
    assert [(r["incident_id"], r["report_id"]) for r in links.report_level(listed, incidents).collect()] == [("1", "7")]
    with pytest.raises(ValueError, match="no report-link column"):
        links.report_level(listed, incidents, has_links=False)


def test_links_fallback(spark):
    incidents = spark.createDataFrame(
        [("1", "t", "d", 2020, [])], "incident_id string, incident_title string, incident_description string, incident_year int, report_ids array<string>"
    )
    reports = prepare.reports(spark.createDataFrame([("5", 1)], "report_number string, incident_id int"))
    assert [(r["incident_id"], r["report_id"]) for r in links.incident_reports(incidents, reports).collect()] == [("1", "5")]


def test_long_chain_and_cycle_of_duplicates(spark):
    chain = spark.range(300).select(F.col("id").alias("duplicate_incident_number"), (F.col("id") + 1).alias("true_incident_number"))
    df = spark.createDataFrame([("0",), ("299",), ("x",)], "incident_id string")
    assert sorted(r["incident_id"] for r in prepare.resolve_duplicates(df, chain).collect()) == ["300", "300", "x"]
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "duplicate_incident_number int, true_incident_number int")
    with pytest.raises(ValueError, match="cycle"):
        prepare.resolve_duplicates(df, cycle)


def test_resolve_duplicates(spark):
    pairs = spark.createDataFrame([(342, 88), (88, 1057), (365, 95)], "duplicate_incident_number int, true_incident_number int")
    df = spark.createDataFrame([(342,), (88,), (365,), (7,)], "incident_id int")
    assert sorted(r["incident_id"] for r in prepare.resolve_duplicates(df, pairs).collect()) == ["1057", "1057", "7", "95"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    sinks.write_by_split(df, str(tmp_path / "s"))
    read = sinks.read_split(spark, str(tmp_path / "s"), "test")
    assert [r["id"] for r in read.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().toString()
    sinks.write_config(spark, {"k": 12}, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == '{"k": 12}'


def test_cast_cluster_label(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("x",), (None,)], "cluster_label string")
    assert [r[0] for r in catalog.cast_cluster_label(df).collect()] == [1, 2]
