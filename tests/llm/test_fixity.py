from pyspark.sql import functions as F

from casebook.llm import fixity, queries


def test_locates_damage(llm, texts):
    pages = [(i, f"https://h/{i}", texts.prose(10)) for i in range(1500)] + [(None, None, None), (7, "https://h/7", "again"), (7, "https://h/7", "again")]
    df = llm.createDataFrame(pages, "page_id bigint, url string, html string")
    archive = fixity.records(df)
    body = bytes(archive.filter("page_id = 3").first().record)
    assert body.startswith(b"WARC/1.0\r\n") and body.endswith(pages[3][2].encode() + b"\r\n\r\n")
    sound = fixity.index(archive).cache()
    whole = sound.orderBy("file", "ordinal").collect()
    ends = {}
    for r in whole:
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.length
    assert fixity.audit(sound, sound).count() == 0
    other = sound.filter("NOT (file = 1 AND ordinal = 100)").withColumn("digest", F.when(F.expr("file = 2 AND ordinal IN (0, 200)"), F.lit("x")).otherwise(F.col("digest")))
    extra = sound.limit(1).select(F.lit(-9).cast("bigint").alias("file"), "page_id", "length", "digest", F.lit(4).cast("bigint").alias("ordinal"), "offset")
    found = {(r.file, r.ordinal, r.state) for r in fixity.audit(sound, other.unionByName(extra)).collect()}
    assert found == {(1, 100, "missing"), (2, 0, "altered"), (2, 200, "altered"), (-9, 4, "extra")}
    assert fixity.audit(sound.limit(0), sound.limit(0)).count() == 0
    changed = fixity.damaged(archive, F.col("page_id") == 1, F.col("page_id") == 2, F.col("page_id") == 3)
    sizes = {r.page_id: len(r.record) for r in changed.filter("page_id < 4").collect()}
    assert 2 not in sizes and sizes[3] == len(body) // 2 and sizes[1] == len(bytes(archive.filter("page_id = 1").first().record))


def test_query_on_repeated_and_null_ids(llm, tmp_path):
    """Only what the query damages is reported, one row for each listed record."""
    pages = [(1, "u", "a"), (7, "u", "b"), (7, "u", "b"), (7, "u", "c"), (23, "u", "d"), (23, "u", "d"), (41, "u", "e"), (None, "u", "f"), (None, "u", "f"), (None, None, None), (607, "u", "g")]
    llm.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.QUERIES["op9_warc_fixity"](llm, str(tmp_path)).collect()
    assert sorted((r.page_id, r.ordinal, r.state) for r in out) == [
        (7, 1, "altered"), (7, 2, "altered"), (7, 3, "altered"), (23, 4, "missing"), (23, 5, "missing"), (41, 6, "altered"), (607, 0, "altered")
    ]
    llm.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.QUERIES["op9_warc_fixity"](llm, f"{tmp_path}/none").count() == 0


def test_plan_grows_with_the_levels(llm):
    """Levels are written once: the audit itself holds no aggregate over them."""
    rows = llm.range(5000).select((F.col("id") % 3).alias("file"), F.col("id").alias("page_id"), F.encode(F.col("id").cast("string"), "UTF-8").alias("record"))
    plan = fixity.audit(*fixity.damaged_pair(rows, F.col("page_id") == 5, F.col("page_id") == 6, F.col("page_id") == 8))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    assert sorted((r.page_id, r.state) for r in plan.collect()) == [(5, "altered"), (6, "missing"), (8, "altered")]
