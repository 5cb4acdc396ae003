"""TF-IDF, classifiers, embeddings, clusters, neighbours, plans and streams."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.operators import clusters, features, models, neighbours
from casebook.session import few
from casebook.plans import clustering, scoring, training
from casebook.streaming import reports as stream

PLAIN = features.TermSettings()


@pytest.fixture(scope="module")
def docs(spark):
    animal = ["cat dog horse", "dog cat bird", "horse bird dog cat", "bird horse"]
    tool = ["hammer saw nail", "saw drill hammer", "nail drill", "drill saw hammer nail"]
    data = [(i, f"{t} item {w} text number {i}", g, f"{g} | {w.split()[0]}") for i, (t, g, w) in enumerate(
        [("zoo", "animal", animal[i % 4]) for i in range(16)] + [("shed", "tool", tool[i % 4]) for i in range(16)]
    )]
    return spark.createDataFrame(data, "doc_id int, text string, kind string, problem string").repartition(3)


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc"), (3, "")], "id int, text string")
    model = features.fit_tfidf(df, "text", features.TermSettings(sublinear=True))
    got = {(r["id"], r["term"]): r["weight"] for r in features.with_terms(features.weights_long(model.transform(df, "text"), "id"), model).collect()}
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in (("aa", 1), ("bb", 2), ("cc", 1))}
    raw = {"aa": (1 + math.log(2)) * idf["aa"], "bb": idf["bb"]}
    length = math.hypot(*raw.values())
    assert got[(1, "aa")] == pytest.approx(raw["aa"] / length) and got[(1, "bb")] == pytest.approx(raw["bb"] / length)
    assert set(got) == {(1, "aa"), (1, "bb"), (2, "bb"), (2, "cc")}


def test_vocabulary_limits(spark):
    df = spark.createDataFrame([("aa bb bb",), ("aa bb cc",), ("aa dd dd dd",)], "text string")
    def terms(**kw):
        return [r["term"] for r in features.vocabulary(df, "text", features.TermSettings(**kw), 3).collect()]
    assert terms() == ["aa", "bb", "dd", "cc"]
    assert terms(min_df=2) == ["aa", "bb"] and terms(max_df=0.9) == ["bb", "dd", "cc"] and terms(max_features=2) == ["aa", "bb"]
    with pytest.raises(ValueError):
        features.fit_tfidf(df, "text", features.TermSettings(min_df=4))


def test_transform_does_not_shuffle(docs):
    model = features.fit_tfidf(docs, "text", PLAIN)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(model.transform(docs, "text")) == exchanges(docs)


def test_terms_are_counted_some_texts_at_a_time():
    texts = [["aa", "bb", "aa", "bb"], [], None, ["bb"], ["cc", "aa", "bb"], ["aa", "bb"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.string()))], ["words"]) for t in (texts[:2], texts[2:], [])]
    pairs = [(w or []) + [f"{a} {b}" for a, b in zip((w or [])[:-1], (w or [])[1:])] for w in texts]
    cf, df = Counter(t for x in pairs for t in x), Counter(t for x in pairs for t in set(x))
    for at_once, most in ((1, 3), (4, 2), (100, 1)):
        got = [r for b in features._counted(iter(batches), True, at_once) for r in b.to_pylist()]
        assert {t: (sum(r["cf"] for r in got if r["term"] == t), sum(r["df"] for r in got if r["term"] == t)) for t in {r["term"] for r in got}} == {t: (cf[t], df[t]) for t in cf}
        assert max(Counter(r["term"] for r in got).values()) >= most or at_once == 1
    assert len(got) == len(cf)  # one row a term
    terms = sorted(t for t in cf if t != "cc")
    idf = [1.0 + i for i in range(len(terms))]
    for at_once in (1, 3, 100):
        found = features._Weigher(terms, idf, features.TermSettings(bigrams=True)).weigh(batches[1].column(0), at_once).to_pylist()
        for row, words in zip(found, pairs[2:]):
            raw = {i: words.count(t) * idf[i] for i, t in enumerate(terms) if t in words}
            assert row["term_ids"] == list(raw)
            assert row["weights"] == pytest.approx([v / math.hypot(*raw.values()) for v in raw.values()])


def test_vocabulary_deals_the_most_frequent_terms_only(spark, monkeypatch):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(90)]
    texts = [" ".join(names[(7 * i + j * j * (i % 5 + 1)) % (3 + (i * j) % 88)] for j in range(i % 40)) for i in range(240)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3, "id")
    terms = [(w := (t or "").split()) + [f"{a} {b}" for a, b in zip(w, w[1:])] for t in texts]
    cf, n_texts = Counter(t for x in terms for t in x), Counter(t for x in terms for t in set(x))
    monkeypatch.setattr(features, "WORDS_AT_ONCE", 400)
    monkeypatch.setattr(features, "LEAST_REPORTED", 40)
    bound, found = features._may_be_largest, []
    monkeypatch.setattr(features, "_may_be_largest", lambda *a: found.append(bound(*a)) or found[-1])
    settled = []
    for k, min_df, max_df in ((3, 2, 1.0), (8, 2, 0.3), (8, 1, 0.2), (300, 2, 1.0), (2000, 1, 1.0)):
        settings = features.TermSettings(bigrams=True, min_df=min_df, max_df=max_df, max_features=k)
        words = features.stored_words(df, "text", settings, "id")
        found.clear()
        got = [tuple(r) for r in features.vocabulary(words, "words", settings, len(texts)).collect()]
        able = [(t, cf[t], n_texts[t]) for t in cf if min_df <= n_texts[t] <= max_df * len(texts)]
        assert got == sorted(able, key=lambda r: (-r[1], r[0]))[:k]
        settled.append([x and len(x) for x in found])
    assert any(x and x[0] for x in settled) and [None] in settled  # some by bounds, some by all counts
    lists = pa.array([t.split() for t in texts if t])
    rows = [b.num_rows for b in features._counted(iter([pa.RecordBatch.from_arrays([lists], ["words"])]), True, 400, 40)]
    assert max(rows) <= 40 < len(cf)


def test_neighbours_are_indexed_by_terms_of_the_queries():
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(70_000, 30, replace=False)).tolist() for _ in range(50)] + [[]]
    weights = [rng.integers(1, 4, len(x)).astype(float).tolist() for x in lists]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(51)), pa.array(["a", None, "b"] * 17), pa.array(lists, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))],
        ["key", "label", "term_ids", "weights"],
    )
    for asked in ([], lists[0][:9], lists[3] + lists[7][5:], [x for x in lists[9] if x < 60_000]):
        mask = np.zeros(max(asked, default=0) + 1, bool)
        mask[asked] = True
        index = neighbours._Index(batch, mask)
        assert set(index.ids.tolist()) <= set(asked) and len(index.ids) == sum(t in asked for x in lists for t in x)
        ids, w = np.array(sorted(asked), np.int32), rng.random(len(asked))
        by_term = dict(zip(ids.tolist(), w))
        expected = [sum(by_term.get(t, 0.0) * v for t, v in zip(x, y)) for x, y in zip(lists, weights)]
        assert index.all_scores(ids, w) == pytest.approx(expected)
        full = np.zeros(len(mask))
        full[ids] = w
        assert index.scores(np.arange(51), full) == pytest.approx(expected)
        reached = set(index.reaching(ids, w, 1.0).tolist())
        assert {i for i, x in enumerate(expected) if x >= 1.0} <= reached


def test_stored_words_are_weighed_like_texts(spark, docs):
    tfidf = features.fit_tfidf(docs, "text", PLAIN)
    words = features.stored_words(docs, "text", PLAIN, "doc_id")
    assert features.fit_tfidf(words, "words", PLAIN) == tfidf
    plain = {r["doc_id"]: (r["term_ids"], r["weights"]) for r in tfidf.transform(docs, "text").collect()}
    assert {r["doc_id"]: (r["term_ids"], r["weights"]) for r in tfidf.transform(words, "words").collect()} == plain


def test_classifier_round_trip(spark, docs, tmp_path):
    tfidf = features.fit_tfidf(docs, "text", PLAIN)
    stored = tfidf.vector_table(tfidf.transform(docs, "text"))
    fitted = models.train_classifier(stored, tfidf, "kind")
    out = fitted.predict(stored).collect()
    assert all(r["predicted_label"] == r["kind"] for r in out)
    assert all(sum(p["score"] for p in r["top_predictions"]) == pytest.approx(1.0) for r in out)
    fitted.save(spark, str(tmp_path / "m"))
    again = models.TextClassifier.load(spark, str(tmp_path / "m"))
    assert {r["doc_id"]: r["predicted_label"] for r in again.predict_text(docs, "text").collect()} == {r["doc_id"]: r["predicted_label"] for r in out}
    assert models.train_classifier(stored.filter("kind = 'tool'"), tfidf, "kind") is None
    assert models.train_classifier(stored, tfidf, "kind", min_rows=100) is None


def test_svd_matches_numpy(docs):
    tfidf = features.fit_tfidf(docs, "text", PLAIN)
    stored = tfidf.vector_table(tfidf.transform(docs, "text"))
    got = {r["doc_id"]: np.array(r["embedding"]) for r in models.svd_embeddings(stored.drop("features"), len(tfidf.terms), 2).collect()}
    rows = stored.collect()
    dense = np.stack([r["features"].toArray() for r in rows])
    _, _, vt = np.linalg.svd(dense, full_matrices=False)
    want = dense @ vt[:2].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    have = np.stack([got[r["doc_id"]] for r in rows])
    # Directions may be mirrored, so inner products are compared.
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-3)
    directions, energies = models.svd_directions(stored, len(tfidf.terms), 3)
    assert np.allclose(directions.T @ directions, np.eye(3), atol=1e-9)
    assert np.allclose(energies, np.linalg.svd(dense)[1][:3] ** 2, atol=1e-6)


def test_svd_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0, 2], [0.6, 0.8]), (2, [], []), (3, [1], [1.0]), (4, [0, 2], [0.6, 0.8])], "id int, term_ids array<int>, weights array<double>")
    out = {r["id"]: r["embedding"] for r in models.svd_embeddings(rows, 3, 9).collect()}
    assert np.linalg.norm(out[2]) == 0 and out[1] == out[4] and np.dot(out[1], out[3]) == pytest.approx(0, abs=1e-6)


def test_pca_is_centred(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i + (i % 2), 5.0]) for i in range(10)], "id int, embedding array<double>")
    out = models.pca_2d(df).agg(F.avg("x"), F.avg("y"), F.var_samp("x"), F.var_samp("y")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(0, abs=1e-9) and out[2] > out[3]


def test_kmeans(spark):
    df = spark.createDataFrame([(i, [float(i % 2 * 10), 0.1 * i]) for i in range(10)], "id int, embedding array<double>")
    assert models.kmeans_clusters(df, k=2).groupBy("cluster_label").count().count() == 2
    with pytest.raises(ValueError):
        models.kmeans_clusters(df.limit(1))


def test_keywords_and_examples(docs):
    tfidf = features.fit_tfidf(docs, "text", PLAIN)
    named = tfidf.transform(docs.withColumn("cluster_label", F.when(F.col("kind") == "tool", 1).otherwise(0)), "text")
    words = clusters.cluster_keywords(named, tfidf, 3).collect()
    assert len(words) == 6 and sorted(r["rank"] for r in words) == [1, 1, 2, 2, 3, 3]
    best = {r["cluster_label"]: [w["keyword"] for w in sorted(words, key=lambda w: w["rank"]) if w["cluster_label"] == r["cluster_label"]] for r in words}
    assert "zoo" in best[0] and "shed" in best[1]


def test_checked_broadcast(spark):
    assert "Broadcast" in spark.range(9).join(few(spark.range(3), "rows"), "id")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="More than 2 rows"):
        few(spark.range(3), "rows", 2)


def test_noise_name_and_metadata(spark):
    df = spark.createDataFrame(
        [(-1, 1, "a", "x | y"), (0, 2, "b", "x"), (0, 2, "b", None)], "cluster_label int, incident_id int, incident_title string, sector string"
    )
    ranked = df.dropDuplicates(["cluster_label"]).withColumn("rank", F.lit(1))
    words = spark.createDataFrame([(0, "w", 0.5, 1)], "cluster_label int, keyword string, score double, rank int")
    out = {r["cluster_label"]: r for r in clusters.cluster_summary(df, words, ranked, {"sector": "sector"}).collect()}
    assert out[-1]["cluster_name"] == clusters.NOISE_NAME and out[-1]["top_sector"] == "x (1) | y (1)"
    assert out[0]["size"] == 2 and out[0]["unique_incidents"] == 1 and out[0]["top_keywords"] == "w"
    assert clusters.metadata_columns(df) == {"year": None, "country": None, "sector": "sector", "risk_category": None, "failure_type": None, "source_domain": None}


def brute_force(queries, corpus, k):
    out = {}
    for q, (qi, qw, pref) in queries.items():
        scores = []
        for d, (di, dw, label) in corpus.items():
            weights = dict(zip(di, dw))
            s = sum(w * weights.get(i, 0.0) for i, w in zip(qi, qw))
            scores.append((label != pref, -round(s, 9), d))
        out[q] = [d for _, _, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("block, index", [(1_000_000, 500_000), (5, 30)])
def test_neighbours_match_brute_force(docs, monkeypatch, block, index):
    monkeypatch.setattr(neighbours, "BLOCK_TERMS", block)
    monkeypatch.setattr(neighbours, "INDEX_TERMS", index)
    tfidf = features.fit_tfidf(docs, "text", PLAIN)
    corpus = tfidf.transform(docs, "text").select("doc_id", "kind", "term_ids", "weights")
    queries = corpus.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("q"), "term_ids", "weights", F.lit("tool").alias("pref"))
    near = neighbours.nearest_examples(queries, corpus, "q", "doc_id", 4, "pref", "kind").collect()
    got = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        got.setdefault(r["q"], []).append(r["doc_id"])
    q = {r["q"]: (r["term_ids"], r["weights"], r["pref"]) for r in queries.collect()}
    c = {r["doc_id"]: (r["term_ids"], r["weights"], r["kind"]) for r in corpus.collect()}
    assert got == brute_force(q, c, 4)
    # the corpus stays where it is: no exchange below the best rows of the tasks
    plan = neighbours.best_of_tasks(queries, corpus, "q", "doc_id", 4, "pref", "kind")[0]
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert count(plan) <= count(corpus)


def test_neighbours_random(spark, monkeypatch):
    """Bounds, ties, rows without a shared term, more asked than there is; several indexes in a task."""
    monkeypatch.setattr(neighbours, "INDEX_TERMS", 60)
    r = np.random.default_rng(4)

    def rows(n, start):
        out = []
        for i in range(n):
            ids = sorted(r.choice(40, size=r.integers(0, 7), replace=False).tolist())
            w = np.round(r.random(len(ids)), 1) + 0.1
            out.append((f"k{start + i:03d}", ids, (w / np.sqrt((w * w).sum())).tolist() if ids else [], "ab"[int(r.integers(0, 2))]))
        return out

    schema = "key string, term_ids array<int>, weights array<double>, label string"
    asked, held = rows(30, 0), rows(200, 500)
    queries = spark.createDataFrame(asked, schema).withColumnsRenamed({"key": "q", "label": "pref"})
    corpus = spark.createDataFrame(held, schema).repartition(3)
    for k, pref in ((5, "pref"), (3, None), (300, "pref")):
        got = {}
        for row in sorted(neighbours.nearest_examples(queries, corpus, "q", "key", k, pref, "label").collect(), key=lambda x: x["rank"]):
            got.setdefault(row["q"], []).append(row["key"])
        c = {d: (i, w, lab if pref else None) for d, i, w, lab in held}
        q = {d: (i, w, lab if pref else None) for d, i, w, lab in asked}
        assert got == brute_force(q, c, k)


def test_vote(spark):
    df = spark.createDataFrame([(1, 0.5, "a|b"), (1, 0.4, "b, nan"), (1, -0.9, "c"), (2, 0.1, None)], "q int, similarity double, lab string")
    assert [(r["q"], r["label"]) for r in neighbours.weighted_vote(df, "q", "lab").collect()] == [(1, "b")]
    weights = {r["label"]: r["weight"] for r in neighbours.label_votes(df, "q", "lab").collect()}
    assert weights["b"] == pytest.approx(0.9) and weights["c"] == 0.0


def _records(docs):
    return docs.select(
        "doc_id", F.col("text").alias("input_text"), F.col("kind").alias("mit_risk_domain"), F.col("problem").alias("gmf_known_ai_technical_failure"),
        F.lit(0).alias("cluster_label"),
    )


def test_classify_reports(spark, docs):
    fitted = scoring.fit_report_classifier(_records(docs), "doc_id")
    assert fitted.risk_model is not None and fitted.problem_model is not None
    new = spark.createDataFrame([(1, "cat dog horse zoo"), (2, "hammer saw drill shed"), (3, " ")], "id int, text string")
    predictions, examples = scoring.classify_reports(fitted, new, "id")
    assert {r["id"]: r["predicted_risk"] for r in predictions.collect()} == {1: "animal", 2: "tool"}
    first = examples.filter("rank = 1").collect()
    assert {r["id"]: r["mit_risk_domain"] for r in first} == {1: "animal", 2: "tool"}
    shown = scoring.example_table(examples, "id")
    assert "Risk category" in shown.columns and "." in shown.first()["Similarity"]


def test_cluster_hint_is_the_last_resort(spark, docs):
    records = _records(docs).withColumn("gmf_known_ai_technical_failure", F.lit(None).cast("string"))
    summary = spark.createDataFrame([(0, "Data Bias (3) | Unsafe Exposure (1)")], "cluster_label int, top_failure_type string")
    fitted = scoring.fit_report_classifier(records, "doc_id", summary=summary, with_models=False)
    predictions, _ = scoring.classify_reports(fitted, spark.createDataFrame([(1, "cat dog zoo")], "id int, text string"), "id")
    row = predictions.first()
    assert row["predicted_risk"] == "animal" and row["predicted_problem"] == "Data Bias" and row["predicted_sector"] == "Not available"
    assert scoring.fit_report_classifier(records.withColumn("input_text", F.lit(" ")), "doc_id") is None


def test_new_report_text(spark):
    df = spark.createDataFrame([(" T ", "", "x.com")], "t string, b string, d string")
    assert df.select(scoring.new_report_text("t", "b", "d")).first()[0] == "Report title: T Source domain: x.com"


def test_train_evaluate(spark, docs, tmp_path):
    frame = docs.select(F.col("doc_id").alias("incident_id"), F.col("text").alias("input_text"), "kind")
    result = training.train_evaluate(frame, "kind", settings=PLAIN, min_chars=5)
    assert result.predictions.count() == 7 and result.unseen.isEmpty()
    training.save_evaluation(result, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e" / "evaluation_metrics")).first()["accuracy"] >= 0.8
    sizes = {r["part"]: (r["n_rows"], r["n_groups"]) for r in spark.read.parquet(str(tmp_path / "e" / "part_sizes")).collect()}
    assert sizes["test"] == (7, 7) and sizes["train"][0] + 7 == frame.count()
    assert spark.read.parquet(str(tmp_path / "e" / "train_distribution")).agg(F.sum("n_rows")).first()[0] == sizes["train"][0]
    with pytest.raises(ValueError, match="Missing required column.*nothing"):
        training.train_evaluate(frame, "nothing")
    with pytest.raises(ValueError, match="both train and test"):
        training.verify_disjoint(frame, frame)


def test_predict_logits(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 1.0])], "id int, z array<double>")
    row = training.predict_logits(df, "z", ["a", "b", "c"], 2).first()
    assert row["predicted_label"] == "b" and [p["label"] for p in row["top_predictions"]] == ["b", "c"]


def test_cluster_texts(spark, docs, tmp_path):
    frame = docs.select(
        F.col("doc_id").cast("string").alias("incident_id"), F.col("text").alias("input_text"), F.lit("2021").alias("incident_year"),
        F.col("kind").alias("sector"),
    )
    out = clustering.cluster_texts(frame, n_clusters=2, n_components=4, min_chars=5, min_df=1)
    summary = {r["cluster_label"]: r for r in out.summary.collect()}
    assert sum(r["size"] for r in summary.values()) == 32
    words = out.keywords.groupBy("cluster_label").agg(F.max("rank").alias("m")).collect()
    assert all(r["m"] <= 12 for r in words)
    years = out.year_distribution.groupBy("cluster_label").agg(F.sum("count").alias("n")).collect()
    assert {r["cluster_label"]: r["n"] for r in years} == {k: r["size"] for k, r in summary.items()}
    shares = out.metadata_distribution.groupBy("metadata_type", "cluster_label").agg(F.sum("share_within_cluster").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in shares)
    clustering.save_clusters(out, str(tmp_path / "c"), {"k": 2})
    back = clustering.load_clusters(spark, str(tmp_path / "c"))
    assert back.records.count() == 32 and back.notes == [] and "cluster_name" in back.records.columns
    missing = clustering.load_clusters(spark, str(tmp_path / "none"))
    assert len(missing.notes) == 5 and missing.records.isEmpty()
    sampled = clustering.cluster_texts(frame, n_clusters=2, n_components=4, min_chars=5, min_df=1, max_records=10)
    assert sampled.records.count() == 10


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 11:00:00", "a"), (2, "2024-01-02 10:00:00", "b")]
    df = spark.createDataFrame(rows, "id int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = stream.read_reports(spark, str(tmp_path / "in"), df.schema)
    counts = stream.to_files(stream.report_counts(source, "ts", ["kind"]), str(tmp_path / "o1"), str(tmp_path / "c1"), "update")
    counts = stream.latest(counts, ["window_start", "kind"])
    assert sorted((r["kind"], r["n_reports"]) for r in counts.collect()) == [("a", 2), ("b", 1)]
    distinct = stream.to_files(stream.distinct_reports(source, "ts", ["id"]), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r["id"] for r in distinct.collect()) == [1, 2]


def test_stream_restart_and_late_rows(spark, tmp_path):
    """State outlives a restart; rows of closed windows and rows without a time are left out; nothing new adds nothing."""
    def arrive(rows):
        df = spark.createDataFrame(rows, "id int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    def counts(schema):
        source = stream.read_reports(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        rows = stream.to_files(stream.report_counts(source, "ts", ["kind"]), str(tmp_path / "o1"), str(tmp_path / "c1"), "update")
        return {(str(r["window_start"])[:10], r["kind"]): r["n_reports"] for r in stream.latest(rows, ["window_start", "kind"]).collect()}

    def distinct(schema):
        source = stream.read_reports(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        rows = stream.to_files(stream.distinct_reports(source, "ts", ["id"]), str(tmp_path / "o2"), str(tmp_path / "c2"))
        return sorted(r["id"] for r in rows.collect())

    schema = arrive([(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-09 10:00:00", "a"), (3, None, "a")])
    arrive([(2, "2024-01-09 11:00:00", "a"), (2, "2024-01-09 11:00:00", "b")])
    assert counts(schema) == {("2024-01-01", "a"): 1, ("2024-01-09", "a"): 2, ("2024-01-09", "b"): 1}
    first = distinct(schema)
    assert first.count(1) == first.count(2) == 1
    assert counts(schema) == {("2024-01-01", "a"): 1, ("2024-01-09", "a"): 2, ("2024-01-09", "b"): 1}
    arrive([(4, "2024-01-01 12:00:00", "a"), (2, "2024-01-09 12:00:00", "a"), (5, "2024-01-08 09:00:00", "a")])
    assert counts(schema) == {("2024-01-01", "a"): 1, ("2024-01-08", "a"): 1, ("2024-01-09", "a"): 3, ("2024-01-09", "b"): 1}
    second = distinct(schema)
    assert second.count(2) == 1 and second.count(5) == 1


def test_classify_stream(spark, docs, tmp_path):
    fitted = scoring.fit_report_classifier(_records(docs), "doc_id", with_models=False)
    new = spark.createDataFrame([(1, "cat dog zoo"), (2, "hammer shed")], "id int, text string")
    new.write.parquet(str(tmp_path / "in"))
    source = stream.read_reports(spark, str(tmp_path / "in"), new.schema)
    stream.classify_stream(source, fitted, "id", "text", str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["id"]: r["predicted_risk"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "animal", 2: "tool"}
