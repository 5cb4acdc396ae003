"""Column functions on hand-written edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from casebook.functions import dates, labels, text, vectors


def run(spark, values, *columns, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    rows = df.select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


def test_normalize_text(spark):
    values = [None, "", "  a\t b  c\n", "x\x00y", "a\x1fb"]
    assert run(spark, values, text.normalize_text("v")) == ["", "", "a b c", "x y", "a b"]


def test_normalize_text_list(spark):
    df = spark.createDataFrame([(["a ", None, " b"],)], "v array<string>")
    assert df.select(text.normalize_text_list("v")).first()[0] == "a b"


def test_snake_and_slug(spark):
    assert run(spark, [" Risk Domain (new)!", "__a--b", None], text.snake_name("v")) == ["risk_domain_new", "a_b", ""]
    assert run(spark, ["É a.b", "---", None], text.slug("v")) == ["a_b", "target", "target"]


@pytest.mark.parametrize("value,expected", [
    (None, []), ("", []), ("[]", []), ("[1, 2]", ["1", "2"]), ("""['a', "b"]""", ["a", "b"]), ("1, 2", ["1", "2"]),
    ("[1, , 3]", ["1", "3"]), ("not a list", ["not a list"]), ("('x', 'y')", ["x", "y"]), ("(1, 2)", ["1", "2"]),
    ("{'x'}", ["x"]), ("['a, b', 'c']", ["a, b", "c"]), ("(see note)", ["(see note)"]), ("'a', b", ["a", "b"]),
    ("['a',]", ["a"]), ("[ ]", []),
])
def test_parse_list(spark, value, expected):
    assert run(spark, [value], text.parse_list("v")) == [expected]


def test_parse_list_strict(spark):
    values = [None, "1, 2", "[1, 2]", "['a']", "('a', 'b')", "text"]
    assert run(spark, values, text.parse_list_strict("v")) == [[], [], ["1", "2"], ["a"], [], []]


def test_url_host_and_domain(spark):
    values = [None, "", "https://WWW.X.com/a", "x.com/a", "http://h:80/p", "https://a b.com/x y", "mailto:a@b", "//h.org/p"]
    assert run(spark, values, text.url_host("v")) == [None, None, "www.x.com", None, "h:80", "a b.com", None, "h.org"]
    assert run(spark, values[:5], text.url_domain("v")) == ["", "", "x.com", "x.com", "h:80"]


def test_dates(spark):
    values = ["2021-03-04", "2021-03-04T23:30:00-02:00", "03/04/2021", "4.3.2021", "March 4, 2021", "2021", "1850", "bad", None]
    got = run(spark, values, F.date_format(dates.parse_timestamp("v"), "yyyy-MM-dd"))
    assert got == ["2021-03-04", "2021-03-05", "2021-03-04", "2021-03-04", "2021-03-04"] + [None] * 4
    assert run(spark, values, dates.extract_year("v")) == [2021] * 6 + [None] * 3
    assert run(spark, ["2100", "2101", "1999.0", "x"], dates.valid_year("v")) == [2100, None, 1999, None]


def test_join_text_and_labelled_text(spark):
    df = spark.createDataFrame([(" a ", None, "b", "A"), ("", " ", None, "")], "p string, q string, r string, s string")
    assert [r[0] for r in df.select(text.join_text("p", "q", "r")).collect()] == ["a b", ""]
    fields = [("One", "p"), ("Two", "s"), ("Three", "q"), ("Four", "r")]
    assert [r[0] for r in df.select(text.labelled_text(fields)).collect()] == ["One: a Four: b", ""]


def test_clean_and_split_labels(spark):
    values = ["nan", "N/A", "[]", None, " a ", "a | b |c|  | d"]
    assert run(spark, values, labels.clean_label("v"))[:5] == ["", "", "", "", "a"]
    assert run(spark, ["x |  y", None], labels.split_labels("v")) == [["x", "y"], []]
    assert run(spark, ["a, b|c,,", "nan", None], labels.problem_labels("v")) == [["a", "b", "c"], [], []]
    assert run(spark, ["|, z", ""], labels.primary_label("v")) == ["z", None]


def test_target_label(spark):
    values = ["a | b", "a", "None", "[]"]
    assert run(spark, values, labels.target_label("v")) == ["a | b", "a", "", "[]"]
    assert run(spark, values, labels.target_label("v", "first")) == ["a", "a", "", "[]"]
    assert run(spark, values, labels.target_label("v", "drop")) == ["", "a", "", "[]"]
    with pytest.raises(ValueError):
        labels.target_label("v", "other")


def test_summary_label(spark):
    value = "Context Bias (9) | Unsafe Exposure (4) | Latency (2)"
    assert run(spark, [value], labels.summary_label("v", F.lit("2. Privacy & Security"))) == ["Unsafe Exposure"]
    assert run(spark, [value], labels.summary_label("v", F.lit("7. AI system safety"))) == ["Latency"]
    assert run(spark, [value, "", None], labels.summary_label("v", F.lit(None).cast("string"))) == ["Context Bias", None, None]


def test_short_label(spark):
    values = ["3. Misinformation", "short", "exactly twenty-two chr", "a text that is longer than that", None]
    assert run(spark, values, labels.short_label("v")) == ["Misinfo", "short", "exactly twenty-two chr", "a text that is longer…", None]


def test_contains_any(spark):
    values = ["a | b", "ab", None, "a | b | c"]
    assert run(spark, values, labels.contains_any("v", ["b", "ab"])) == [True, True, False, True]
    assert run(spark, values, labels.contains_any("v", [])) == [True] * 4


def test_collapse(spark):
    rows = [(1, "['B', 'a']"), (1, "a"), (1, "A"), (1, "n/a"), (2, "nan"), (1, "['a, x']")]
    df = spark.createDataFrame(rows, "k int, v string")
    got = dict(tuple(r) for r in df.groupBy("k").agg(labels.collapse("v")).collect())
    assert got == {1: "A | a | a, x | B", 2: ""}


def test_tokens_and_bigrams(spark):
    value = "The cat, a Übung_1 & the x cat"
    assert run(spark, [value], text.tokens("v", ["the"])) == [["cat", "übung_1", "cat"]]
    got = run(spark, [value, "one", ""], text.with_bigrams(text.tokens("v", ["the"])))
    assert got == [["cat", "übung_1", "cat", "cat übung_1", "übung_1 cat"], ["one"], []]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(vectors.euclidean("v", F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 5.0
    probs = df.select(vectors.softmax("v")).first()[0]
    assert math.isclose(sum(probs), 1.0) and math.isclose(probs[1] / probs[0], math.e)
    big = spark.createDataFrame([([1000.0, 1001.0],)], "v array<double>").select(vectors.softmax("v")).first()[0]
    assert math.isclose(big[1] / big[0], math.e)


def test_top_scores(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.2, 0.1],)], "v array<double>")
    ranked = vectors.top_scores("v", 3, ["a", "b", "c", "d"])
    assert [(e["label"], e["score"]) for e in df.select(ranked).first()[0]] == [("b", 0.5), ("a", 0.2), ("c", 0.2)]
    assert df.select(vectors.scores_text(ranked)).first()[0] == "b: 0.5000 | a: 0.2000 | c: 0.2000"
