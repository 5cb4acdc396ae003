import pytest
from pyspark.sql import functions as F

from casebook.llm import toxicity as t

pytest.importorskip("ahocorasick")


def test_folding():
    assert t.folded("  IDI0T, ｍоrоn!\n") == " idiot moron "
    assert t.folded(None or "") == "  "


def test_hits_and_exceptions():
    machine = t.automaton(t.Lexicon(((" idiot ", 2.0), (" lowei", 3.0), (" loweix ", 5.0)), (" no idiot ",)))
    assert [w for *_, w in t.hits(t.folded("Idiot! loweib, loweix; no idiot. 1diot idiots"), machine)] == [2.0, 3.0, 5.0, 2.0]
    assert t.hits(t.folded("clean"), t.automaton(t.Lexicon())) == []


def test_learns_and_scores(llm, texts, odd):
    bad = ["scum", "ScUm", "5cum", "veqqa", "veqqo", "veqqi"]
    docs, labels = [], []
    for i in range(240):
        body = texts.prose(60).split(" ")
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                body.insert(texts.r.randrange(len(body)), texts.r.choice(bad))
        elif i % 20 == 1:
            body.insert(5, "fresh scum")  # harmless in this phrase
        docs.append((i, " ".join(body)))
        if i < 180:
            labels.append((i, toxic))
    docs += [(900, None), (901, ""), (902, "veqqzz and SCUM"), (903, "fresh scum")]
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    lexicon = t.train(df, llm.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int"))
    assert " fresh scum " in lexicon.exceptions
    got = {r.doc_id: r for r in t.score(df, lexicon).collect()}
    wrong = sum(got[i].predicted != int(i % 4 == 0) for i in range(180, 240))
    assert wrong <= 1
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == got[903].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    clash = t.score(odd.withColumn("_text", F.lit("x")).drop("_text"), lexicon)
    assert clash.count() == odd.count() and clash.columns.count("score") == 1
    assert t.train(df, llm.createDataFrame([], "doc_id bigint, toxic int")) == t.Lexicon()
    assert t.score(df.limit(0), lexicon).count() == 0
