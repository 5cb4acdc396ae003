import corpus_pipeline as pipeline
import numpy as np
import plain
import pytest
from casebook.llm import quality

pytest.importorskip("public_tokenizers")


def words_without_marks(text):
    return "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def test_stages_against_plain_python(llm, texts, tmp_path):
    r = texts.r
    items = [(i, texts.prose(20)) for i in range(4)]
    passage = texts.prose(40)
    docs, labels = [], []
    for i in range(90):
        body = [texts.prose(r.randint(60, 120)) + "." for _ in range(r.randint(1, 3))]
        if i % 9 == 1:
            body.append(passage)
        if i % 11 == 2:
            body.append(items[i % 4][1])
        if i % 8 == 3:
            body = ["%%% ".join(texts.prose(90).split()) + "%%%"]
        if i % 10 == 4 and i > 10:
            body = [texts.edited(docs[i - 9][1], 0.004)]
        docs.append((i, "\n".join(body), "en", "s", 1))
        labels.append((i, int(i % 8 != 3), 0))
    docs += [(200, None, None, None, None), (201, "", "en", "s", 0), (5, docs[5][1], "en", "s", 1), (None, texts.prose(70), "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark = llm
    folder = str(tmp_path)
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    def run(stage, rows):
        df = spark.createDataFrame(rows, schema)
        out = pipeline.STAGES[stage][1](spark, df, folder)
        assert stage == 4 or out.columns == list(pipeline.COLUMNS)
        return [tuple(x) for x in out.collect()]

    kept = run(0, docs)
    model = quality.train(spark.createDataFrame(docs, schema), spark.read.parquet(f"{folder}/labels.parquet"))
    judged = {(x.doc_id, x.text): x.kept for x in quality.judge(spark.createDataFrame(docs, schema), model).collect()}
    assert sorted(map(repr, kept)) == sorted(repr(d) for d in docs if judged[d[0], d[1]])
    assert {d[0] for d in docs if d[1] and not plain.quality_counts(d[1])[5] and "%%%" not in d[1]} <= {d[0] for d in kept}

    unique = run(1, kept)
    component = plain.near_classes([(d[0], d[1]) for d in kept if d[0] is not None], 5)
    assert sorted(d[0] for d in unique if d[0] is not None) == sorted({i for i, c in component.items() if i == c})
    assert sum(d[0] is None for d in unique) == sum(d[0] is None for d in kept)

    cut = run(2, unique)
    want = plain.cut_repeats([(d[0], d[1]) for d in unique])
    got = {d[0]: d for d in cut}
    for i, (pieces, _, _) in want.items():
        text = "".join(p.decode(errors="ignore") for p in pieces)
        assert (got[i][1], got[i][4]) == (text, len(text)) if text else i not in got

    clean = run(3, cut)
    for d in cut:
        w = words_without_marks(d[1])
        share = max(plain.local_alignment(x, w) / (2 * len(x)) for x in (words_without_marks(t) for _, t in items))
        assert (d in clean) == (d[0] is None or share < 0.4)

    packed = run(4, clean)
    assert {p[0] for p in packed} == {d[0] for d in clean}
    whole = pipeline.run(spark, folder).collect()
    assert sorted(map(repr, ((x.doc_id, x.piece, x.length, x.ids_crc32) for x in whole))) == sorted(repr((p[0], p[1], p[3], p[4])) for p in packed)


def test_empty_tables(llm, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        llm.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(llm, str(tmp_path)).count() == 0
