import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import plain
from casebook.llm import passages


def check(llm, docs, **settings_):
    s = passages.PassageSettings(**settings_)
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    want = plain.cut_passages(docs, s.width)
    got = passages.remove_passages(df, s).collect()
    assert len(got) == len(docs)
    for r in got:
        kept, gone, runs = want[r.doc_id]
        assert (r.kept, r.n_removed, list(zip(r.starts, r.ends))) == (kept, gone, runs)
        assert r.n_words == r.n_removed + len(kept.split())


def test_same_as_plain(llm, texts):
    parts = [texts.prose(n) for n in (5, 12, 19, 20, 21, 60)]
    glue = ["\n", " ", "\t \r\n", "  "]
    docs = [(i, "".join(texts.r.choice([*parts, texts.prose(15)]) + texts.r.choice(glue) for _ in range(texts.r.randint(0, 6)))) for i in range(-5, 50)]
    docs += [(100, "a b " * 300), (101, "x " * 500), (102, "x " * 19), (103, None), (104, "ñ y " * 60), (105, "x\x00 \x0b" * 90), (106, docs[7][1]), (107, docs[7][1])]
    check(llm, docs)
    check(llm, docs, width=7, seed=3, block=10, crowd=5)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab ", max_size=80), min_size=1, max_size=6))
def test_small_alphabet(llm, column):
    check(llm, list(enumerate(column)), width=5, seed=2, block=3, crowd=4)


def test_segment_edges(llm, texts):
    words = [texts.word() for _ in range(2000)]
    long = " ".join(words[int(i)] for i in np.random.default_rng(1).integers(0, 2000, passages.SEGMENT + 5000))
    check(llm, [(0, long), (1, " ".join(long.split()[passages.SEGMENT - 30 : passages.SEGMENT + 40]))])


def test_common_line_is_split(llm, texts):
    line = texts.prose(12)
    docs = [(i, f"{texts.prose(30)} {line} {texts.prose(30)}") for i in range(200)]
    docs += [(200 + i, docs[i][1][40:] + texts.prose(20)) for i in range(20)]
    check(llm, docs, crowd=50, block=30)


def test_window_numbers():
    words = np.random.default_rng(2).integers(0, 2, 400)
    for width in (1, 2, 5, 7, 20):
        numbers = passages.window_numbers(words, width)
        seen = {}
        for i in range(len(words) - width + 1):
            assert seen.setdefault(tuple(words[i : i + width]), numbers[i]) == numbers[i]
        assert len(set(seen.values())) == len(seen)


def test_odd_rows(odd):
    out = passages.remove_passages(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and {"score", "hash", "mark", "label"} <= set(out.columns) and {r.mark for r in rows} == {"m"}
    assert passages.remove_passages(odd.select("doc_id", "text").limit(0)).count() == 0
    spark, text = odd.sparkSession, " ".join(map(str, range(70)))
    # a document that is listed twice is one; its own repeat and a later copy go
    rows = [(1, text), (1, text), (2, "a b c " + text), (None, text), (1, "z " + text + " " + text)]
    got = sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    ones = [x for x in got if x[0] == 1]
    assert ones in ([(1, 70, 0), (1, 70, 0), (1, 141, 140)], [(1, 70, 70), (1, 70, 70), (1, 141, 70)])
    assert [x for x in got if x[0] != 1] == [(2, 73, 70), (9, 70, 70)]
