import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import plain
from casebook.llm import repeats


def check(llm, docs, **settings_):
    s = repeats.RepeatSettings(**settings_)
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    want = plain.cut_repeats(docs, s.length)
    got = repeats.remove_repeats(df, s, decode=True).collect()
    assert len(got) == len(docs)
    for r in got:
        pieces, removed, spans = want[r.doc_id]
        assert (bytes(r.kept), r.n_bytes - len(r.kept), len(r.starts)) == (b"".join(pieces), removed, spans)
        assert r.kept_text == "".join(p.decode(errors="ignore") for p in pieces)


def test_same_as_plain(llm, texts):
    parts = [texts.prose(n) for n in (4, 20, 25, 40, 60)]
    docs = [(i, " ".join(texts.r.choice([*parts, texts.prose(10)]) for _ in range(texts.r.randint(0, 6)))) for i in range(-5, 60)]
    docs += [(100, "ab" * 400), (101, "x" * 1000), (102, "x" * 99), (103, None), (104, "ñ" * 120), (105, "x\x00" * 90), (106, "y" + "ñ" * 80)]
    check(llm, docs)
    check(llm, docs, length=30, sample=12, block=10)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé", max_size=60), min_size=1, max_size=6))
def test_small_alphabet(llm, column):
    check(llm, list(enumerate(column)), length=12, sample=5, block=3)


def test_block_edges(llm, texts):
    long = texts.prose(repeats.SEGMENT // 5)
    check(llm, [(0, long[:150_000] + long[100:500]), (1, long[20_000:90_000])], length=100)


def test_odd_rows(odd):
    out = repeats.remove_repeats(odd).collect()
    assert len(out) == odd.count() and {"score", "kept", "hash", "mark"} <= set(out[0].asDict())
    assert repeats.remove_repeats(odd.select("doc_id", "text").limit(0)).count() == 0
    same = odd.sparkSession.createDataFrame([(1, "q" * 50 + "r" * 100)] * 3, "doc_id bigint, text string")
    assert {len(r.kept) for r in repeats.remove_repeats(same).collect()} == {150}


def test_common_line_is_split(llm, texts):
    """A line with other neighbours in each document does not gather its contexts in one bucket."""
    line = texts.prose(200)[:90]
    docs = [(i, texts.prose(30) + line + texts.prose(30)) for i in range(300)]
    docs += [(300 + i, docs[i][1][-200:] + texts.prose(20)) for i in range(40)]
    s = repeats.RepeatSettings(block=50)
    data = [x for _, x in docs]
    samples = next(repeats._samples(iter([pa.RecordBatch.from_pydict({"text": data, "mark": list(range(len(data)))})]), s)).to_pandas()
    size = samples.groupby("hash")["times"].sum()
    hot = set(size[size > s.block].index)
    assert hot
    batch = pa.RecordBatch.from_pydict({
        "text": data, "mark": list(range(len(data))), "_order": [i for i, _ in docs],
        "samples": pa.array([list(size[size > 1].index)] * len(data), pa.list_(pa.int64())), "crowded": pa.array([list(hot)] * len(data), pa.list_(pa.int64())),
    })
    rows = pa.Table.from_batches(list(repeats._contexts(iter([batch]), s)))
    assert max(np.unique(rows.column("hash").to_numpy()[rows.column("at").to_numpy() >= 0], return_counts=True)[1]) <= s.block
    check(llm, docs, block=50)


def test_listed_twice(llm, texts):
    """Rows with the same doc_id and text are one document, in one batch or in several."""
    text, other = texts.prose(60), texts.prose(60)
    rows = [(1, text), (1, text), (2, "zz " + text), (3, other + text[:150] + other), (3, other + text[:150] + other)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    want = plain.cut_repeats(list(dict(rows).items()))
    for parts, block in ((1, 30_000), (5, 30_000), (5, 1)):
        got = repeats.remove_repeats(df.repartition(parts), repeats.RepeatSettings(block=block)).collect()
        assert len(got) == 5 and all(bytes(r.kept) == b"".join(want[r.doc_id][0]) for r in got)
