import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from casebook.llm import bits
from casebook.llm import words as W


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAB.é　", max_size=30)), max_size=8))
def test_words_and_shingles(column):
    found = W.Words(*W.text_bytes(pa.array(column, pa.string())))
    want = [plain.words(t) for t in column]
    assert found.per_text.tolist() == [len(w) for w in want]
    names = {}
    for h, w in zip(found.hashes().tolist(), [w for x in want for w in x]):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    values, first = W.distinct_sorted(*W.shingles(found, found.hashes(), 2))
    assert np.diff(first).tolist() == [len(plain.shingle_set(t, 2)) for t in column]


def test_long_word_and_block_edges():
    column = pa.array(["a" * (W.BLOCK + 10) + " b", "b " * W.BLOCK])
    found = W.Words(*W.text_bytes(column))
    assert found.per_text.tolist() == [2, W.BLOCK]
    assert len(set(found.hashes().tolist())) == 2


def test_bit_table(llm):
    df = llm.range(0, 3000, 3).select("id")
    table = bits.table_of(df)
    there = bits.inside(np.arange(3000), table)
    assert there[::3].all() and there.mean() < 0.36
    assert not bits.inside(np.arange(10), bits.table_of(df.filter("id < 0"))).any()
