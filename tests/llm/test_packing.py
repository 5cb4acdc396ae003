import zlib

import numpy as np
import pytest

from casebook.llm import packing

tokenizers = pytest.importorskip("tokenizers")
vocabulary = pytest.importorskip("public_tokenizers")


def test_whole_texts(llm, texts, odd):
    docs = [(i, texts.prose(n)) for i, n in enumerate([0, 1, 30, 400, 3000])] + [(9, None), (9, None), (None, "ÄÖ İstanbul’s 3.14　don't <|endoftext|> 'lĺ")]
    df = llm.createDataFrame(docs, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    rows = packing.pack(df).collect()
    model = tokenizers.Tokenizer.from_file(vocabulary.path("word_bpe_49k.json"))
    want = []
    for i, t in [tuple(r) for r in df.collect()]:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert packing.pack(df.limit(0)).count() == 0
    ids = packing.pieces(df.filter("doc_id = 4"), keep_ids=True).collect()
    assert [len(r.ids) for r in ids] == [r.length for r in ids]


@pytest.mark.parametrize("seed", range(4))
def test_search_empties_bins(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(200, 2500, 400)
    start = packing.best_fit(sizes, 4096)
    done = packing.improve(sizes, start, 4096, 4000)
    assert sorted(i for b in done for i in b) == list(range(400))
    assert max(sizes[b].sum() for b in done) <= 4096
    assert len(done) <= len(start)
    assert len(done) <= -(-sizes.sum() // 4096) * 1.03 + 1


def test_exchange_is_needed():
    # best fit gives three bins of ten; two hold everything after exchanges
    sizes = np.array([6, 5, 5, 2, 2])
    bins = [[0], [1, 3, 4], [2]]
    assert len(packing.improve(sizes, bins, 10, 50)) == 2
