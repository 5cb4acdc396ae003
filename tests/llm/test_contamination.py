import numpy as np

import plain
from casebook.llm import contamination as c


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        best, end = c.align(a, b, c.MatchSettings())
        assert best == plain.local_alignment(a, b) and 0 <= end <= len(b)


def test_finds_copies_and_edits(llm, texts, odd):
    items = [(i, texts.prose(25)) for i in range(12)] + [(99, "short one"), (98, None), (None, texts.prose(9))]
    docs, want = [], set()
    for i in range(120):
        body = [texts.prose(60)]
        if i % 3 == 0:
            k = texts.r.randrange(12)
            body.insert(texts.r.randrange(2), texts.edited(items[k][1], (0, 0.1, 0.2)[i % 9 // 3]).translate({x: x - 32 for x in range(97, 123)}).replace(" ", ", "))
            want.add((i, k))
        docs.append((i, " ".join(body)))
    docs += [(500, items[0][1]), (500, items[0][1]), (501, None), (502, ""), (None, items[1][1])]
    want.add((500, 0))
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    tests = llm.createDataFrame(items, "item_id bigint, text string")
    found = c.matches(df, tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    left = {r.doc_id for r in c.decontaminate(df, tests).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
    assert c.matches(df, tests.limit(0)).count() == 0
    assert c.matches(df.limit(0), tests).count() == 0
    assert c.decontaminate(odd, tests).count() == odd.count()


def test_common_passage_stays_rare(llm, texts):
    """A passage in a third of all documents is found in each of them."""
    passage = texts.prose(20)
    docs = [(i, texts.prose(15) + (" " + passage if i % 3 == 0 else "")) for i in range(300)]
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id for r in c.matches(df, llm.createDataFrame([(1, passage)], "item_id bigint, text string")).collect()}
    assert got == set(range(0, 300, 3))
