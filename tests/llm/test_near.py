import numpy as np
import pytest

import plain
from casebook.llm import near


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_same_as_all_pairs(llm, texts, width):
    docs = []
    for _ in range(12):
        base = texts.prose(texts.r.randint(30, 200))
        docs.append(base)
        for _ in range(texts.r.randint(0, 8)):
            docs.append(base if texts.r.random() < 0.4 else texts.edited(base, texts.r.choice([0.01, 0.03, 0.05, 0.08])))
    docs += ["", None, " ", "one", "ONE", "one two", "one  two", "two one"]
    texts.r.shuffle(docs)
    rows = list(enumerate(docs))
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    want = plain.near_classes(rows, width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_classes(df, near.NearSettings(width=width)).collect()}
    assert got == {i: (len(plain.shingle_set(t, width)), want[i]) for i, t in rows}


def test_fuzzy_group_through_blocks(llm, texts):
    """One base and many copies around the limit, in blocks of a few members."""
    base = texts.prose(150)
    rows = [(i, texts.edited(base, 0.02 + 0.07 * texts.r.random())) for i in range(150)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near.near_classes(df, near.NearSettings(width=2, block_members=20)).collect()}
    assert got == plain.near_classes(rows, 2)


def test_estimate_follows_the_similarity():
    s = near.NearSettings(registers=1024, bands=32)
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:n], pool[1000 : 2000 - n]])
        ra, rb = (near.registers(x, np.array([0, len(x)]), s) for x in (a, b))
        j = n / (2000 - n)
        assert abs(near.estimate(ra, rb, np.array([1000.0]), np.array([1000.0]), s.base)[0] - j) < 0.07
        both = np.concatenate([a, b[n:]])
        assert (near.registers(both, np.array([0, len(both)]), s) == np.maximum(ra, rb)).all()  # mergeable


def test_odd_rows(odd):
    out = near.near_classes(odd).collect()
    assert len(out) == odd.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id in (1, 2, 3, 5, None)} == {(1, 1, True), (2, 2, True), (3, 3, True), (5, 5, True), (None, None, True)}
    assert near.near_classes(odd.limit(0)).count() == 0


def test_a_bucket_shared_by_chance_makes_no_family(llm, texts, monkeypatch):
    """Unlike texts, each in a bucket with the next one, and one pair that is alike: only the sets of that pair are read."""
    s = near.NearSettings(width=2, block_members=20)
    docs = [texts.prose(60) for _ in range(200)]
    docs.append(texts.edited(docs[0], 0.01))
    df = llm.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    sketches = df.mapInArrow(
        lambda t: near._sketch(t, s), "doc_id bigint, n_shingles bigint, mark_a bigint, mark_b bigint, registers binary, bands array<bigint>"
    )
    rows = [(i, j % 201, j % 201) for i in range(201) for j in (i, i + 1)]
    rows = llm.createDataFrame(rows, "key bigint, doc_id bigint, component bigint")
    read, whole = [], near._sets_of

    def spy(ids, *more):
        read.extend(r[0] for r in ids.collect())
        return whole(ids, *more)

    monkeypatch.setattr(near, "_sets_of", spy)
    links = {(r.a, r.b) for r in near._within_families(rows, sketches, df, s).collect()}
    assert links == {(0, 200)}
    assert set(read) == {0, 200}


@pytest.mark.parametrize("sizes", [[95, 3, 2, 1], [40, 35, 1], [30, 30], [1] * 45, [9, 2]])
def test_members_meet_those_of_other_classes_once(llm, sizes):
    """Every two members of different classes share one pair of blocks at least; those of a large class go to few."""
    names = [c for c, n in enumerate(sizes) for _ in range(n)]
    members = llm.createDataFrame([(g, i, c) for g in (1, 2) for i, c in enumerate(names)], "key bigint, doc_id bigint, component bigint")
    rows = near._dealt(members, "key", near.F.lit(1), 10).filter("key = 2").collect()
    of = {}
    for r in rows:
        assert r.own in (r.lo, r.hi)
        of.setdefault(r.doc_id, set()).add((r.lo, r.hi))
    assert len(rows) == sum(map(len, of.values()))
    for i, c in enumerate(names):
        assert all(of[i] & of[j] for j, d in enumerate(names) if c != d)
    if sizes[0] == 95:
        assert max(len(of[i]) for i in range(95)) == 1  # all pairs of blocks of members would be ten


def test_forest_is_connected():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 400, (2, 250))
    root = near._forest(400, x, y)
    assert (root[x] == root[y]).all() and (root <= np.arange(400)).all() and (root[root] == root).all()
    chain = np.arange(299)
    assert (near._forest(300, chain, chain + 1) == 0).all()


@pytest.mark.parametrize("members", [2000, 7])
def test_blocks_of_a_bucket_connect_all_that_agree(llm, members):
    """In a bucket of many members, in blocks of a few or in one, those that agree are connected and no others."""
    s = near.NearSettings(sketch_members=members, deal=16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 300, (9, s.registers)).astype(np.int16)
    rows, sketches = [], []
    for i in range(90):
        regs = base[i % 9].copy()
        regs[rng.choice(s.registers, 10, replace=False)] += 1000
        rows += [(k, i, i if i % 2 else 1000) for k in (1, 2 + i % 3)]
        sketches.append((i, 100, regs.tobytes()))
    rows = llm.createDataFrame(rows, "key bigint, doc_id bigint, component bigint")
    sketches = llm.createDataFrame(sketches, "doc_id bigint, n_shingles bigint, registers binary")
    got = {r.doc_id: r.family for r in near._families(rows, sketches, s).collect()}
    assert got == {i: i % 9 for i in range(90)}
