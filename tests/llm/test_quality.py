import itertools

import numpy as np

import plain
from casebook.llm import quality


def test_counts(llm, texts, odd):
    docs = [texts.prose(n) for n in (3, 49, 50, 51, 200)]
    docs += [docs[3] + " " + docs[3], "a\nb\na\n\n \n a\na", "# * $ % & | < >\r\nx y", None, ""]
    df = llm.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    for r in quality.judge(df, quality.LineModel()).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality_counts(docs[r.doc_id])
    out = quality.judge(odd, quality.LineModel())
    assert out.count() == odd.count() and out.columns.count("kept") == 1 and "score" in out.columns
    assert quality.judge(odd.limit(0), quality.LineModel()).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    text = np.repeat([0, 1, 2, 3], [5, 1, 7, 3])
    score, move = rng.normal(size=16), rng.normal(size=(2, 2))
    got = quality.viterbi(text, score, move)
    p, moves = quality._marginals(text, score, move)
    expected = np.zeros((2, 2))
    for t in range(4):
        at = np.flatnonzero(text == t)
        value = {}
        for path in itertools.product((0, 1), repeat=len(at)):
            value[path] = sum(score[i] for i, y in zip(at, path) if y) + sum(move[a, b] for a, b in itertools.pairwise(path))
        assert tuple(got[at]) == max(value, key=value.get)
        norm = sum(np.exp(v) for v in value.values())
        for k, i in enumerate(at):
            assert np.isclose(p[i], sum(np.exp(v) for y, v in value.items() if y[k]) / norm)
        for path, v in value.items():
            for a, b in itertools.pairwise(path):
                expected[a, b] += np.exp(v) / norm
    assert np.allclose(moves, expected)


def test_learns_from_labels(llm, texts):
    junk = lambda t: " ".join(w + "%%%" for w in t.split())
    good = [texts.prose(30) + ".\n" + texts.prose(60) + "." for _ in range(60)]
    bad = [texts.prose(5) + ".\n" + junk(texts.prose(90)) for _ in range(30)]
    docs = list(enumerate(good + bad))
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    labels = llm.createDataFrame([(i, int(i < 60)) for i in range(0, 90, 2)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.train(df, labels)
    kept = {r.doc_id for r in quality.judge(df, model).filter("kept").collect()}
    assert kept == set(range(60))
    assert quality.train(df, labels.limit(0)) == quality.LineModel()
