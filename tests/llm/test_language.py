import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import plain
from casebook.llm import gru, language


def test_gradients():
    """Backpropagation against differences of the score."""
    shape = gru.Shape((0, 3, 5), 2, 4)
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in gru.initial(shape, np.arange(1, 8.0)).items()}
    w = {k: v + rng.normal(size=v.shape) * 0.3 for k, v in w.items()}
    ids = rng.integers(0, 7, 12).astype(np.int16)
    first = np.array([0, 7, 12])

    def loss(x):
        return gru.score(x, shape, ids, first, 7).sum()

    trainer = gru.Trainer(w, shape, 1.0)
    grads = {}
    trainer.moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    trainer.learn(ids, first[:-1], np.diff(first), 7)
    for k in w:
        grads[k] = trainer.moment[k][0] / 0.1 * len(ids)
        for at in list(np.ndindex(w[k].shape))[::5]:
            x = {n: v.copy() for n, v in w.items()}
            x[k][at] += 1e-3
            up = loss(x)
            x[k][at] -= 2e-3
            assert abs((up - loss(x)) / 2e-3 - grads[k][at]) < 1e-2 * max(1, abs(grads[k][at]))


def test_gradients_of_lanes():
    """Texts that follow each other in a lane have the gradients of texts that stand alone."""
    shape = gru.Shape((0, 3, 5), 2, 4)
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) + rng.normal(size=v.shape) * 0.3 for k, v in gru.initial(shape, np.arange(1, 8.0)).items()}
    ids = rng.integers(0, 7, 40).astype(np.int16)
    first = np.array([0, 9, 9, 10, 17, 30, 40])
    found = []
    for lanes in (1, 2, 100):
        trainer = gru.Trainer(w, shape, 1.0, lanes)
        assert trainer.learn(ids, first[:-1], np.diff(first), 64) == 40
        found.append({k: m[0] for k, m in trainer.moment.items()})
    for other in found[1:]:
        assert all(np.allclose(found[0][k], other[k], atol=1e-9) for k in w)


def test_score_against_plain_steps():
    """The recurrence and the two softmax levels, word by word in plain Python."""
    shape = gru.Shape((0, 1, 4, 6), 3, 5)
    rng = np.random.default_rng(4)
    w = {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.4 for k, v in gru.initial(shape, np.arange(1, 10.0)).items()}
    texts = [rng.integers(0, 9, n).astype(np.int16) for n in (1, 33, 70)]
    got = gru.score(w, shape, np.concatenate(texts), np.cumsum([0, *map(len, texts)]), 8)
    assert np.allclose(got, [plain.network_score(w, shape.bounds, t.tolist()) for t in texts], rtol=1e-4)


def test_scores_do_not_depend_on_the_layout(llm, texts):
    docs = [(i, texts.prose(texts.r.randint(0, 200))) for i in range(120)]
    df = llm.createDataFrame(docs, "doc_id bigint, text string")
    s = language.LanguageSettings(head=60, inner=20, inner_classes=4, outer_classes=3, shard=4000)
    runs = []
    for parts in (1, 4, 8):
        got = language.score(df.orderBy(F.rand(parts)).repartition(parts), F.col("doc_id") % 4 != 1, s).select("doc_id", "score").collect()
        runs.append(dict(got))
    for other in runs[1:]:
        assert all(abs(runs[0][i] - other[i]) < 1e-5 * max(1, abs(other[i])) for i, _ in docs)


def test_windows_carry_the_state():
    shape = gru.Shape((0, 4, 6), 3, 5)
    w = gru.initial(shape, np.arange(1, 10.0))
    ids = np.random.default_rng(1).integers(0, 9, 100).astype(np.int16)
    first = np.array([0, 1, 70, 70, 100])
    whole = gru.score(w, shape, ids, first, 1000)
    assert np.allclose(gru.score(w, shape, ids, first, 8), whole, atol=1e-3) and whole[2] == 0


def test_probabilities_sum_to_one():
    shape = gru.Shape((0, 4, 6), 3, 5)
    w = gru.initial(shape, np.arange(1, 10.0))
    state = np.repeat(np.random.default_rng(1).normal(size=(1, 5)), 9, 0).astype(np.float32)
    scores, _, _ = gru._outputs(w, shape, state, np.arange(9), False)
    assert abs(np.exp(scores).sum() - 1) < 1e-5


def test_counts_and_scores(llm, texts, odd):
    docs = [(i, texts.prose(texts.r.randint(0, 120))) for i in range(80)] + [(200, None), (201, "unseen-word"), (202, "")]
    df = llm.createDataFrame(docs, "doc_id bigint, text string").withColumn("held_out", F.expr("doc_id % 4 = 1"))
    s = language.LanguageSettings(head=60, inner=20, inner_classes=4, outer_classes=3)
    got = {r.doc_id: r for r in language.score(df, ~F.col("held_out"), s).collect()}
    want = plain.base_scores(docs, lambda i: i % 4 == 1)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-8 * max(1, abs(base)) and r.score < 0
    held = [i for i, _ in docs if i % 4 == 1]
    assert sum(got[i].score for i in held) > sum(want[i][3] for i in held)
    out = language.score(odd, F.col("doc_id") > 100, s)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    assert language.score(df.limit(0), F.lit(True), s).count() == 0


def test_network_learns_from_all_tokens(texts, monkeypatch):
    """Every word of every text is a target once a round, long texts too."""
    docs = [texts.prose(n) for n in (0, 1, 31, 32, 33, 700, 5000)]
    s = language.LanguageSettings()
    batch = pa.RecordBatch.from_pydict({"text": docs})
    h, first = language._tokens(batch)
    word, n = np.unique(h, return_counts=True)
    shape = gru.Shape((0, 2), 3, s.hidden)
    start = np.searchsorted(word, np.arange((1 << 20) + 1, dtype=np.uint64)[:-1] << np.uint64(44)).astype(np.int32)
    table = language.Table(word, (np.arange(len(word)) % 5).astype(np.int16), n, np.zeros(len(word)), start, shape, len(h), len(word))
    steps = []
    step = gru.Trainer._step
    monkeypatch.setattr(gru.Trainer, "_step", lambda self, rate, states, targets, *more: (steps.extend(targets), step(self, rate, states, targets, *more)))
    coded = next(language._coded(iter([batch.append_column("key", pa.array(range(7)))]), table))
    coded = coded.append_column("shard", pa.array([3] * 7, pa.int32()))
    out = list(language._trained(iter([coded]), shape, gru.flat(gru.initial(shape, np.ones(5))), s))
    assert out[0].column("seen")[0].as_py() == len(h)
    assert np.array_equal(np.bincount(np.concatenate(steps), minlength=5), np.bincount(table.slot[table.find(h)], minlength=5))
