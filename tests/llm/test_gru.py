import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import gru


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = gru.Network(rng.integers(0, 50, gru.OUTPUTS).astype(float))
    for n in net.NAMES:
        setattr(net, n, (getattr(net, n) + rng.standard_normal(getattr(net, n).shape) * 0.1).astype(np.float64))
    inp, tgt = rng.integers(0, 200, (3, 5)), rng.integers(0, 200, (3, 5))
    fresh = np.zeros((3, 5))
    fresh[:, 0] = fresh[1, 3] = 1
    h = rng.standard_normal((3, gru.HIDDEN))
    loss, grad, _ = net.gradients(inp, tgt, fresh, h)
    for n in net.NAMES:
        a = getattr(net, n)
        spots = np.argsort(-np.abs(grad[n]).ravel())[:4]
        for s in spots:
            at = np.unravel_index(s, a.shape)
            old = a[at]
            a[at] = old + 1e-2
            up = net.gradients(inp, tgt, fresh, h)[0]
            a[at] = old - 1e-2
            down = net.gradients(inp, tgt, fresh, h)[0]
            a[at] = old
            assert math.isclose((up - down) / 2e-2, grad[n][at], rel_tol=3e-2, abs_tol=1e-5), n


def test_probabilities_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(1)
    net = gru.Network(rng.integers(0, 50, gru.OUTPUTS).astype(float))
    net.load(net.parameters() + rng.standard_normal(net.parameters().size) * 0.1)
    h = np.repeat(rng.standard_normal((1, gru.HIDDEN)).astype(np.float32), gru.OUTPUTS, axis=0)
    assert abs(np.exp(net.log_probs(h, np.arange(gru.OUTPUTS)).astype(float)).sum() - 1) < 1e-3
    docs = [rng.integers(1, gru.OUTPUTS, n) for n in (1, 5, 31, 32, 33, 100, 700)] + [np.array([0])]
    want = []
    for d in docs:  # step by step
        s, total, before = np.zeros((1, gru.HIDDEN), np.float32), 0.0, 0
        for o in d:
            s = net.step(net.x[[before]], s)[0]
            total += float(net.log_probs(s, np.array([o]))[0])
            before = o
        want.append(total / np.log(10))
    assert np.allclose(net.score(docs), want, rtol=1e-4)
    assert np.allclose(net.score(docs[-3:]), want[-3:], rtol=1e-4)


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(4)
    vocab = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    rows = [(i, " ".join(rnd.choice(vocab[i % 2]) for _ in range(rnd.randint(5, 80))), "z") for i in range(700)]
    rows += [(1000, None, None), (1001, "", None), (1002, "B1 b1\tnever-seen " * 3000, None), (None, "a1 a2", None), (4, rows[4][1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return rows, gru.score_documents(df, head=70).toPandas()


def test_base_counts_against_brute_force(scored):
    rows, out = scored
    tok = {n: (t or "").lower().split() + [None] for n, (_, t, _) in enumerate(rows)}
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _, _ in rows]
    c = Counter(w for n, ws in tok.items() if not held[n] for w in ws)
    total, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held[n], len(tok[n]), sum(c[w] > 0 for w in tok[n]), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in tok[n]), 6)) for n, (i, _, _) in enumerate(rows))
    got = sorted((int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.fillna({"doc_id": -1}).itertuples())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5


def test_model_beats_the_base_on_held_out_text(scored):
    _, out = scored
    held = out[out["held_out"] & (out["doc_id"] < 700)]
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()
    assert held["score"].sum() > 0.9 * held["base_score"].sum()


def test_empty_and_nothing_to_learn(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert gru.score_documents(df).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = gru.score_documents(spark.createDataFrame([(lone, "x y")], "doc_id long, text string")).first()
    assert (out.n_tokens, out.n_known, out.train_tokens, out.base_score) == (3, 0, 0, 0.0)


def test_every_training_document_reaches_the_network(spark, monkeypatch):
    models, keep = [], gru.durable
    monkeypatch.setattr(gru, "durable", lambda df, tag: models.append(keep(df, tag)) or models[-1])
    monkeypatch.setattr(gru, "WARM_STEPS", 2)
    monkeypatch.setattr(gru, "REFINER_DOCS", 40, raising=False)
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 5}") for i in range(300)], "id long, text string")
    lex, outputs = gru.build_lexicon(gru.word_counts(df), 300)
    gru.learn(df, lex, outputs)
    assert sum(r.n for m in models for r in m.collect()) == 300 * 3


def test_mean_of_models(spark):
    rng = np.random.default_rng(5)
    p, n = rng.standard_normal((40, 6)).astype(np.float32), rng.integers(1, 9, 40)
    rows = [(i, p[i].tobytes(), int(n[i])) for i in range(40)]
    got = gru.mean_model(spark.createDataFrame(rows, gru.MODEL), 40).collect()
    assert len(got) == 1 and got[0].n == n.sum()
    assert np.allclose(np.frombuffer(got[0].p, np.float64), np.average(p.astype(np.float64), axis=0, weights=n))
