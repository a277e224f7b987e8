"""Anchored correlation explanation, held against plain loops over a dense matrix."""

import numpy as np
import pytest

from sparkloom.operators import corex

GROUPS = [["rent", "lease", "tenant", "landlord"], ["loan", "bank", "rate", "escrow"], ["pool", "garden", "villa", "beach"]]
NOISE = [f"w{c}" for c in "abcdefgh"]


def corpus(n=240, seed=0):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = i % 3
        words = [w for w in GROUPS[g] if rnd.random() < 0.7] + [w for w in NOISE if rnd.random() < 0.3] + [w for k in (0, 1, 2) if k != g for w in GROUPS[k] if rnd.random() < 0.06]
        rows.append((i, " ".join(words) if i % 40 else (None if i % 80 else "")))
    return rows


def plain(X, p, rounds, anchors, strength):
    """Every sum over documents and words written out."""
    n, v = X.shape
    m = p.shape[1]
    alpha = None
    for r in range(rounds + 1):
        if r:
            p = np.zeros((n, m))
            for d in range(n):
                for j in range(m):
                    a = []
                    for q, prior in ((with_[:, j], share[j]), (without[:, j], 1 - share[j])):
                        a.append(np.log(prior) + sum(alpha[i, j] * np.log(q[i] / px[i] if X[d, i] else (1 - q[i]) / (1 - px[i])) for i in range(v)))
                    p[d, j] = 1 / (1 + np.exp(a[1] - a[0]))
        mass = p.sum(axis=0)
        share, px = (mass + 0.5) / (n + 1), (X.sum(axis=0) + 0.5) / (n + 1)
        with_ = np.array([[(sum(p[d, j] for d in range(n) if X[d, i]) + 0.5) / (mass[j] + 1) for j in range(m)] for i in range(v)])
        without = np.array([[(sum(1 - p[d, j] for d in range(n) if X[d, i]) + 0.5) / (n - mass[j] + 1) for j in range(m)] for i in range(v)])
        info = np.zeros((v, m))
        for i in range(v):
            for j in range(m):
                x1 = share[j] * with_[i, j] + (1 - share[j]) * without[i, j]
                for s, q in ((share[j], with_[i, j]), (1 - share[j], without[i, j])):
                    info[i, j] += s * (q * np.log(q / x1) + (1 - q) * np.log((1 - q) / (1 - x1)))
        best = (np.arange(m)[None] == info.round(12).argmax(axis=1)[:, None]).astype(float)
        alpha = best if alpha is None else 0.7 * alpha + 0.3 * best
        for (i, j) in anchors:
            alpha[i, j] = strength
    return alpha, with_, share, info


def test_rounds_equal_plain_loops_and_anchors_are_recovered(spark):
    df = spark.createDataFrame(corpus(), "k long, text string").repartition(3)
    docs = df.selectExpr("k as doc", "concat(split(text, ' '), array(cast(null as string)), split(text, ' ')) as words")
    anchors = [["villa", "beach"], ["nowhere"], ["rent"]]
    model, bags = corex.fit(docs, topics=4, anchors=anchors, seed=5, rounds=3, tolerance=0, min_df=3)
    got = {r.doc: r for r in bags.collect()}
    first = {r.doc: r.p for r in docs.select("doc", corex.beginnings(4, 5).alias("p")).collect()}
    X = np.array([[i in set(got[d].ids) for i in range(len(model.words))] for d in range(240)])
    p = np.array([first[d] for d in range(240)])
    at = model.words.index
    fixed = [(at("villa"), 0), (at("beach"), 0), (at("rent"), 2)]
    p[:, 0] = 0.5 * p[:, 0] + 0.25 * (X[:, at("villa")].astype(float) + X[:, at("beach")])
    p[:, 2] = 0.5 * p[:, 2] + 0.5 * X[:, at("rent")]
    alpha, with_, share, info = plain(X, p, 3, fixed, 3.0)
    for a, b in ((model.alpha, alpha), (model.with_topic, with_), (model.share, share), (model.information, info)):
        assert np.allclose(a, b, atol=1e-9)


def test_topics_of_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus()], "k long, text string, topic string")
    words, docs = corex.anchored_topics(df, "k", "text", topics=4, anchors=[["villa", "beach"], ["loan"], ["rent"]], rounds=20, min_df=3, top=4)
    top = {}
    for r in words.collect():
        top.setdefault(r.topic, set()).add(r.term)
    assert top[0] == set(GROUPS[2]) and top[1] == set(GROUPS[1]) and top[2] == set(GROUPS[0])
    got = {r.doc: r for r in docs.collect()}
    assert len(got) == 240 and all(0 <= x <= 1 for r in got.values() for x in r.p)
    likeliest = {i: int(np.argmax(r.p[:3])) for i, r in got.items()}  # the fourth topic is free and takes the noise
    right = [likeliest[i] == {0: 2, 1: 1, 2: 0}[i % 3] for i in range(240) if i % 40]
    assert sum(right) / len(right) > 0.75  # an anchor weighs three times as much as any word, and three in ten documents lack theirs
    with pytest.raises(ValueError):
        corex.fit(df.limit(0).selectExpr("k as doc", "split(text, ' ') as words"))


def test_words_are_numbered_in_small_batches():
    """A batch's words were all objects of Python at once, so memory grew with the rows of a batch."""
    import pyarrow as pa

    bags = [["b", "x", "a", "b"], None, [], [None, "c"], ["x"]] * 300
    whole = pa.RecordBatch.from_arrays([pa.array(range(1505)), pa.array([["c"]] * 5 + bags)], names=["doc", "words"]).slice(5)
    out = list(corex.coded(["c", "b", "a"])([whole]))
    assert max(b.num_rows for b in out) <= corex.STRIP and len(out) > 1
    got = pa.Table.from_batches(out).to_pydict()
    assert got["doc"] == list(range(5, 1505)) and got["ids"] == [[1, 2], [], [], [0], []] * 300
