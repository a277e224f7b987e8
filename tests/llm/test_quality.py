import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import quality


def corpus(n=600):
    rnd = random.Random(2)
    good = "the a of river stone walks light under tree and while some quiet people read letters near water".split()
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(good) for _ in range(rnd.randint(20, 120))]
        bad = i % 3 == 0
        t = " ".join(x.upper() + "!!" for x in w[:6] * 8) if bad else " ".join(w).capitalize() + "."
        docs.append((i, t, f"s{i % 4}", 9.0))
        if i % 10:
            labels.append((i, int(not bad)))
    return docs, labels


def test_statistics_of_odd_texts():
    for t in [None, "", " \n\t ", "a", "\x00", "é" * 5, "x" * 300_000, "word " * 100_000]:
        s = quality.statistics(t)
        assert s.shape == (quality.N_STATS,) and np.isfinite(s).all()


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    y, n = rng.random(9), rng.integers(1, 5, 9).astype(float)
    knots, values = quality.isotonic(np.arange(9.0), y * n, n)
    assert (np.diff(values) > 0).all()
    fit = np.empty(9)
    for i in range(9):  # max over starts of min over ends of the mean
        fit[i] = max(min((y[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, 9)) for a in range(i + 1))
    assert np.allclose(np.unique(fit.round(12)), values.round(12))


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [(1000, None, None, None), (1001, "", "s", 1.0), (1001, "", "s", 1.0), (None, "The quiet river.", None, None)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string, predicted double")
    return d, spark.createDataFrame(labels + [(3, None), (None, 1), (7, 1)], "doc_id long, quality int"), docs, extra


def test_held_out_accuracy_and_folds(tables):
    d, labels, docs, extra = tables
    out = quality.classify(d, labels).toPandas()
    assert len(out) == len(docs) + len(extra) and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3).astype(int) == out["predicted"]).all()
    known = out.dropna(subset=["doc_id"])
    assert (known["held_out"] == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known["doc_id"]]).all()
    held = known[known["held_out"] & (known["doc_id"] < 600)]
    assert (held["predicted"] == (held["doc_id"] % 3 != 0)).mean() > 0.97


def test_labels_of_the_held_out_fold_are_not_used(tables, spark):
    d, labels, _, _ = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a = quality.classify(d, labels).orderBy("doc_id").toPandas()
    b = quality.classify(d, flipped).orderBy("doc_id").toPandas()
    assert np.allclose(a["score"], b["score"], atol=1e-9)


def test_keep_good_and_without_labels(tables, spark):
    d, labels, docs, _ = tables
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 3 == 0 for i in ids if i and i < 600) < 6 and sum(bool(i and i < 600 and i % 3) for i in ids) == 400
    none = quality.classify(d, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all() and (none["predicted"] == 1).all()
    assert quality.classify(d.limit(0), labels).count() == 0


def test_fit_and_scores_against_one_dense_solve(spark, tables, monkeypatch):
    d, labels, docs, extra = tables
    monkeypatch.setattr(quality, "ROWS_A_SUM", 3)  # several levels of sums
    stats = quality.document_statistics(d).cache()
    model = quality.fit(stats, labels, features=40)
    got = {r.doc_id: r for r in quality.score(stats, model).collect()}
    truth = {}
    for i, v in [(r.doc_id, r.quality) for r in labels.collect()]:
        if i is not None and v is not None:
            truth.setdefault(i, []).append(v)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(i, t) for i, t, *_ in docs + extra if i in truth and fold(i) != 0]
    x = np.array([quality.statistics(t).astype(np.float32) for _, t in known], dtype=float)
    y = np.array([np.mean(truth[i]) for i, _ in known])
    scale = x.std(axis=0)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(scale > 1e-9, scale, 1.0))
    learn = np.array([fold(i) != 4 for i, _ in known])
    z = model.features(x)
    penalty = np.full(z.shape[1], 0.03)
    penalty[0] = 1e-6
    beta = np.linalg.solve(z[learn].T @ z[learn] + np.diag(penalty), z[learn].T @ y[learn])
    assert np.allclose(z @ beta, z @ model.beta, atol=1e-6)
    for (i, _), raw in zip(known, z @ beta, strict=True):
        assert abs(got[i].score - min(1, max(0, np.interp(raw, model.knots, model.values)))) < 1e-6
