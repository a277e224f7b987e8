import numpy as np
import pytest

from sparkloom.llm import rabitq


def brute(rows, k):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    out = {}
    for q, x in good.items():
        if q % 20 == 0:
            s = sorted(((-float(np.cumsum(x * y)[-1]), i) for i, y in good.items() if i != q and len(y) == len(x)))[:k]
            out.update({(q, r + 1): (i, -v) for r, (v, i) in enumerate(s)})
    return out


@pytest.mark.parametrize(("n", "dim", "blocks"), [(400, 24, 100), (15, 5, 1000), (300, 1, 64)])
def test_against_brute_force(spark, n, dim, blocks):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n, dim)) * rng.gamma(1, 2, (n, 1))
    base[n // 2 : n // 2 + 30] = base[0]  # many copies: ties go to smaller ids
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(900, None), (920, [0.0] * dim), (940, [float("nan")] * dim), (960, [None] * dim), (980, [1.0] * (dim + 1)), (1000, [2.0] * (dim + 1)), (None, [1.0] * dim), (1020, [float("inf")] * dim), (1040, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    index, centres = rabitq.build_index(df)
    got = rabitq.search(index, centres, __import__("pyspark.sql.functions").sql.functions.col("id") % 20 == 0, 20, row_block=blocks, query_block=7).collect()
    want = brute(rows, 20)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert found.keys() == want.keys()
    assert sum(found[k] == want[k] for k in want) / len(want) > 0.99


def test_bound_prunes_and_recall_is_high():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 256)).astype(np.float32)
    x[::3] += 1.5 * rng.standard_normal(256).astype(np.float32)
    turn, c = rabitq.rotation(256), x.mean(axis=0).astype(float)
    codes = rabitq.encode(x.astype(float), c, turn)
    ids, q = np.arange(4000), np.arange(0, 4000, 100)
    got = rabitq.search_block(ids, x, codes, q, x[q], c, turn, 10)
    truth = x[q].astype(float) @ x.astype(float).T
    truth[np.arange(len(q)), q] = -np.inf
    hits = sum(len(set(np.argsort(-truth[j])[:10]) & set(got[1][got[0] == q[j]])) for j in range(len(q)))
    assert hits / (10 * len(q)) > 0.99
    assert got[3] < 0.5 * len(q) * 4000


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rabitq.nearest(df).count() == 0


def test_repeated_ids_are_one_neighbour_and_take_one_place(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(12)]) for i in range(300)]
    near = [float(np.float32(x)) for x in np.array(rows[20][1]) * 3]
    copies = rows + rows + [(301, near)] * 200 + [(301, [-x for x in near])] * 5  # each row twice; one id fills many places
    df = spark.createDataFrame(copies, "vec_id long, embedding array<float>")
    index, centres = rabitq.build_index(df)
    got = rabitq.search(index, centres, F.col("id") % 20 == 0, 20, row_block=5000).collect()
    want = brute([*rows, (301, near)], 20)  # the better row of 301 for query 20
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert found.keys() == want.keys()
    assert all(found[20, r] == want[20, r] for r in range(1, 21))
    assert all(len({found[q, r][0] for r in range(1, 21)}) == 20 for q, n in found if n == 1)


def test_double_vectors_and_extreme_scales(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x * s) for x in rng.standard_normal(16)]) for i, s in enumerate(rng.choice([1e-30, 1.0, 1e39, 1e-3], 400))]
    rows += [(1000, [0.1, 1.7] + [0.0] * 14), (1020, [0.0, 0.1] + [0.0] * 14), (2001, [1e200] * 16), (2003, [-1e308] * 16)]
    got = rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    good = {i: np.array(v) for i, v in rows}
    for r in got:
        assert r.score == float(np.cumsum(good[r.query_id] * good[r.vec_id])[-1])
    hits = 0
    for q in [i for i in good if i % 20 == 0]:
        with np.errstate(all="ignore"):
            want = sorted((-float(np.cumsum(good[q] * v)[-1]), i) for i, v in good.items() if i != q)[:20]
        hits += len({i for _, i in want} & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 20 * sum(i % 20 == 0 for i in good) and hits >= 0.97 * len(got)
