"""Nearest others by character runs, held against plain loops over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import neardup
from sparkloom.operators import semantic as M


def runs(text):
    out = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def vectors(texts, min_df=1, max_terms=None):
    tf = {k: runs(t) for k, t in texts.items()}
    df, total = Counter(g for v in tf.values() for g in v), Counter()
    for v in tf.values():
        total.update(v)
    terms = sorted((g for g in df if df[g] >= min_df), key=lambda g: (-total[g], g))[:max_terms]
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in terms}
    out = {}
    for k, v in tf.items():
        w = {g: n * idf[g] for g, n in v.items() if g in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        out[k] = {g: x / size for g, x in w.items()}
    return out


def nearest(vec, threshold):
    best = {}
    for a, va in vec.items():
        sims = [(-round(sum(x * vec[b].get(g, 0) for g, x in va.items()), 9), b) for b in vec if b != a]
        if sims and -min(sims)[0] >= threshold:
            s, b = min(sims)
            best[min(a, b), max(a, b)] = -s
    return best


def near(seed, n):
    rnd = random.Random(seed)
    base = [" ".join("".join(rnd.choices("aeioustrn", k=rnd.randint(2, 7))) for _ in range(rnd.randint(8, 40))) for _ in range(n // 3)]
    out = []
    for k in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 3, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(["rose", "tin", "sausen", "Ästro"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_nearest_of_every_document(spark, monkeypatch, threshold):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "BOUND", 64)
    texts = dict(enumerate(near(1, 150)))
    d = spark.createDataFrame(list(texts.items()), "id int, text string")
    w = M.tfidf(neardup.char_grams(d, "id", "text"), "key", len(texts), 1)
    got = {(r.a, r.b): r.similarity for r in neardup.best_neighbour(w, threshold).collect()}
    want = nearest(vectors(texts), threshold)
    # of equal similarities another may be named: copies of one text are each other's nearest
    close = lambda s: round(s, 6)
    for k in {k for p in want for k in p}:
        assert max(close(s) for p, s in got.items() if k in p) == max(close(s) for p, s in want.items() if k in p)
    assert {k for p in got for k in p} == {k for p in want for k in p} and len(want) > 30
    distinct = {t: k for k, t in reversed(texts.items())}
    alone = {k for k in distinct.values() if list(texts.values()).count(texts[k]) == 1}
    assert {p for p in got if set(p) <= alone} == {p for p in want if set(p) <= alone}


def test_audit_of_kinds_in_one_plan(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 15)
    texts = near(4, 120)
    rows = [(f"k{i:03d}", t, ("post", "reply", None)[i % 3], ("ann", "Ann ", None, "bob")[i % 4], "x") for i, t in enumerate(texts)]
    rows += [("s1", "short", "post", "ann", "x"), ("s2", None, "reply", "ann", "x"), ("s3", "", None, None, "x"), ("one", "a kind with a single text in it of enough words", "lonely", "ann", "x")]
    d = spark.createDataFrame(rows, "key string, t string, kind string, who string, w string")
    got = {(r.kind, r.a, r.b): (round(r.similarity, 6), r.same_author) for r in neardup.near_duplicate_audit(d, "key", "t", "kind", "who", 0.8, max_terms=400).collect()}
    for kind in ("post", "reply", None):
        mine = {k: t for k, t, kd, *_ in rows if kd == kind and t and len(t) >= 40 and len(t.split()) >= 6}
        want = {p: round(s, 6) for p, s in nearest(vectors(mine, 2, 400), 0.8).items()}
        have = {(a, b): s for (kd, a, b), (s, _) in got.items() if kd == kind}
        assert want and {k for p in have for k in p} == {k for p in want for k in p}
        for k in {k for p in want for k in p}:
            assert max(s for p, s in have.items() if k in p) == max(s for p, s in want.items() if k in p)
    who = {k: (w or "").strip().lower() for k, _, _, w, _ in rows}
    assert all(same == (who[a] == who[b] != "") for (_, a, b), (_, same) in got.items())
    assert not any("one" in p for p in got)
    assert neardup.near_duplicate_audit(d.where(F.lit(False)), "key", "t", "kind", "who").count() == 0


@pytest.mark.parametrize("vocabulary", [1 << 20, 60])
def test_runs_move_packed_and_rare_ones_are_joined(spark, monkeypatch, vocabulary):
    """Runs of characters were rows, and a document's vector moved once for every 1,024 others."""
    monkeypatch.setattr(neardup, "VOCABULARY", vocabulary)
    monkeypatch.setattr(neardup, "BLOCK", 30)
    texts = dict(enumerate([*near(6, 100), "", "  ", "a", "ß 𝄞𝄞 x", None, "Tin  rose\nrose", "tin rose rose tin rose rose"]))
    d = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {(r.a, r.b): round(r.similarity, 6) for r in neardup.nearest_by_char_runs(d, "id", "text", 0.7).collect()}
    want = {p: round(s, 6) for p, s in nearest({k: v for k, v in vectors({k: t or "" for k, t in texts.items()}, 2).items() if v}, 0.7).items()}
    assert {k for p in got for k in p} == {k for p in want for k in p} and len(want) > 30
    for k in {k for p in want for k in p}:
        assert max(s for p, s in got.items() if k in p) == max(s for p, s in want.items() if k in p)
    assert (105, 106) in got and got[105, 106] == 1.0


def test_a_packed_document_takes_few_bytes():
    rnd = np.random.default_rng(0)
    ids, tf = np.sort(rnd.choice(1 << 18, 2000, replace=False)), rnd.geometric(0.7, 2000)
    b = neardup._packed(ids, tf)
    assert all((x == y).all() for x, y in zip(neardup._unpacked(b), (ids, tf), strict=True)) and len(b) < 2000 * 4


def test_only_leading_hashes_are_rows_and_families_hold(spark, monkeypatch):
    """Every hash of every text was a row, and every set moved for each side of the candidates."""
    rnd = random.Random(5)
    line = "one common line that very many of the texts share word for word here"
    base = [[f"w{rnd.randrange(4000)}" for _ in range(60)] for _ in range(25)]
    rows = []
    for k in range(75):
        w = list(base[k % 25])
        w[rnd.randrange(60)] = f"x{k}"
        rows.append((k, " ".join([line, *w] if k % 2 else w)))
    rows += [(k + 100, t) for k, t in rows[:10]]
    d = spark.createDataFrame(rows, "id int, text string")
    prefix, *_ = neardup._prefixes(d, "id", "text", 0.85, 5, 20)
    assert prefix.groupBy("rep").count().agg(F.max("count")).first()[0] <= 0.15 * 70 + 2
    s = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    root = {k: k for k in s}
    for _ in s:
        for a in s:
            for b in s:
                if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.85:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[k]] == root[k] for k in s):
            break
    want = dict(root)
    for asked in (1 << 22, 3):
        monkeypatch.setattr(neardup, "ASKED", asked)
        got = {r.key: r.family for r in neardup.near_families(d, "id", "text").collect()}
        assert got == want and len(set(want.values())) < 75


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_no_document_moves_for_every_block(spark, monkeypatch):
    """A packed document was shuffled once for every block of its kind, and those files stayed."""
    texts = dict(enumerate(near(8, 120)))
    d = spark.createDataFrame(list(texts.items()), "id int, text string")
    want = nearest(vectors(texts, 2), 0.7)
    moved = []
    for largest in (1 << 14, 8):
        monkeypatch.setattr(neardup, "LARGEST", largest)
        before = shuffled(spark)
        got = {(r.a, r.b): round(r.similarity, 6) for r in neardup.nearest_by_char_runs(d, "id", "text", 0.7).collect()}
        moved.append(shuffled(spark) - before)
        assert {k for p in got for k in p} == {k for p in want for k in p} and len(want) > 30
        assert all(max(s for p, s in got.items() if k in p) == round(max(s for p, s in want.items() if k in p), 6) for q in want for k in q)
    assert moved[1] < 2 * moved[0]


def test_shuffles_behind_a_written_table_go_at_once(spark):
    from sparkloom.operators.scratch import durable

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: str(disk.getAllBlocks()).count("shuffle_")
    before = files()
    t = durable(spark.range(1000).repartition(3, "id"), "moved")
    assert files() <= before and t.count() == 1000


def test_shingle_sets_of_all_texts_are_not_written(spark, monkeypatch):
    """The sets of all texts were written, which took more room than the texts."""
    written = []
    monkeypatch.setattr(neardup, "_durable", lambda df, tag: written.append(df.columns) or df)
    d = spark.createDataFrame([(k, " ".join(f"w{k + i}" for i in range(30))) for k in range(3)], "id int, text string")
    neardup._prefixes(d, "id", "text", 0.85, 5, 20)
    assert written and not any("s" in columns for columns in written)
