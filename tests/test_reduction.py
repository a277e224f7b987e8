"""Topic reduction, held against merging the texts and weighing them anew."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import reduction


def texts(seed=1):
    rnd = random.Random(seed)
    vocab = {g: [f"{g}{k}" for k in range(12)] for g in "abcd"}
    rows = []
    for topic in range(11):
        g = "abcd"[topic % 4]
        own = [f"t{topic}x{k}" for k in range(5)]
        rows += [(topic, " ".join(rnd.choices(vocab[g], k=9) + rnd.choices(own, k=4) + ["the"])) for _ in range(20)]
    return [*rows, (-1, "a1 b2 noise noise"), (-1, "the the"), (None, "a1 a2")]


def weights(labelled):
    n = defaultdict(Counter)
    for t, x in labelled:
        n[t].update(x.split())
    f = sum(n.values(), Counter())
    mean = sum(f.values()) / len(n)
    return {t: {w: c / sum(v.values()) * math.log(1 + mean / f[w]) for w, c in v.items()} for t, v in n.items()}


def cosine(a, b):
    dot = sum(x * b.get(w, 0) for w, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


@pytest.mark.parametrize("least,topics", [(0.3, 1), (0.05, 5), (0.999, 1)])
def test_merges_equal_those_of_the_texts_read_anew(spark, least, topics):
    rows = texts()
    sums = spark.createDataFrame(rows, "topic long, text string").select("topic", F.explode(F.split("text", " ")).alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    labels, merges = reduction.reduced_topics(sums.unionByName(sums.limit(0)), least, topics)
    labelled, want = [(t, x) for t, x in rows if t is not None and t != -1], []
    while len({t for t, _ in labelled}) > topics:
        w = weights(labelled)
        near = {}
        for t in w:
            s, o = min((-round(cosine(w[t], w[u]), 9), u) for u in w if u != t)
            if -s >= least:
                near[t] = (o, -s)
        pairs = sorted(((-s, t, o) for t, (o, s) in near.items() if t < o and near.get(o, (None,))[0] == t))[: len(w) - topics]
        if not pairs:
            break
        want.append({(t, o) for _, t, o in pairs})
        into = {o: t for _, t, o in pairs}
        labelled = [(into.get(t, t), x) for t, x in labelled]
    got = defaultdict(set)
    for r in merges.collect():
        got[r.round].add((r.a, r.b))
    assert [got[k] for k in sorted(got)] == want and (want or least > 0.9)
    named = {r.topic: r.reduced for r in labels.collect()}
    kept = [(t, x) for t, x in rows if t is not None and t != -1]
    assert [named[t] for t, _ in kept] == [t for t, _ in labelled] and named[-1] == -1 and None not in named


def test_no_topics(spark):
    empty = spark.createDataFrame([], "topic int, term string, n long")
    labels, merges = reduction.reduced_topics(empty)
    assert labels.count() == 0 and merges.count() == 0


def test_words_are_read_once(spark, monkeypatch):
    """Each round was a search over all words of all topics; both ways give the same merges."""
    rows = texts(3)
    sums = spark.createDataFrame(rows, "topic long, text string").select("topic", F.explode(F.split("text", " ")).alias("term"), F.lit(1).alias("n"))
    asked = []
    search = reduction.best_neighbour
    monkeypatch.setattr(reduction, "best_neighbour", lambda *a: asked.append(1) or search(*a))
    once = {(r["round"], r.a, r.b, round(r.similarity, 6)) for r in reduction.reduced_topics(sums, 0.3)[1].collect()}
    assert not asked and len(once) > 5
    monkeypatch.setattr(reduction, "MANY", 2)
    assert {(r["round"], r.a, r.b, round(r.similarity, 6)) for r in reduction.reduced_topics(sums, 0.3)[1].collect()} == once and asked
