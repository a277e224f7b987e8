import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import numeric as N
from sparkloom.functions import time as C
from sparkloom.operators import clustering, neardup
from sparkloom.operators import aggregates as A
from sparkloom.operators import joins as J
from sparkloom.operators import sampling as Q
from sparkloom.operators import semantic as M
from sparkloom.operators import statistics as K
from sparkloom.operators import windows as W


def test_unique_keys_are_enforced(spark):
    a = spark.createDataFrame([("x", "1", 1), ("x", "1", 2)], "platform string, id string, v int")
    with pytest.raises(J.KeyViolation, match="Duplicate platform/id"):
        J.one_to_one(a, a, ["platform", "id"])
    b = a.limit(1)
    assert J.one_to_one(b, b, ["platform", "id"], ("_a1", "_a2")).columns == ["platform", "id", "v_a1", "v_a2"]


def test_parent_text_blanks_markers_and_strangers(spark):
    posts = spark.createDataFrame([("p", "post")], "id string, text string")
    comments = spark.createDataFrame([("c", "[deleted]"), ("d", "reply")], "id string, text string")
    r = spark.createDataFrame([(1, "t3_p"), (2, "t1_c"), (3, "t1_d"), (4, "t3_d"), (5, None)], "n int, parent_id string")
    got = {x.n: x.parent_text for x in J.parent_text(r, posts, comments, "parent_id").collect()}
    assert got == {1: "post", 2: "", 3: "reply", 4: "", 5: ""}


def test_correlation_of_constants_is_null(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.5), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: r.r for r in d.groupBy("g").agg(N.correlation("x", "y").alias("r")).collect()}
    assert got["b"] is None and math.isclose(got["a"], np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])


def test_student_p_against_simulation_free_values():
    assert math.isclose(K.correlation_p(0.0, 10), 1.0)
    assert K.correlation_p(1.0, 10) == 0.0 and K.correlation_p(None, 10) is None and K.correlation_p(0.3, 2) is None
    assert math.isclose(K.correlation_p(0.5, 4), 0.5, rel_tol=1e-12)  # two degrees of freedom: p = 1 - |r|
    assert math.isclose(K.correlation_p(-0.9, 3), 1 - 2 / math.pi * math.asin(0.9), rel_tol=1e-9)  # one degree of freedom


def test_bootstrap_indices_and_draws(spark):
    idx = K.stationary_indices(16, 400, 3, 1)
    steps = ((idx[:, 1:] - idx[:, :-1]) % 16 == 1).mean()
    assert idx.min() >= 0 and idx.max() < 16 and abs(steps - (2 / 3 + 1 / 48)) < 0.03
    x, y = np.random.default_rng(0).standard_normal((2, 16))
    d = spark.createDataFrame([("g", i, float(x[i]), float(y[i])) for i in range(16)], "g string, week int, x double, y double")
    got = {r.draw: r.r for r in K.bootstrap_correlations(d, ["g"], "week", K.index_table(spark, 16, 20, 3, 1)).collect()}
    again = K.stationary_indices(16, 20, 3, 1)
    for k in range(20):
        assert math.isclose(got[k], np.corrcoef(x[again[k]], y[again[k]])[0, 1], abs_tol=1e-9)
    both = K.contrasts(spark.createDataFrame([("g", 1, 0.5)], "g string, draw int, r double"), spark.createDataFrame([("g", 1, 0.2)], "g string, draw int, r double"), ["g"]).first()
    assert math.isclose(both.r, 0.3)


def test_sample_size():
    assert K.sample_size(10_000_000) == 385 and K.sample_size(1000) == 278 and K.sample_size(0) == 0


def test_rolling_mean_stays_in_its_group(spark):
    rows = [("a", i, 1000.0) for i in range(15)] + [("b", i, 10.0) for i in range(15)]
    d = spark.createDataFrame(rows, "g string, t int, v double").withColumn("m", W.rolling_mean("v", ["g"], "t"))
    assert {(r.g, r.m) for r in d.collect()} == {("a", 1000.0), ("b", 10.0)}


def test_row_index_with_ties_and_chunks(spark):
    d = spark.createDataFrame([(i // 7, i) for i in range(500)], "a int, b int").repartition(5)
    got = {r.b: r.n for r in W.row_index(d, ["a", "b"], "n", chunk_rows=60).collect()}
    assert got == {i: i for i in range(500)}


def test_row_index_of_very_many_chunks(spark, monkeypatch):
    """A bucket a chunk, written as one sum of conditions, broke the parser's stack."""
    monkeypatch.setattr(W, "RANGES", 8, raising=False)
    d = spark.range(4000).select(F.col("id").alias("b"), (F.col("id") % 3000).alias("a"))
    got = [r.b for r in W.row_index(d, ["a", "b"], "n", chunk_rows=1).orderBy("n").collect()]
    assert got == sorted(range(4000), key=lambda i: (i % 3000, i))


def test_waterfall_and_unknown_units(spark):
    d = spark.createDataFrame([("x", 1, ""), ("x", 2, None), ("y", 3, "u"), ("y", 4, "u")], "k string, n int, author string")
    rows, flow = A.exclusion_waterfall(d, [("one", F.col("n") == 1), ("author", F.col("author") == "u")], "k")
    assert {r.n: r.exclusion_reason for r in rows.collect()} == {1: "one", 2: "", 3: "author", 4: "author"}
    assert sorted((r.k, r.stage_order, r.removed, r.retained) for r in flow.collect()) == [("x", 1, 1, 1), ("x", 2, 0, 1), ("y", 1, 0, 2), ("y", 2, 2, 0)]
    w = A.inverse_multiplicity(d, ["k"], "author", "n")
    assert {r.n: r.weight for r in w.collect()} == {1: 1.0, 2: 1.0, 3: 0.5, 4: 0.5}


def test_quota_is_unique_and_fails_when_short(spark):
    d = spark.createDataFrame([("a", i, f"t{i % 12}") for i in range(40)] + [("b", 100 + i, f"t{i % 9}") for i in range(30)], "s string, k int, thread string")
    got = Q.unique_quota(d, "s", "k", ["thread"], 4).collect()
    assert sorted(r.s for r in got) == ["a"] * 4 + ["b"] * 4 and len({r.thread for r in got}) == 8
    with pytest.raises(ValueError, match="cannot give"):
        Q.unique_quota(d, "s", "k", ["thread"], 10)


def test_allocation():
    assert sum(Q.allocate({"a": 900, "b": 90, "c": 1}, 50).values()) == 50
    assert Q.allocate({"a": 900, "b": 1}, 1) == {"a": 1, "b": 1}


def test_near_families_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(12):
        w = [f"w{x}" for x in rng.integers(0, 400, rng.integers(20, 90))]
        docs.append(w)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.integers(0, 3)):
                v[rng.integers(0, len(v))] = "zz"
            docs.append(v)
    docs += [docs[0], ["short", "text"], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(len(docs), None)]
    got = {r.key: r.family for r in neardup.near_families(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 20 else set() for w in docs]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(rows))}
    assert len(set(got.values())) < len(rows) - 12


def test_char_gram_neighbours_against_brute_force(spark):
    texts = ["the quick brown fox", "the quick brown fix", "a slow green turtle", "a slow green turtles", "nothing alike at all"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = M.tfidf(neardup.char_grams(d, "id", "text"), "key", len(texts), 1).cache()
    got = {(r.a, r.b): r.similarity for r in neardup.best_neighbour(w, 0.6).collect()}
    vec = [{} for _ in texts]
    for r in w.collect():
        vec[r.key][r.term] = r.weight
    sim = lambda i, j: sum(x * vec[j].get(t, 0) for t, x in vec[i].items())
    want = {}
    for i in range(5):
        j = max((j for j in range(5) if j != i), key=lambda j: (sim(i, j), -j))
        if sim(i, j) >= 0.6:
            want[(min(i, j), max(i, j))] = sim(i, j)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want) and want


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_linkage_against_greedy(method):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    z = clustering.linkage(d.copy(), method)
    clusters = {i: [i] for i in range(14)}
    heights = []
    while len(clusters) > 1:
        def cost(a, b):
            p, q = clusters[a], clusters[b]
            m = d[np.ix_(p, q)]
            if method == "ward":
                return math.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(0) - x[q].mean(0))
            return {"single": m.min, "complete": m.max, "average": m.mean}[method]()

        a, b = min(((a, b) for a in clusters for b in clusters if a < b), key=lambda ab: cost(*ab))
        heights.append(cost(a, b))
        clusters[a] += clusters.pop(b)
    assert np.allclose(z[:, 2], heights)
    lab = clustering.cut(z, 14, k=4)
    assert lab.max() == 3 and len(lab) == 14


def test_silhouette_of_two_points_apart():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0.0]])
    assert math.isclose(clustering.silhouette(d, np.array([0, 0, 1, 1])), 8 / 9)


def test_embedding_cache_and_norms(spark):
    t = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [3.0, 4.0])], "key string, vec array<double>")
    joined, missing = M.cached_embeddings(t, c, "key", "vec")
    assert joined.count() == 3 and [r.key for r in missing.collect()] == ["b"]
    assert [r.key for r in M.norm_violations(c, "vec").collect()] == ["z"]


def test_epoch_detection(spark):
    d = spark.createDataFrame([("1704067200",), ("1704067260",), (None,)], "t string")
    assert [str(r.o) for r in C.parse_times(d, "t", "o").collect()][:2] == ["2024-01-01 00:00:00", "2024-01-01 00:01:00"]
    d = spark.createDataFrame([("2024-01-01 05:00:00",), ("junk",)], "t string")
    assert [str(r.o) for r in C.parse_times(d, "t", "o").collect()] == ["2024-01-01 05:00:00", "None"]


def test_snowflake(spark):
    d = spark.createDataFrame([(str((1_700_000_000_000 - C.SNOWFLAKE_EPOCH_MS) << 22),)], "id string")
    assert str(d.select(C.snowflake_time("id").alias("t")).first().t) == "2023-11-14 22:13:20"


def test_density_clusters_find_two_blobs_and_noise():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (25, 2)), [[2.5, -9.0]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels, strength = clustering.density_clusters(d, 10, 5)
    assert len(set(labels[:30]) - {-1}) == 1 and len(set(labels[30:55]) - {-1}) == 1 and labels[0] != labels[31] and labels[55] == -1
    assert (labels[:55] >= 0).mean() > 0.8 and strength.max() == 1.0 and strength[55] == 0


def test_near_duplicate_audit_and_flags(spark):
    base = "a rather long sentence about nothing in particular that is repeated"
    rows = [("p1", base, "c", "ann", 2), ("p2", base + "!", "c", "ann", 1), ("p3", base + "?", "c", "bob", 3), ("p4", "short", "c", "ann", 4), ("p5", "something else entirely with enough words and characters in it", "c", None, 5), ("q1", base, "x", "ann", 6)]
    d = spark.createDataFrame(rows, "k string, t string, kind string, who string, at int")
    pairs = neardup.near_duplicate_audit(d, "k", "t", "kind", "who", 0.9, min_df=1)
    got = {(r.kind, r.a, r.b): r.same_author for r in pairs.collect()}
    assert set(got) <= {("c", "p1", "p2"), ("c", "p1", "p3"), ("c", "p2", "p3")} and len(got) >= 2 and got.get(("c", "p1", "p2"), True)
    flags = {r.k: r.is_near_duplicate_repeat for r in neardup.near_repeat_flags(d, pairs, "k", "at", 0.9).collect()}
    assert not flags["p2"] and not flags["p3"] and not flags["p4"] and sum(flags.values()) == int(("c", "p1", "p2") in got)


def test_demojize(spark):
    from sparkloom.functions.text import demojize

    d = spark.createDataFrame([("hi \U0001f600!",), (None,), ("plain",)], "t string").coalesce(1)
    assert [r.v for r in d.select(demojize("t").alias("v")).collect()] == ["hi  :grinning_face: !", None, "plain"]


def test_bootstrap_takes_every_row_of_series_of_unequal_length(spark):
    x, y = np.random.default_rng(2).standard_normal((2, 14))
    sizes = {"a": 5, "b": 14}
    d = spark.createDataFrame([(g, i, float(x[i]), float(y[i])) for g, n in sizes.items() for i in range(n)], "g string, week int, x double, y double")
    lengths = d.groupBy("g").count().withColumnRenamed("count", "n")
    got = {(r.g, r.draw): r.r for r in K.bootstrap_correlations(d, ["g"], "week", K.index_tables(lengths, 30, 3, 1)).collect()}
    for g, n in sizes.items():
        idx = K.stationary_indices(n, 30, 3, 1 + 300 + n)
        for k in range(30):
            if len(set(idx[k])) > 2:
                assert math.isclose(got[g, k], np.corrcoef(x[idx[k]], y[idx[k]])[0, 1], abs_tol=1e-9)
    with pytest.raises(Exception, match="no indices"):
        K.bootstrap_correlations(d, ["g"], "week", K.index_table(spark, 5, 30, 3, 1)).collect()


def test_families_of_many_near_copies_form_no_pairs(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:60] + [f"own{i}"] + words[60:])) for i in range(1500)] + [(5000 + i, " ".join(f"v{i}x{j}" for j in range(60))) for i in range(20)]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {r.key: r.family for r in neardup.near_families(d, "id", "text").collect()}
    assert all(got[i] == 0 for i in range(1500)) and all(got[5000 + i] == 5000 + i for i in range(20))


def test_nearest_of_copies_are_copies(spark):
    texts = {1: "alpha beta gamma delta", 2: "alpha beta gamma delta", 3: "alpha beta gamma delta", 4: "quite different words here", 5: "alpha beta gamma deltas"}
    d = spark.createDataFrame(list(texts.items()), "id int, text string")
    w = M.tfidf(neardup.char_grams(d, "id", "text"), "key", len(texts), 1)
    got = {(r.a, r.b): round(r.similarity, 6) for r in neardup.best_neighbour(w, 0.6).collect()}
    assert got[1, 2] == got[1, 3] == 1.0 and (1, 5) in got and not any(4 in p for p in got)


def test_false_discovery_in_chunks_equals_one_window(spark):
    import numpy as np

    p = [round(float(x), 3) for x in np.random.default_rng(0).random(300)] + [None]
    d = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    whole = {r.k: r.q for r in K.benjamini_hochberg(d.withColumn("g", F.lit(1)), "p", "k", ["g"]).collect()}
    parts = {r.k: r.q for r in K.benjamini_hochberg(d, "p", "k", chunk_rows=37).collect()}
    assert whole.keys() == parts.keys() and whole[300] is None and parts[300] is None
    assert all(abs(whole[k] - parts[k]) < 1e-12 for k in range(300))


def test_false_discovery_frames_only_grow(spark):
    """A frame from a row to the end is added up anew for each row: the square of a chunk's rows."""
    d = spark.createDataFrame([(i, i / 50) for i in range(50)], "k int, p double")
    for q in (K.benjamini_hochberg(d, "p", "k", chunk_rows=20), K.benjamini_hochberg(d.withColumn("g", F.lit(1)), "p", "k", ["g"])):
        assert "currentrow$(), unboundedfollowing" not in q._jdf.queryExecution().optimizedPlan().toString().lower()


def test_helper_columns_leave_the_callers_alone(spark):
    d = spark.createDataFrame([(1, "a", 5, 7, 9), (2, "a", 6, 8, 9), (3, "b", 7, 9, 9)], "id int, g string, _n int, _k0 int, _s int")
    assert sorted(map(tuple, Q.per_group(d, ["g"], "id", 1).select("g", "_n").collect())) and "_n" in Q.per_group(d, ["g"], "id", 1).columns
    assert sorted(r._n for r in W.best(d, ["g"], "id").collect()) == [5, 7]
    assert [r._n for r in J.unambiguous(d.select("g", "_n"), spark.createDataFrame([("b",)], "g string"), ["g"]).collect()] == [7]
    looked = J.lookup(d, F.col("id"), [(spark.createDataFrame([(1, "one")], "k int, v string"), "k", "v")], "name", "?")
    assert [(r._k0, r.name) for r in looked.orderBy("id").collect()] == [(7, "one"), (8, "?"), (9, "?")]
    assert Q.proportional(d, "g", "id", 2).columns == d.columns and W.row_index(d.withColumnRenamed("_k0", "_p"), ["id"]).count() == 3
