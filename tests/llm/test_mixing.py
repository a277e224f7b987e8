import random
from collections import defaultdict

from sparkloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string, n_chars long"


def targets(sizes, cap=3.0):
    """Reshare by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: level * w[s] for s in free}}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def corpus(seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        s = rnd.choices(["b", "a", "é", None, "tiny", "z"], [10, 3, 3, 2, 0.2, 1])[0]
        rows.append((i, " ".join(["w"] * rnd.randint(0, 90)), s, None, 5))
    rows += [(2000, None, "b", None, None), (2001, "", None, None, None), (2002, "v " * 30_000, "a", None, 1), (7, rows[7][1], rows[7][2], None, 5), (None, "a b c", "b", None, None), (2003, "", "empty", None, None)]
    return rows


def test_targets_taken_and_bounds(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes, source = defaultdict(int), {}
    for i, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
        source[i] = s
    want, got = targets(sizes), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    for s, t in want.items():
        assert abs(got[s] - t) <= max(16, 0.01 * t), s
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(out, key=key) == sorted(again, key=key)


def test_every_stretch_of_the_schedule_is_near_the_weights(spark):
    s = spark.createDataFrame([("a", 1, 40_000, 10_000.0), ("b", 2, 40_000, 30_000.0), ("c", 3, 40_000, 60_000.0)], "source string, sid int, source_size long, target double")
    slots = sorted((r.slot, r.sid, r["rank"], r.block) for r in mixing.schedule(s, 100_000, 10).collect())
    assert [x[0] for x in slots] == list(range(10_000))
    for at in range(0, 10_000, 500):
        n = [sum(x[1] == k for x in slots[at : at + 500]) for k in (1, 2, 3)]
        assert all(abs(a - b) <= 6 for a, b in zip(n, (50, 150, 300), strict=True))
    for k in (1, 2, 3):
        assert [x[2] for x in slots if x[1] == k] == list(range(sum(x[1] == k for x in slots)))
        assert all(x[3] == x[2] % 4000 for x in slots if x[1] == k)


def test_mixed_documents(spark):
    rows = [r for r in corpus(1) if r[0] is not None and r[0] < 900 and r[0] != 7]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, texts = defaultdict(list), {i: t for i, t, *_ in rows}
    for r in out.collect():
        got[r.doc_id].append(r.text)
    for i, (n, size) in taken.items():
        assert sum(len(t.split()) for t in got[i]) == n
        assert sum(t == texts[i] for t in got[i]) >= (n // size if size else 0)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    out = mixing.mixed_documents(spark.createDataFrame(corpus()[:50], SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_small_sources_of_a_large_corpus_get_their_targets(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(mixing, "SLOTS", 64)  # blocks as coarse as those of a corpus of hundreds of millions of words
    sizes = {"a": [900] * 40, "b": [7, 20], "c": [300] * 2, "d": [1000] * 30, "e": [50] * 90}
    rows = [(1000 * k + i, " ".join(["w"] * n), s, None, 1) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = defaultdict(int)
    for r in corpus_pipeline.mixing_stage(spark, df, "").collect():
        got[r.source] += len(r.text.split())
    for s, t in targets({s: sum(ns) for s, ns in sizes.items()}).items():
        assert got[s] == round(t), s
    for r in mixing.mix(df).collect():
        assert r.taken <= 3 * r.size


def test_groups_of_like_rows_and_null_ids_are_laid_out_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "one two three", "a", None, 1)] * 100 + [(5, "one two", "a", None, 1)] * 30 + [(i, "w " * (i % 9), "b", None, 1) for i in range(10, 60)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 100 and sum(r.doc_id == 5 for r in out) == 30
    sizes = {"a": 360, "b": sum(i % 9 for i in range(10, 60))}
    want = targets(sizes)
    assert sum(r.taken for r in out if r.source_size == 360) == round(want["a"]) and sum(r.taken for r in out if r.source_size != 360) == round(want["b"])
    assert all(0 <= r.taken <= 3 * r.size for r in out)


def test_ids_that_are_missing_or_shared_leave_every_source_its_target(spark):
    shared = [(1, "w " * 900, "s1", None, 1), (1, "v " * 2700, "s2", None, 1)] + [(2, f"x{k} y z", "s1", None, 1) for k in range(5)]
    missing = [(None, f"a{k} b c", s, None, 1) for k, s in enumerate(["s1"] * 14 + ["s2"] * 13 + ["s3"] * 13)]
    for rows in (shared, missing, shared + missing + [(None, None, None, None, None), (7, "only", None, None, 1)]):
        sizes, got = defaultdict(int), defaultdict(int)
        for _, t, s, _, _ in rows:
            sizes[s] += len((t or "").split())
        for r in mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect():
            got[r.source] += len(r.text.split())
        for s, t in targets(sizes).items():
            assert got[s] == round(t), s


def test_the_mix_comes_in_its_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 4000)
    rows = [(i, " ".join([f"{s}{i}"] * 10), s, None, 1) for i, s in enumerate(random.Random(2).choices("abc", [6, 3, 3], k=4000))]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = defaultdict(int)
    for _, t, s, _, _ in rows:
        sizes[s] += len(t.split())
    want, total = targets(sizes), sum(sizes.values())
    out = mixing.mixed_documents(df).collect()
    for share in (0.01, 0.02, 0.05, 0.2, 0.5):
        n = defaultdict(int)
        for r in out[: int(share * len(out))]:
            n[r.source] += len(r.text.split())
        for s, t in want.items():
            assert abs(n[s] - t / total * sum(n.values())) <= 3 * 10, (share, s)  # a block of ten words a source, and a cut at either end
    slots = [r.slots for r in mixing.mix(df).orderBy("doc_id").collect()]
    assert all(x == sorted(x) and len(set(x)) == len(x) for x in slots)
    monkeypatch.setattr(mixing, "GOLDEN", 0.1234567)
    other = mixing.mix(df).orderBy("doc_id").collect()
    assert slots != [r.slots for r in other]
    assert [r.doc_id for r in mixing.mixed_documents(df).collect()] != [r.doc_id for r in out]
