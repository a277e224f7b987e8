import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact
from sparkloom.llm.common import durable

SCHEMA = "doc_id long, text string, digest string, row int, seen string"


def corpus(n=3000, seed=3):
    rnd = random.Random(seed)
    texts = ["", None, "É é", "é é", "A b", "a B", " a b", "ß", "SS", *[f"Text {k}" for k in range(700)]]
    rows = [(i, rnd.choice(texts) if i % 3 else "the hot text", "x", 1, None) for i in range(n)]
    return [*rows, (None, "A b", None, None, None), (None, "only nulls", None, None, None), (None, "ONLY nulls", None, None, None), (5, "twice", None, 1, "t"), (5, "Twice", None, 1, "t"), (-1, "neg", None, 0, None), ((1 << 62) + 1, "NEG", None, 0, None), (7_000, "long " * 600_000, None, 0, None)]


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("half", ["xxhash64(doc_id) % 2 = 0", "true", "false", "doc_id > 1500"])
def test_against_brute_force(spark, half, monkeypatch):
    monkeypatch.setattr(exact, "PER_PART", 100)
    rows = corpus()
    out = exact.deduplicate(spark.createDataFrame(rows, SCHEMA), F.expr(half)).collect()
    ids, groups = defaultdict(list), defaultdict(list)
    for i, t, *_ in rows:
        h = hashlib.sha256(norm(t).encode()).hexdigest()
        ids[i].append(h)
        groups[h].append(i)
    assert len(out) == len(rows)
    kept = defaultdict(list)
    for r in out:
        assert r.text_sha256 in ids[r.doc_id]
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((i for i in g if i is not None), default=None)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {h: [max((i for i in g if i is not None), default=None)] for h, g in groups.items()} == kept
    if half == "true":
        assert all(r.seen for r in out)
    if half == "false":
        assert not any(r.seen for r in out)


def test_empty_and_single(spark):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    assert exact.deduplicate(df.limit(0), F.lit(True)).count() == 0
    one = exact.deduplicate(df.limit(1), F.lit(None).cast("boolean")).collect()
    assert len(one) == 1 and one[0].kept and one[0].group_size == 1


@pytest.mark.parametrize("levels", [40, 1, 0])
@pytest.mark.parametrize("n", [0, 1, 2, 9, 5000])
def test_perfect_hash_is_minimal_and_perfect(monkeypatch, levels, n):
    monkeypatch.setattr(exact, "LEVELS", levels)
    d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n + 500)), np.uint8).reshape(-1, 32)
    made, order = exact.PerfectHash.build(d[:n])
    slots = made.slots(d[:n])
    assert sorted(slots) == list(range(n))
    assert all((d[order[s]] == d[i]).all() for i, s in enumerate(slots))
    other = made.slots(d[n:])
    assert ((other >= -1) & (other < max(n, 1))).all()
    if levels == 40 and n == 5000:
        assert len(made.bits) * 8 < 6 * n and not len(made.rest)


def test_a_kept_index_takes_batch_after_batch(spark, monkeypatch):
    monkeypatch.setattr(exact, "PER_PART", 50)
    rows = corpus(1200)
    df = spark.createDataFrame([(*r[:2], None, k, None) for k, r in enumerate(rows)], SCHEMA)
    rows_all = durable(exact.digested(df, batch=F.col("row") % 3), "t")
    want = {(r.digest, r.winner_id, r.copies) for r in exact.grouped(rows_all).collect()}
    parts = 2  # too few for what comes: dealt anew
    held = durable(exact.index(exact.grouped(rows_all.where("batch = 0")), parts), "t")
    for b in (1, 2):
        new = rows_all.where(F.col("batch") == b)
        groups = durable(exact.against(held, new, 30_000 if b == 1 else new.count()), "t")
        held = durable(exact.index(groups, exact.parts_for(groups.count())), "t")
    got = exact.slots(held).collect()
    assert {(r.digest, r.winner_id, r.copies) for r in got} == want and len(got) == len(want)
