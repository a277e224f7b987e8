import random

import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_kernel_against_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fp, group = [], []
    for g, n in enumerate([1, 3, 200, 64, 130]):
        for _ in range(n):
            x = int(base[g % 4])
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fp.append(x)
            group.append(g)
    got = {tuple(p) for p in simhash.within_radius(np.array(fp, dtype=np.uint64), np.array(group), radius).tolist()}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and bin(fp[i] ^ fp[j]).count("1") <= radius}
    assert got == want


def test_near_duplicates_whole_job(spark):
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "One", "one ", "a b", "word " * 30000, "É É é x", "a b c d"]
    for _ in range(25):
        w = [rnd.choice("abcdefghij") + rnd.choice("klmnop") * rnd.randint(1, 4) for _ in range(rnd.randint(3, 220))]
        texts.append(" ".join(w))
        for _ in range(6):
            v = list(w)
            v[rnd.randrange(len(v))] = "zz"
            texts.append("  ".join(v).upper())
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", __import__("pyspark.sql.functions").sql.functions.lit("clash"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fp(t) for t in texts]
    comp = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in range(len(texts))}
    assert len(set(comp)) < len(comp) - 20


def test_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(7, "x y z", None, None, None)] * 3 + [(None, "x y z", None, None, None), (None, "q", None, None, None)], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("7", "7")] * 3 + [("None", "7"), ("None", "None")]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
