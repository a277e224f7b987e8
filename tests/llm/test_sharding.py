import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def test_sharding_rows_slots_and_growth(spark):
    rows = [(i, f"té {i}" if i % 7 else None, "c") for i in range(4000)] + [(5, "té 5", None)] * 3 + [(None, "", None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard_documents(df, [1.0] * 16).toPandas()
    assert len(out) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in out.dropna(subset=["doc_id"]).itertuples():
        b = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 0.03 < len(moved) / len(out) < 0.09
    n = Counter(out["shard"])
    assert set(n) == set(range(16)) and max(n.values()) < 1.35 * min(n.values())


def test_weights_and_empty(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "cast(id as string) as text", "'x' as shard")
    n = Counter(r.shard for r in sharding.shard_documents(df, [1.0, 2.0]).select("shard").collect())
    assert abs(n[1] / 9000 - 2 / 3) < 0.03
    assert sharding.shard_documents(df.limit(0), [1.0] * 3).count() == 0


def test_every_shard_against_plain_hashing(spark):
    import math
    import struct

    import xxhash

    def draw(key, shard, weight, seed=0):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), h)
        return -weight / math.log(((h >> 11) + 0.5) / (1 << 53))

    rows = [(i, "x" * (i % 50), None) for i in [*range(700), -5, 1 << 62]] + [(None, None, None)] * 3 + [(9, "y" * 3_000_000, None)]
    weights = [1.0, 2.5, 0.5, 1.0, 3.0]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), weights, grown_weight=1.5).collect()
    assert len(out) == len(rows) and max(r.size for r in out) == 3_000_001
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        draws = [draw(key, s, w) for s, w in enumerate([*weights, 1.5])]
        assert r.shard == draws[:-1].index(max(draws[:-1])) and r.grown_shard == draws.index(max(draws))


def test_repeated_rows_spread_over_buckets(spark):
    df = spark.createDataFrame([(None, "", None)] * 3000, SCHEMA)
    out = sharding.shard_documents(df, [1.0] * 4)
    assert sorted(r.slot for r in out.collect()) == list(range(3000))
    one = sharding.slots(df.withColumn("s", F.lit(0)).withColumn("row", F.monotonically_increasing_id()), "s", "row", rows_per_bucket=100)
    assert sorted(r.slot for r in one.collect()) == list(range(3000))
