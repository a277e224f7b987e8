import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing

SCHEMA = "doc_id long, text string, piece string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_cache_equals_whole_text_encoding():
    tok = Tokenizer.from_file(PATH)
    cache = packing.WordCache(PATH, limit=50)
    rnd = random.Random(3)
    alphabet = list("aBc'sdé ß\t\n\r\x0b\x0c\x1c\x85 　,.!123İΣς́") + ["<|endoftext|>", "'re", " "]
    for _ in range(400):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert np.frombuffer(cache.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_lower_bound_never_exceeds_optimum(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 12) for _ in range(7)]
    best = next(k for k in range(1, 8) if any(max(sum(x for x, b in zip(items, a) if b == j) for j in range(k)) <= 12 for a in itertools.product(range(k), repeat=7)))
    bound = packing.lower_bound(np.array(items), 12)
    fill = packing.best_fit_decreasing(np.array(items), 12)[2]
    assert bound <= best <= len(fill)
    assert fill.max() <= 12 and fill.sum() == sum(items)


def test_whole_packing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "the", "xyzzy"]) for _ in range(rnd.choice([0, 3, 900, 1800, 9000]))), None) for i in range(150)]
    rows += [(None, None, "x"), (3, rows[3][1], None), (3, rows[3][1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack_documents(df, per_partition=40).toPandas()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want.append((-1 if i is None else i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())))
    got = [tuple(int(v) for v in r) for r in out.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy()]
    assert sorted(got) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all() and g["length"].sum() <= 4096
    assert out["sequence_id"].nunique() <= packing.lower_bound(out["length"].to_numpy()) * 1.03 + 1


@pytest.mark.parametrize("at_once", [1, 7, 64])
def test_texts_cut_at_white_space_give_the_ids_of_the_whole(at_once):
    tok = Tokenizer.from_file(PATH)
    texts = ["one two\tthree  four " * 9, None, "", "   ", "a" * 200, "x" * 90 + " y", " lead", "trail "]
    got = list(packing.WordCache(PATH, limit=3).encode_all(texts, at_once))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_repeated_rows_and_null_ids_spread_and_large_ids_keep_their_digits(spark):
    far = (1 << 62) + 1
    df = spark.createDataFrame([(None, "the same words again", None)] * 4000 + [(far, "other words", None), (far + 2, None, None)], SCHEMA)
    out = packing.pack_documents(df, per_partition=500).toPandas()
    assert len(out) == 4002 and out["doc_id"].isna().sum() == 4000
    assert {r.doc_id for r in packing.pack_documents(df.where("doc_id is not null or text is null")).collect()} == {far, far + 2}
    parts = out.loc[out["round"] == 0, "sequence_id"].to_numpy() >> 24
    assert len(np.unique(parts)) > 4 or (out["round"] > 0).any()


def test_certificate_is_returned_and_holds(spark):
    rnd = random.Random(2)
    lengths = [rnd.choice([1400, 1500, 900, 2049, 3000, 40]) for _ in range(900)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    out = packing.pack(df, per_partition=100).toPandas()
    assert sorted(out["length"]) == sorted(lengths) and out.groupby("sequence_id")["length"].sum().max() <= 4096
    assert (out["part_bins"] >= out["part_bound"]).all()
    one = packing.best_fit_decreasing(np.array(lengths))[2]
    assert out["sequence_id"].nunique() <= len(one) * 1.02 + 1
    assert out["sequence_id"].nunique() >= packing.lower_bound(np.array(lengths))


def test_a_partition_that_cannot_be_certified_ends(spark):
    df = spark.createDataFrame([(i, 0, 0, 1400, 0) for i in range(60)], packing.PIECES)  # two to a sequence, the bound says so too
    assert packing.pack(df, per_partition=9).select("sequence_id").distinct().count() == 30
    odd = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate([1639, 1230, 1229] * 20 + [2050, 700, 1400] * 5)], packing.PIECES)
    out = packing.pack(odd, per_partition=8).toPandas()
    assert len(out) == 75 and out.groupby("sequence_id")["length"].sum().max() <= 4096


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
