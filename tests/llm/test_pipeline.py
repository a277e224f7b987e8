"""The pipeline's stages against brute force on a small fixture."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_simhash import brute_components, brute_fp
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _own string"
LANGS = {"en": "the and of to in that it was for with", "fr": "le la les des est dans que qui pour une"}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(420):
        lang = ("en", "fr")[i % 2]
        w = [rnd.choice(LANGS[lang].split()) + rnd.choice(["", "a", "e"]) for _ in range(rnd.randint(25, 70))]
        if i >= 400:  # a copy, a word changed
            w = rows[i - 400][1].split()
        bad = i % 5 == 0 and i < 400
        text = "\n".join([" ".join(x.upper() + "!!" for x in w[:5])] * 8) if bad else " ".join(w)
        rows.append((i, text, lang, f"s{i % 3}" if i % 7 else None, len(text), "keep"))
        labels.append((i, int(not bad)))
    rows += [(900, None, None, None, None, None), (901, "12 34 56 78", "en", "s1", 11, None), (7, rows[7][1], "fr", "s1", 1, "again")]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    kept, docs = [spark.read.parquet(f"{d}/documents.parquet")], None
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, kept[-1], d)
        docs.write.parquet(f"{d}/out{n}")
        kept.append(spark.read.parquet(f"{d}/out{n}"))
    return d, [x.collect() for x in kept], [x.columns for x in kept], kept


def test_columns_and_decisions(fixture):
    _, (start, good, known, unique, mixed, packed), columns, _ = fixture
    assert len(corpus_pipeline.STAGES) == 5 and all(c == columns[0] for c in columns[:5])
    bad = {r.doc_id for r in start if r.doc_id % 5 == 0 and r.doc_id < 400}
    left = {r.doc_id for r in good}
    assert len(bad & left) <= 2 and len({r.doc_id for r in start} - bad - left) <= 3
    assert {900, 901} & {r.doc_id for r in known} == set() and len(known) >= len(good) - 2


def test_dedup_keeps_the_smallest_of_each_group(fixture):
    _, (_, _, known, unique, *_), *_ = fixture
    ids = sorted({r.doc_id for r in known})
    text = {r.doc_id: r.text for r in known}
    comp = brute_components([brute_fp(text[i]) for i in ids])
    assert sorted(r.doc_id for r in unique) == [i for k, i in enumerate(ids) if comp[k] == k]


def test_mix_and_pack_hold_the_same_words(fixture, spark):
    _, (_, _, _, unique, mixed, packed), _, frames = fixture
    taken = {r.doc_id: r.taken for r in mixing.mix(frames[3]).collect()}
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: v for k, v in taken.items() if v})
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r.doc_id, r.length) for r in packed) == want
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_run_equals_the_stages(fixture, spark):
    d, (*_, packed), *_ = fixture
    got = corpus_pipeline.run(spark, d).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, packed))


def test_without_documents(fixture, spark):
    d, *_ = fixture
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0


def test_dedup_keeps_different_texts_of_one_id_and_rows_without_one(spark):
    a, b, c = ("one two three four five six seven eight", "quite another text that has nothing in common with it", "a third text of some length that stands alone here")
    rows = [(5, a, "en", "s", 1, None), (5, b, "en", "s", 1, None), (5, a, "en", "t", 1, None), (9, b, "en", "s", 1, None), (None, c, "en", "s", 1, None), (None, c, "fr", "s", 1, None), (None, a, "en", "s", 1, None)]
    out = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted([(5, a), (5, b), (-1, c)])
