import random
import zlib

import numpy as np

from sparkloom.llm import language

WORDS = {
    "en": "the and of to in that it was for with which from people",
    "de": "der und die das nicht ein ist mit auf auch werden über",
    "fr": "le la les des est dans que qui pour une avec était",
    "es": "el los las del está que para una con por según año",
}


def test_grams_of_odd_texts_and_pieces():
    assert not language.grams(None).any() and not language.grams("").any()
    assert abs(np.linalg.norm(language.grams("12 ?!")) - 0) < 1.01
    assert abs(np.linalg.norm(language.grams("hello there")) - 1) < 1e-5
    long = language.grams("hello there " * 500_000)  # more than one piece
    assert np.allclose(long, language.grams("hello there " * 50_000), atol=1e-3)


def test_letters():
    assert [language.has_letter(t) for t in (None, "", "12 ³²", "é", "１２", "日", "a")] == [False, False, False, True, False, True, True]


def test_family_then_language(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(1200):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(8, 60))), lang if i % 11 else None, "x"))
    rows += [(5000, None, "en", "x"), (5001, "123 !!", "de", "x"), (5002, "", None, None), (None, "der und die das", None, None), (5003, "THE AND OF " * 40_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = language.identify(df, language.fit(df)).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    known = out.dropna(subset=["doc_id"])
    assert (known["held_out"] == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in known["doc_id"]]).all()
    main = known[known["doc_id"] < 1200]
    assert (main["lang_pred"] == [list(WORDS)[int(i) % 4] for i in main["doc_id"]])[main["held_out"]].mean() > 0.97
    assert set(out[out["doc_id"].isin([5000, 5001, 5002])]["lang_pred"]) == {"und"}
    kept = language.keep_identified(df, language.fit(df), min_score=0.0)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    nothing = language.fit(df.where("false"))
    assert nothing is None and set(language.identify(df, nothing).toPandas()["lang_pred"]) == {"und"}
    one = df.where("lang = 'fr'")
    assert set(language.identify(one, language.fit(one)).toPandas()["lang_pred"]) == {"fr"}
    assert language.identify(df.limit(0), nothing).count() == 0


def test_machines_and_coupling_against_plain_loops():
    rnd = random.Random(3)
    langs = [list(WORDS)[i % 4] for i in range(160)]
    x = np.stack([language.grams(" ".join(rnd.choice(WORDS[v].split()) for _ in range(12))) for v in langs]).astype(np.float32)
    model = language.fit_rows(x, langs)
    of = {v: language.family_of(v, language.FAMILIES) for v in WORDS}
    assert set(model.families) == set(of.values()) and all(of[v] == f for f, vs in model.members.items() for v in vs)

    def shares(row, pairs, k):
        if k == 1:
            return [1.0]
        r = [[None] * k for _ in range(k)]
        for m, a, b in pairs:
            p = 1 / (1 + np.exp(-float(np.clip((row @ model.weights[m, :-1] + model.weights[m, -1]) * model.slopes[m], -30, 30))))
            r[a][b], r[b][a] = p, 1 - p
        raw = [1 / (sum(1 / max(r[a][b], 1e-12) for b in range(k) if b != a) - (k - 2)) for a in range(k)]
        return [v / sum(raw) for v in raw]

    got, score = model.predict(x)
    for i, row in enumerate(x):
        fam = shares(row, model.family_pairs, len(model.families))
        f = int(np.argmax(fam))
        inner = shares(row, model.language_pairs[model.families[f]], len(model.members[model.families[f]]))
        best = int(np.argmax(inner))
        assert got[i] == model.members[model.families[f]][best] and abs(score[i] - fam[f] * inner[best]) < 1e-4


def test_large_ids_keep_their_digits_beside_null_ids(spark):
    far = (1 << 62) + 1
    df = spark.createDataFrame([(far, "the and of", "en"), (None, "le la les", "fr"), (far + 2, None, None)], "doc_id long, text string, lang string")
    out = language.identify(df, language.fit(df)).collect()
    assert {r.doc_id for r in out} == {far, None, far + 2}
