"""Rules held against hand-made texts."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rules as R
from sparkloom.functions import text as T

RC = R.REDDIT_COMMENT


def column(spark, rows, schema, expr):
    """Values of one expression over the rows, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").coalesce(1)
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def texts(spark, values, expr):
    return column(spark, [(v,) for v in values], "t string", expr)


def test_cleaning(spark):
    got = texts(spark, ["a &amp;lt; b  https://x.y/z  c", None, "  ", "WWW.foo.bar end"], T.clean("t"))
    assert got == ["a &lt; b c", "", "", "end"]
    assert texts(spark, ["@who #Tag said  http://a"], T.clean("t", microblog=True)) == ["Tag said"]
    assert texts(spark, ["Hi @bob: #x 1BR/2 50%!"], T.text_key("t")) == ["hi bob x 1br 2 50"]
    assert texts(spark, ["Hi @bob: #x 1BR/2 50%!"], T.dup_key("t")) == ["hi x 1br 2 50"]
    assert texts(spark, ["Hi @bob: 1BR/2 50%!"], T.match_key("t")) == ["hi bob 1br/2 50%"]
    assert texts(spark, ["É  a", None], T.nfc("t")) == ["É  a", None]


def test_boundaries_are_unicode(spark):
    p = T.phrases(["t", "of the"])
    assert texts(spark, ["été", "a t b", "OF THE rest", "soft heat"], T.has("t", p)) == [False, True, True, False]
    assert texts(spark, ["Rent rent RENTS rents"], F.array_join(T.bounded_hits("t", ["rent", "rents"]), ",")) == ["rent,rents"]
    assert texts(spark, ["the agents in detroit"], F.array_join(T.substring_hits("t", ["agent", "roi", "x"]), ",")) == ["agent,roi"]
    assert texts(spark, ["é a b'c", "", None], T.word_count("t")) == [4, 0, 0]


def test_moderator_mask(spark):
    rows = [("reddit", "AutoModerator"), ("reddit", " automoderator "), ("reddit", "u/AutoModerator"), ("reddit", "/u/AutoModerator"), ("reddit", "automation_expert"), ("reddit", "AutoModeratorFan"), ("reddit", None), ("twitter", "AutoModerator")]
    got = column(spark, rows, "p string, u string", R.known_moderator("p", "u"))
    assert got == [True] * 4 + [False] * 4


def test_removal_ignores_near_duplicates(spark):
    rows = [(True, False, False, False), (False, False, False, False), (False, False, True, False), (False, False, False, True)]
    got = column(spark, rows, "a boolean, b boolean, c boolean, d boolean", R.removal(*[F.col(c) for c in "abcd"]))
    assert got == [True, False, True, False]


def test_promotion_and_context(spark):
    sure, unsure = R.promotion(*R.cues("t").values())
    values = ["whatsapp me about this villa", "contact us please", "for sale, 2 br, we are offering", "nice villa", None]
    assert texts(spark, values, sure) == [True, False, True, False, False]
    assert texts(spark, values, unsure) == [False, True, False, False, False]
    rows = [("yes it is", "my rent rose", RC), ("yes it is", "my rent rose", "reddit_post"), ("the rent", "", "reddit_post")]
    assert column(spark, rows, "t string, c string, k string", R.relevance("t", "c", "k")) == [True, False, True]


def test_low_information_family(spark):
    rows = [("Thanks!", RC), ("Thanks!", "reddit_post"), ("please check dm soon", RC), ("a long and thoughtful answer about rents", RC), (None, RC), ("This post was removed by X", RC)]
    assert column(spark, rows, "t string, k string", R.low_information("t", "k")) == [True, False, True, False, False, True]
    rows = [("hi please check my dm", RC), ("thanks", RC), ("hi what about the rent", RC)]
    assert column(spark, rows, "t string, k string", R.contact_only("t", "k")) == [True, True, False]  # "thanks" is one of its words
    assert column(spark, rows, "t string, k string", R.reaction_only("t", "k")) == [False, True, False]
    rows = [("any details here", RC), ("dm", RC), ("details", RC), ("", RC), ("rent is high now", RC)]
    assert column(spark, rows, "t string, k string", R.short_contact_comment("t", "k")) == [True, True, True, False, False]
    assert column(spark, rows, "t string, k string", R.short_contact_comment("t", "k", strict_reference=True)) == [False, True, True, True, False]
    rows = [("Sent", RC), ("hey, I just sent you the plan", RC), ("nothing", RC)]
    assert column(spark, rows, "t string, k string", R.extra_contact_variant("t", "k")) == [True, True, False]


def test_refined_listing(spark):
    strong, weak, shield = ["call now", "dm me"], ["aed", "sqft", "vacant", "payment plan"], ["report", "index"]
    values = ["call now or dm me", "call now 5 aed", "call now", "aed sqft vacant payment plan", "report aed sqft vacant payment plan", "report call now aed"]
    assert texts(spark, values, R.refined_listing("t", strong, weak, shield)) == [True, True, False, True, False, True]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("DM me for viewing, I have options", "explicit_contact_invitation"),
        ("Is this still available? dm me for details, our agent", ""),
        ("Broker here, we have got a few", "broker_inventory_offer"),
        ("For sale: 2 BR, AED 1,200,000, 900 sqft", "explicit_property_offer"),
        ("Looking for a flat for rent, 2 br aed 50,000", ""),
        ("Distress sale! 3 bed villa aed 2,000,000", "explicit_sales_marketing"),
        ("Call me on +971 50 123 4567 about 2 br of 900 sqft", "explicit_phone_offer"),
        ("Rents are up", ""),
    ],
)
def test_explicit_offers(spark, text, want):
    assert texts(spark, [text], R.explicit_offer("t")) == [want]


def test_triage_last_rule_wins(spark):
    long = "my landlord in dubai raised the rent again and I wonder what the rera index says"
    rows = [
        ("war near dubai", "", "a"), ("that is right", "the landlord of my flat", "a"), (long, "", "a"), ("rent in jvc", "", "a"),
        (long + " for sale dm", "", "a"), ("rent in jvc", "", "AutoModerator"), ("hello", "", "a"), ("cheap car rental in dubai with a driver for all of the long week ahead", "", "a"),
    ]
    want = ["geopolitics_excluded_no_property_link", "context_dependent", "property_discussion_candidates", "short_property_context_needed", "property_promotion_candidates", "automated_candidates", "uncertain_or_other", "uncertain_or_other"]
    assert column(spark, rows, "t string, p string, a string", R.triage("t", "p", "a")) == want


def test_strata_and_filler(spark):
    filler = "buy this lovely thing right now " * 5
    assert texts(spark, [filler, "a b c " * 3, None], T.repeated_filler("t")) == [True, False, False]
    long = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    rows = [(3, "short"), (3, long), (-1, filler), (-1, "dm " + long), (-1, "rent " + long), (-1, "short"), (-1, long)]
    want = ["assigned_short_or_contact", "assigned_other", "outlier_repeated_filler", "outlier_contact", "outlier_own_property_word", "outlier_short_no_detected_property_link", "outlier_other"]
    assert column(spark, rows, "topic int, t string", R.sampling_stratum("topic", "t", F.lit(""), T.repeated_filler("t"))) == want


def test_mentions_and_languages(spark):
    found = T.literal_mentions("t", ["Dubai Marina", "Marina", "JVC", "Al Furjan"], least=5)
    assert texts(spark, ["near dubai marina and Al Furjan", "the marina", "jvc"], F.array_join(found, "|")) == ["al furjan|dubai marina", "marina", ""]
    assert texts(spark, ["near dubai marina and Al Furjan", "the marina", "jvc"], T.mention_status(found)) == ["multiple", "single", "none"]
    rows = [("en", "x"), ("fr", "x"), (None, "short"), (None, "x" * 30)]
    assert column(spark, rows, "l string, t string", T.english("l", "t")) == [True, False, True, None]


def test_cleaning_of_both_branches(spark):
    rows = [("a &lt;b&gt; &eacute;&#8364; &amp;amp; https://x.y/z  end",), ("@who \U0001f600 #Rent  www.a.b now",), (None,), ("",)]
    d = spark.createDataFrame(rows, "t string")
    plain = [r[0] for r in d.select(T.clean("t")).collect()]
    assert plain[0] == "a <b> é€ &amp; end" and plain[2:] == ["", ""]
    micro = d.select(T.clean("t", microblog=True)).collect()[1][0]
    assert micro == ":grinning_face: Rent now"
    assert d.select(T.normalise_text("t")).collect()[1][0] == ":grinning_face: Rent now"


def test_repeat_keys_meet_over_normal_forms_and_case_folding(spark):
    d = spark.createDataFrame([("Cafe\u0301  STRASSE",), ("caf\u00e9 stra\u00dfe",), ("cafe strasse",)], "t string")
    a, b, c = [r[0] for r in d.select(T.family("t")).collect()]
    assert a == b != c


def test_ids_and_public_names(spark):
    d = spark.createDataFrame([("reddit_post_t3_ab",), ("x t1_cd ",), (None,)], "i string")
    assert [r[0] for r in d.select(T.strip_long_id("i")).collect()] == ["ab", "x cd", ""]
    import hashlib

    names = [r[0] for r in d.select(T.public_author("i")).collect()]
    assert names[0] == hashlib.sha256(b"reddit_post_t3_ab").hexdigest()[:16] and names[2] is None


def test_english_with_and_without_fallback(spark):
    rows = [("en", "x"), ("de", "the and of"), (None, "short"), ("", "the rent is too high and it is not for us"), ("nan", "das ist ein langer deutscher Satz ohne mehr"), (None, None)]
    d = spark.createDataFrame(rows, "l string, t string")
    assert [r[0] for r in d.select(T.english("l", "t")).collect()] == [True, False, True, None, None, True]
    assert [r[0] for r in d.select(T.english("l", "t", fallback=True)).collect()] == [True, False, True, True, False, True]


@pytest.mark.parametrize(
    ("text", "kind", "v2", "v3"),
    [
        ("For sale by agent", "reddit_post", True, True),
        ("broker with a studio", "reddit_post", True, True),
        ("broker opinion", "reddit_post", False, False),
        ("aed sqft 1br vacant", "reddit_post", True, True),
        ("market report: aed sqft 1br vacant", "reddit_post", False, False),
        ("valuation aed sqft 1br vacant", "reddit_post", True, False),
        ("we looked at aed sqft 1br vacant", "reddit_post", False, True),
        ("dm me", "reddit_comment", False, True),
        ("dm me market", "reddit_comment", False, True),
        ("rent with broker", "reddit_post", True, False),
        ("", "reddit_comment", False, False),
    ],
)
def test_listing_rules(spark, text, kind, v2, v3):
    d = spark.createDataFrame([(text, kind)], "t string, k string")
    assert tuple(d.select(R.refined_listing("t"), R.refined_listing_with_contact("t", "t", "k")).first()) == (v2, v3)


def test_every_route_has_a_reason(spark):
    rows = [("war in dubai", "", "a"), ("yes", "rent in dubai", "a"), ("my landlord in dubai raised the rent again and I do not know what to do now", "", "a"), ("rent dubai", "", "a"), ("hello", "", "automoderator"), (None, None, None)]
    d = spark.createDataFrame(rows, "t string, p string, a string")
    got = d.select(R.triage("t", "p", "a").alias("route"), R.triage("t", "p", "a", reasons=True).alias("why")).collect()
    assert all(R.TRIAGE_REASONS[r.route] == r.why for r in got) and len({r.route for r in got}) == 6


def _patterns(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")


def test_a_key_is_made_once_for_all_its_words(spark):
    """Each of the words had the whole key computed anew."""
    d = spark.createDataFrame([("Rent, RENT at www.x.y the-marina",)], "t string")
    words = ["rent", "x.y", "the-marina", *[f"word{i}" for i in range(40)]]
    hits = d.select(T.substring_hits("t", words).alias("h"))
    assert _patterns(hits) <= 2 and hits.first().h == ["rent", "the-marina"]
    filler = d.select(T.max_shingle_repeat(F.concat_ws(" ", F.array_repeat("t", 9)), 5).alias("n"))
    assert _patterns(filler) == 1 and filler.first().n == 9


def test_keys_take_one_pattern_beside_links(spark):
    d = spark.createDataFrame([("@A  b#c -- d_e/f\tx\u00e9y http://q.r/s z!",)], "t string")
    keys = d.select(T.text_key("t").alias("a"), T.match_key("t").alias("b"))
    assert tuple(keys.first()) == ("a b c d e f x y z", "a b c -- d_e/f x y z")
    assert _patterns(d.select(T.text_key("t").alias("k"))) == 2 and _patterns(d.select(T.match_key("t").alias("k"))) == 2


def test_repeat_keys_of_common_letters_stay_in_the_jvm(spark):
    """Every text beyond ASCII went through Python, whose memory grew with them."""
    import random
    import unicodedata

    seen = spark.createDataFrame([("\u00dcber Stra\u00dfen \u201cCaf\u00e9\u201d \u0416",), ("a\u0301",), ("\u0130",), ("\u1e9e",), ("\u03a3\u03c2",), ("\u212b",), ("\u1100\u1161",)], "t string")
    assert [r.x for r in seen.select(F.col("t").rlike(T._any_of(T._not_composed() | T._not_folded())).alias("x")).collect()] == [False, True, True, True, True, True, True]
    rnd = random.Random(3)
    ranges = [(0x20, 0x7F), (0xA0, 0x530), (0x300, 0x370), (0x1100, 0x1200), (0x13A0, 0x1400), (0x1E00, 0x2000), (0xAC00, 0xAC20), (0xFB00, 0xFB07), (0x10400, 0x10450)]
    texts = ["x" + "".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 9))) + "x" for _ in range(3000)]
    texts = [t for t in texts if not any(c.isspace() for c in t.replace(" ", ""))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.repeat_key("t").alias("k"), T.nfc("t").alias("n")).collect()
    lower = {r.c: r.l for r in spark.createDataFrame([(c,) for c in {c for t in texts for c in unicodedata.normalize("NFC", t).casefold()}], "c string").select("c", F.lower("c").alias("l")).collect()}
    for r in got:
        assert r.n == unicodedata.normalize("NFC", texts[r.i])
        assert r.k == " ".join("".join(lower[c] for c in r.n.casefold()).split()), ascii(texts[r.i])
