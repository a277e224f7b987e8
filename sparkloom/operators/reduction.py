"""Reduction of topics by merging those whose words are most alike.

A topic is its sums of words. Sums add up, so a merge changes weights without a text being read again: each round weighs the
words of the topics as they stand, finds every topic's nearest by cosine and merges all pairs that are each other's nearest,
until no pair is as similar as asked or few enough topics are left.

A word's weight depends on its sum over all topics alone, which no merge changes, and on the mean words of a topic. So the products
of two topics' sums, added up over the words of one such sum, are all that a round asks; words are read once, before the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import roots
from .neardup import best_neighbour
from .scratch import discard, durable


def class_weights(sums: DataFrame) -> DataFrame:
    """(topic, term, weight) of sums (topic, term, n): term share of a topic x ln(1 + mean words a topic / term's words)."""
    words = sums.groupBy("topic").agg(F.sum("n").alias("words"))
    mean = words.agg(F.avg("words").alias("mean_words"))
    total = sums.groupBy("term").agg(F.sum("n").alias("f"))
    w = sums.join(total, "term").join(words, "topic").crossJoin(mean)  # one row
    return w.select("topic", "term", (F.col("n") / F.col("words") * F.log(1 + F.col("mean_words") / F.col("f"))).alias("weight"))


#: So many topics at most have the products of all their pairs (a word of k topics has k (k + 1) / 2).
MANY = 500


def _products(now: DataFrame) -> DataFrame:
    """(f, a, b, s), a <= b: products of the sums of two topics over all words that occur ``f`` times in all."""
    words = now.groupBy("term").agg(F.sum("n").alias("f"), F.array_sort(F.collect_list(F.struct("topic", F.col("n").cast("double").alias("n")))).alias("t"))
    pair = lambda x: F.transform(F.filter("t", lambda y: y["topic"] >= x["topic"]), lambda y: F.struct(x["topic"].alias("a"), y["topic"].alias("b"), (x["n"] * y["n"]).alias("s")))
    each = words.where("f > 0").select("f", F.explode(F.flatten(F.transform("t", pair))).alias("p")).select("f", "p.*")
    return each.groupBy("f", "a", "b").agg(F.sum("s").alias("s"))


def _alike(products: DataFrame, mean_words: float, least_similarity: float) -> DataFrame:
    """(a, b, similarity), a < b: topics whose words, weighed at ``mean_words``, have a cosine of ``least_similarity`` or more."""
    weight = F.log(1 + F.lit(float(mean_words)) / F.col("f"))
    g = products.groupBy("a", "b").agg(F.sum(F.col("s") * weight * weight).alias("g"))
    size = g.where("a = b and g > 0").select(F.col("a").alias("k"), F.sqrt("g").alias("size"))
    both = g.where("a < b").join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
    return both.select("a", "b", F.round(F.col("g") / F.col("size_a") / F.col("size_b"), 9).alias("similarity")).where(F.col("similarity") >= least_similarity - 1e-9)


def _joined(products: DataFrame, into: DataFrame) -> DataFrame:
    """The products once topics have gone into others; a product of two that meet counts both ways."""
    moved = products
    for side in ("a", "b"):
        moved = moved.join(into.toDF(side, f"into_{side}"), side, "left").withColumn(f"now_{side}", F.coalesce(f"into_{side}", side))
    twice = F.when((F.col("a") != F.col("b")) & (F.col("now_a") == F.col("now_b")), 2.0).otherwise(1.0)
    moved = moved.select("f", F.least("now_a", "now_b").alias("a"), F.greatest("now_a", "now_b").alias("b"), (F.col("s") * twice).alias("s"))
    return moved.groupBy("f", "a", "b").agg(F.sum("s").alias("s"))


def reduced_topics(sums: DataFrame, least_similarity: float = 0.5, topics: int = 1, noise: int = -1) -> tuple[DataFrame, DataFrame]:
    """(labels, merges): labels (topic, reduced) of every topic, merges (round, a, b, similarity), b having gone into a.

    ``sums``: rows (topic, term, n), repeats add up; ``topics``: how many to stop at. A merged topic keeps the smaller number.
    Noise is left alone and has no weight; null topics and terms are left out; a topic without a similar one stays itself.
    """
    spark = sums.sparkSession
    now = durable(sums.where(F.col("topic").isNotNull() & F.col("term").isNotNull() & (F.col("topic") != noise)).groupBy("topic", "term").agg(F.sum("n").alias("n")), "topic-sums")
    all_topics = sums.where("topic is not null").select("topic").distinct()
    counted = now.agg(F.count_distinct("topic").alias("topics"), F.sum("n").alias("words")).first()
    left, done, r = counted["topics"], [], 0
    few = left <= MANY
    if few and left > max(1, topics):
        held = durable(_products(now), "topic-products")
        discard(now)
    while left > max(1, topics):
        if few:
            near = durable(_alike(held, counted["words"] / left, least_similarity), "near-topics")
        else:
            w = class_weights(now)
            size = w.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
            unit = durable(w.join(size, "topic").where("weight > 0").select(F.col("topic").alias("key"), "term", (F.col("weight") / F.col("size")).alias("weight")), "topic-weights")
            near = durable(best_neighbour(unit, least_similarity), "near-topics")
        each = near.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("o")), F.struct(F.col("b").alias("k"), F.col("a").alias("o")))).alias("e"), "similarity").select("e.*", "similarity")
        best = each.groupBy("k").agg(F.min_by("o", F.struct(-F.col("similarity"), "o")).alias("o"))
        mine, its = best.select(F.col("k").alias("a"), F.col("o").alias("b")), best.select(F.col("k").alias("b"), F.col("o").alias("back"))
        mutual = mine.join(its, "b").where("back = a and a < b").select("a", "b")
        pairs = near.join(mutual, ["a", "b"]).orderBy(F.desc("similarity"), "a").limit(left - max(1, topics))
        pairs = durable(pairs.select(F.lit(r).alias("round"), "a", "b", "similarity"), "topic-merges")
        merged = pairs.count()
        if not merged:
            break
        done.append(pairs)
        into = pairs.select(F.col("b").alias("topic"), F.col("a").alias("into"))
        if few:
            fresh = durable(_joined(held, into), "topic-products")
            discard(held)
            held = fresh
        else:
            fresh = durable(now.join(into, "topic", "left").groupBy(F.coalesce("into", "topic").alias("topic"), "term").agg(F.sum("n").alias("n")), "topic-sums")
            discard(now, unit)
            now = fresh
        left, r = left - merged, r + 1
    kind = sums.schema["topic"].dataType.simpleString()
    merges = spark.createDataFrame([], f"round int, a {kind}, b {kind}, similarity double")
    for d in done:
        merges = merges.unionByName(d)
    up = roots(merges.select(F.col("b").alias("node"), F.col("a").alias("up")))
    labels = all_topics.join(up, F.col("topic") == F.col("node"), "left").select("topic", F.coalesce("up", "topic").alias("reduced"))
    return labels, merges
