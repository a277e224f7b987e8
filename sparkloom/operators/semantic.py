"""Operators over embedding columns and term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, norm, unit
from ..functions.text import text_key

#: A reference list larger than this many vectors is no broadcast any more.
MAX_REFERENCES = 10_000


def reference_similarity(df: DataFrame, vec: str, refs: DataFrame, ref_vec: str, ref_id: str, out: str = "sim", top: int = 2) -> DataFrame:
    """Best cosine to a short list of references, which one, and the mean of the best ``top``.

    The references travel as one array literal column (checked size), so every row is scored in place: no product of
    tables, no shuffle of vectors.
    """
    rows = refs.select(F.col(ref_id).cast("string").alias("i"), unit(ref_vec).alias("v")).limit(MAX_REFERENCES + 1).collect()
    if len(rows) > MAX_REFERENCES:
        raise ValueError("too many references to score in place")
    packed = df.sparkSession.createDataFrame([([(r.i, list(r.v)) for r in sorted(rows, key=lambda r: r.i)],)], "refs array<struct<i:string,v:array<double>>>")
    u = unit(vec)
    scored = df.crossJoin(F.broadcast(packed)).withColumn("_u", u).withColumn("_s", F.transform("refs", lambda r: F.struct(dot(F.col("_u"), r["v"]).alias("s"), r["i"].alias("i"))))
    ranked = F.array_sort(F.col("_s"), lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    scored = scored.withColumn("_s", ranked)
    best = F.slice("_s", 1, top)
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x["s"]) / F.nullif(F.size(best), F.lit(0))
    return scored.select(*df.columns, F.get("_s", F.lit(0))["s"].alias(f"{out}_max"), F.get("_s", F.lit(0))["i"].alias(f"{out}_best"), mean.alias(f"{out}_top_mean"))


def contrastive_filter(df: DataFrame, vec: str, positive: DataFrame, negative: DataFrame, ref_vec: str, ref_id: str, least: float = 0.50, margin: float = 0.06) -> DataFrame:
    """Near enough to a positive reference, and nearer than to any negative one by the margin: column ``keep``."""
    a = reference_similarity(df, vec, positive, ref_vec, ref_id, "pos")
    b = reference_similarity(a, vec, negative, ref_vec, ref_id, "neg")
    return b.withColumn("margin", F.col("pos_max") - F.col("neg_max")).withColumn("keep", (F.col("pos_max") >= least) & (F.col("margin") >= margin))


def cached_embeddings(texts: DataFrame, cache: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(texts with their cached vector or null, the distinct texts that are missing)."""
    joined = texts.join(cache.select(key, vec), key, "left")
    return joined, joined.where(F.col(vec).isNull()).select(key).distinct()


def norm_violations(df: DataFrame, vec: str, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose vector is missing, not finite or not of length 1."""
    n = norm(vec)
    return df.where(F.col(vec).isNull() | F.isnan(n) | (F.abs(n - 1) > tolerance))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, centroid): means by position, put back in order."""
    pos = df.select(group, F.posexplode(vec).alias("p", "x")).groupBy(group, "p").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("c"))
    return pos.groupBy(group).agg(F.max("c").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("centroid"))


def cohesion(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean and median cosine of members to their group's normalized centroid."""
    c = centroids(df, group, vec).select(group, "n", unit("centroid").alias("_c"))
    return df.join(c, group).withColumn("_s", dot(unit(vec), F.col("_c"))).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_cosine"), F.median("_s").alias("median_cosine"))


def terms(df: DataFrame, doc: str, text: str, grams: int = 1, stop: list[str] = ()) -> DataFrame:
    """(doc, term, tf): words of the text key (stop words out), then runs of up to ``grams``."""
    words = F.filter(F.split(text_key(text), " "), lambda w: (F.char_length(w) > 1) & ~w.isin(*stop)) if stop else F.filter(F.split(text_key(text), " "), lambda w: F.char_length(w) > 1)
    d = df.select(doc, words.alias("w"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = [F.col("w"), *[of_length(n) for n in range(2, grams + 1)]]
    return d.select(doc, F.explode(F.concat(*runs) if len(runs) > 1 else runs[0]).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(tf: DataFrame, doc: str, documents: int, min_df: int = 1, max_share: float = 1.0, max_terms: int | None = None) -> DataFrame:
    """(doc, term, weight): smoothed inverse document frequency, rows of length 1. No window spans a term.

    ``max_terms`` keeps the terms that occur most often in all, ties by term: a vocabulary limit, part of the measure.
    """
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * documents))
    if max_terms is not None:
        df_ = df_.orderBy(F.desc("total"), "term").limit(max_terms)
    df_ = df_.drop("total")
    raw = tf.join(df_, "term").withColumn("_w", F.col("tf") * (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0))
    size = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(size, doc).select(doc, "term", (F.col("_w") / F.col("_n")).alias("weight"))


def tfidf_within(tf: DataFrame, by: str, doc: str, sizes: DataFrame, min_df: int = 1, max_terms: int | None = None, buckets: int = 64) -> DataFrame:
    """(by, doc, term, weight): ``tfidf`` with vocabulary and document frequencies of each group's own; ``sizes`` is (by, documents).

    The vocabulary limit is found among the leading terms of hash buckets, so no window holds a group's whole vocabulary."""
    df_ = tf.groupBy(by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_terms is not None:
        order = (F.desc("total"), "term")
        df_ = df_.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        df_ = df_.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))).where(F.col("_r") <= max_terms)
        df_ = df_.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= max_terms)
    df_ = df_.join(sizes, by).select(by, "term", "df", "documents")
    raw = tf.join(df_, [by, "term"]).withColumn("_w", F.col("tf") * (F.log((1.0 + F.col("documents")) / (1.0 + F.col("df"))) + 1.0))
    size = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(size, doc).select(by, doc, "term", (F.col("_w") / F.col("_n")).alias("weight"))


def mean_tfidf(weights: DataFrame, documents: int, top: int) -> DataFrame:
    """The terms of the largest mean weight over all documents."""
    return weights.groupBy("term").agg((F.sum("weight") / documents).alias("mean_weight")).orderBy(F.desc("mean_weight"), "term").limit(top)


def class_tfidf(tf: DataFrame, group: str, top: int = 10, min_df: int = 1) -> DataFrame:
    """(group, term, weight, rank): term share of a group x ln(1 + mean words a group / term's words), the best ``top``."""
    per = tf.groupBy(group, "term").agg(F.sum("tf").alias("n"))
    words = per.groupBy(group).agg(F.sum("n").alias("words"))
    mean = words.agg(F.avg("words").alias("mean_words"))
    total = per.groupBy("term").agg(F.sum("n").alias("f")).where(F.col("f") >= min_df)
    w = per.join(total, "term").join(words, group).crossJoin(mean)  # one row
    w = w.withColumn("weight", F.col("n") / F.col("words") * F.log(1 + F.col("mean_words") / F.col("f")))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= top).select(group, "term", "weight", "rank")


def topic_table(df: DataFrame, topic: str, keywords: DataFrame | None = None) -> DataFrame:
    """Rows a topic, with its keywords in order where they are given."""
    n = df.groupBy(topic).agg(F.count(F.lit(1)).alias("count"))
    if keywords is None:
        return n
    k = keywords.groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))
    return n.join(k, topic, "left")


def inherit_topic(rows: DataFrame, trained: DataFrame, key: str, topic: str, noise: int = -1) -> DataFrame:
    """Every row takes its training text's topic; a text that was not trained is noise."""
    return rows.join(trained.select(key, topic), key, "left").withColumn(topic, F.coalesce(F.col(topic), F.lit(noise)))


def topic_diversity(keywords: DataFrame) -> DataFrame:
    """Share of the topics' keywords that are distinct."""
    return keywords.agg((F.count_distinct("term") / F.count("term")).alias("diversity"))


def review_packet(df: DataFrame, topic: str, key: str, strength: Column | str, representative: int = 3, random: int = 5, seed: int = 42) -> DataFrame:
    """The strongest rows of each topic, then others drawn by hash: column ``part``."""
    from .sampling import draw

    s = F.col(strength) if isinstance(strength, str) else strength
    w = Window.partitionBy(topic).orderBy(s.desc_nulls_last(), key)
    first = df.withColumn("_n", F.row_number().over(w)).withColumn("part", F.when(F.col("_n") <= representative, "representative").otherwise("random"))
    w2 = Window.partitionBy(topic, "part").orderBy(draw(key, seed), key)
    return first.withColumn("_m", F.row_number().over(w2)).where((F.col("part") == "representative") | (F.col("_m") <= random)).drop("_n", "_m")


def mapping_problems(mapping: DataFrame, groups: DataFrame, group: str, theme: str, noise: int = -1) -> DataFrame:
    """What forbids using a reviewed group-to-theme map: unknown groups, mapped noise, missing themes."""
    known = groups.select(group).distinct().withColumn("_known", F.lit(True))
    j = mapping.join(known, group, "left")
    why = F.when(F.col(group) == noise, "noise is mapped").when(F.col("_known").isNull(), "unknown group").when(F.coalesce(F.trim(theme), F.lit("")) == "", "no theme")
    return j.select(group, theme, why.alias("problem")).where("problem is not null")


def dtm_terms(df: DataFrame, doc: str, text: str, stop: list[str], anchors: list[str] = ()) -> DataFrame:
    """(doc, term, tf) of lower-case letter words without stop words, unless they are anchors."""
    drop = [w for w in stop if w not in set(anchors)]
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*drop)) if drop else words
    return df.select(doc, F.explode(kept).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def truncation_audit(df: DataFrame, text: str, limit: int = 256) -> DataFrame:
    """How many texts an encoder of ``limit`` tokens would cut, by white-space words as a lower bound of tokens."""
    n = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " "))
    d = df.select(n.alias("n"))
    q = F.percentile("n", [0.5, 0.9, 0.95, 0.99])
    return d.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > limit).alias("cut"), *[q[i].alias(f"p{k}") for i, k in enumerate((50, 90, 95, 99))], F.max("n").alias("longest"))


def alignment_problems(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Keys with a row and no vector, a vector and no row, or either more than once: (key, problem)."""
    a = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    why = F.when(F.col("_a").isNull(), "vector without row").when(F.col("_b").isNull(), "row without vector").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated")
    return a.join(b, key, "full").select(key, why.alias("problem")).where("problem is not null")
