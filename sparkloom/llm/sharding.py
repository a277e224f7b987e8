"""Sharding by weighted rendezvous hashing.

Every shard draws a score for a record's key alone, -weight / ln(u), and the largest wins; adding a shard adds one
draw, so records move only to the new shard, in proportion to its weight. All JVM expressions, no shuffle to place.
Slots number each shard's rows from 0 in two steps (rows within a bucket of the shard, buckets by a running total), so
no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, free_name, table


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard of ``key``: 0 to len(weights) - 1; ties go to the smaller shard. A null key counts as an empty text."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = []
    for s, w in enumerate(weights):
        h = F.xxhash64(text, F.lit(s), F.lit(seed))
        u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(-s).alias("back")))
    return (-F.array_max(F.array(*draws))["back"]).cast("int") if len(draws) > 1 else F.lit(0)


def slots(df: DataFrame, shard: str, row: str, name: str = "slot", rows_per_bucket: int = 50_000, total: int | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 within each shard, by buckets of a hash of ``row``, which is another for each row, so that
    no repeated id or text fills a bucket."""
    total = df.count() if total is None else total
    buckets = max(1, -(-total // rows_per_bucket)) * 4
    bucket, n, base_, s_, b_, r_ = (free_name(df.columns, c) for c in ("bucket_", "n_", "base_", "s_", "b_", "r_"))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col(shard).alias(s_), F.col(bucket).alias(b_), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base_))
    inside = Window.partitionBy(shard, bucket).orderBy(row)
    ranked = dealt.withColumn(r_, F.row_number().over(inside) - 1)
    out = ranked.join(base, (F.col(shard) == F.col(s_)) & (F.col(bucket) == F.col(b_)), "left")
    return out.select(*df.columns, (F.col(base_) + F.col(r_)).cast("long").alias(name))


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of ``docs``.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and the crc32 of nothing. Repeated rows share a
    shard and take a slot each; null ids share one shard, as the law asks, but no task; other columns are not read; an empty
    table gives no rows. Documents are read once: what is placed is written, a few dozen bytes a row, and numbered from there.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights, seed).alias("shard"),
        rendezvous(F.col(id_col), [*weights, grown_weight], seed).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    numbered = slots(durable(placed, "shards"), "shard", "row")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen equal shards."""
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16)
