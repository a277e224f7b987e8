"""Set operations and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overlap_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of either side, of both, and of one only; one shuffle of the keys."""
    tagged = a.select(F.col(key).alias("k"), F.lit(1).alias("side")).unionByName(b.select(F.col(key).alias("k"), F.lit(2).alias("side")))
    sides = tagged.groupBy("k").agg(F.bit_or("side").alias("s"))
    return sides.agg(F.count_if(F.col("s").isin(1, 3)).alias("a_size"), F.count_if(F.col("s").isin(2, 3)).alias("b_size"), F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"), F.count(F.lit(1)).alias("either"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of only one side, with the side; empty if both hold the same set."""
    x, y = a.distinct(), b.distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows by an order."""
    return df.orderBy(*order).limit(k)


def top_chunks(df: DataFrame, group: str, term: str, score: str, least: float, k: int, size: int, sep: str = " OR ") -> DataFrame:
    """The ``k`` best terms of a group above ``least``, in quoted chunks of ``size``: (group, chunk, query)."""
    w = Window.partitionBy(group).orderBy(F.desc(score), term)
    r = df.where(F.col(score) >= least).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    c = r.withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("_n", term)))
    return c.groupBy(group, "chunk").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), x[term], F.lit('"'))), sep).alias("query"))
