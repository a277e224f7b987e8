"""Repeat policies: which of several like rows stays, and what is only flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import best, group_distinct, group_size, repeated, spare


def best_engagement(df: DataFrame, ident: str, score: str, tie: str | None = None) -> DataFrame:
    """One row an id: the highest score, ties to the smallest ``tie``."""
    return best(df, [ident], F.desc_nulls_last(score), F.asc(tie or ident))


def by_id_then_text(df: DataFrame, ident: str, text_key: str, score: str) -> DataFrame:
    """Best row an id, then best row a text; blank texts are not copies of each other."""
    one = best_engagement(df, ident, score)
    k = spare(df.columns, "_k")
    named = one.withColumn(k, F.when(F.coalesce(F.col(text_key), F.lit("")) == "", F.concat(F.lit("id:"), F.col(ident).cast("string"))).otherwise(F.concat(F.lit("t:"), F.col(text_key))))
    return best(named, [k], F.desc_nulls_last(score), F.asc(ident)).drop(k)


def merge_streams(df: DataFrame, ident: str, score: str, stream: str, provenance: str, names: tuple[str, str] = ("regex", "semantic")) -> DataFrame:
    """One row an id: its best row's columns, where it came from, and all provenance strings in order."""
    rest = [c for c in df.columns if c not in (ident, stream, provenance)]
    g = df.groupBy(ident).agg(F.max_by(F.struct(*rest), F.struct(F.col(score).cast("double"), F.col(stream))).alias("_r"), F.collect_set(stream).alias("_s"), F.array_join(F.array_sort(F.collect_set(provenance)), "|").alias(provenance))
    label = F.when(F.array_contains("_s", names[0]) & F.array_contains("_s", names[1]), "both").when(F.array_contains("_s", names[0]), names[0]).otherwise(names[1])
    return g.select(ident, *[F.col("_r")[c].alias(c) for c in rest], label.alias("source_label"), provenance)


def families(df: DataFrame, family: str, time: str, record: str) -> DataFrame:
    """``family_size`` and ``representative``: the first of each family by time and key."""
    return df.withColumns({"family_size": group_size(family), "representative": ~repeated([family], time, record)})


def same_author_repeat(df: DataFrame, author: str, family: str, time: str, record: str, keys: list[str] = ()) -> DataFrame:
    """True for all but a known author's first posting of a text."""
    known = F.coalesce(F.trim(F.col(author).cast("string")), F.lit("")) != ""
    unit = F.when(known, F.concat(F.lit("a:"), F.col(author))).otherwise(F.concat(F.lit("r:"), F.col(record).cast("string")))
    u = spare(df.columns, "_u")
    return df.withColumn(u, unit).withColumn("is_same_author_exact_text_repeat", repeated([*keys, u, family], time, record)).drop(u)


def cross_author_flag(df: DataFrame, author: str, family: str) -> DataFrame:
    """True where more than one known author posted a row's text."""
    return df.withColumn("is_cross_author_duplicate", group_distinct(author, family) > 1)


def duplicate_groups(df: DataFrame, key: str, distinct: dict[str, str], example: str, order: str, least: int = 2) -> DataFrame:
    """For each repeated key: rows, distinct values of columns, and its first row's text."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()], F.min_by(example, order).alias("example")).where(F.col("rows") >= least)


def registrations(df: DataFrame, ident: str, substantive: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row an id, conflicts): full copies go, then rows of an id whose substantive columns agree become the first.

    Ancillary columns may differ; ids whose substantive columns disagree are all in ``conflicts``.
    """
    rows = df.dropDuplicates()
    kinds = F.size(F.collect_set(F.to_json(F.struct(*substantive), {"ignoreNullFields": "false"})))
    bad = rows.groupBy(ident).agg(kinds.alias("kinds")).where("kinds > 1")
    good = rows.join(bad, ident, "left_anti")
    return best(good, [ident], *order), bad


def removal_flag(moderator: Column, extra_contact: Column, same_author: Column) -> Column:
    """What is removed. Near-duplicates are flagged elsewhere and stay."""
    return F.coalesce(moderator, F.lit(False)) | F.coalesce(extra_contact, F.lit(False)) | F.coalesce(same_author, F.lit(False))
