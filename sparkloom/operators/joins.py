"""Joins with the guarantees that pandas users check by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import spare


class KeyViolation(ValueError):
    """A key that must be unique, or present, is not."""


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with their counts; empty if ``keys`` is a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def expect_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df``, or an error that names keys that repeat."""
    bad = duplicated_keys(df, keys).limit(3).collect()
    if bad:
        raise KeyViolation(f"Duplicate {'/'.join(keys)} in {what}: {[tuple(r) for r in bad]}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """A join of two tables whose keys are checked to be unique; other names in common get the suffixes."""
    expect_unique(left, keys, "left"), expect_unique(right, keys, "right")
    return suffixed_join(left, right, keys, suffixes, how)


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """A join in which columns of both sides get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, keys, how)


def keep_last(dim: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key, the last by ``order``: what a dictionary built row by row would hold."""
    return dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def lookup(df: DataFrame, on: Column, tables: list[tuple[DataFrame, str, str]], out: str, default: str | None = None) -> DataFrame:
    """``out``: the value in the first table that has the key, else ``default``. Tables: (rows, key, value), keys unique."""
    joined = df
    found = []
    for i, (table, key, value) in enumerate(tables):
        k, v = spare(df.columns, f"_k{i}"), spare(df.columns, f"_v{i}")
        joined = joined.join(table.select(F.col(key).alias(k), F.col(value).alias(v)), on == F.col(k), "left")
        found.append(F.col(v))
    return joined.select(*df.columns, F.coalesce(*found, F.lit(default)).alias(out))


def parent_text(replies: DataFrame, posts: DataFrame, comments: DataFrame, parent: str, ident: str = "id", text: str = "text", out: str = "parent_text", blank: str = r"^\s*\[(?:deleted|removed)\]\s*$") -> DataFrame:
    """The text of a reply's typed parent (``t3_`` posts, ``t1_`` comments), deletion markers and strangers blank."""
    typed = posts.select(F.concat(F.lit("t3_"), F.col(ident)).alias("_pid"), F.col(text).alias("_ptext")).unionByName(comments.select(F.concat(F.lit("t1_"), F.col(ident)).alias("_pid"), F.col(text).alias("_ptext")))
    typed = typed.groupBy("_pid").agg(F.max("_ptext").alias("_ptext"))
    joined = replies.join(typed, F.col(parent) == F.col("_pid"), "left")
    t = F.coalesce("_ptext", F.lit(""))
    return joined.select(*replies.columns, F.when(t.rlike(f"(?i){blank}"), F.lit("")).otherwise(t).alias(out))


def same_thread_parent(df: DataFrame, ident: str, parent: str, thread: str, text: str, out: str = "immediate_parent") -> DataFrame:
    """The parent's text where the parent is another row of the same thread, else blank."""
    p = df.select(F.col(ident).alias("_pid"), F.col(thread).alias("_pt"), F.col(text).alias("_ptext"))
    joined = df.join(p, (F.col(parent) == F.col("_pid")) & (F.col(thread) == F.col("_pt")) & (F.col(ident) != F.col("_pid")), "left")
    return joined.select(*df.columns, F.coalesce("_ptext", F.lit("")).alias(out))


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``keys``."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``keys``; null keys stay."""
    return df.join(keys, on, "left_anti")


def provenance(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("regex", "semantic"), out: str = "source_label") -> DataFrame:
    """Each key of either table, labelled ``both`` or with the only table that has it."""
    one = a.select(key).distinct().withColumn("_a", F.lit(True))
    two = b.select(key).distinct().withColumn("_b", F.lit(True))
    both = one.join(two, key, "full")
    return both.select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), f"{names[0]}_only").otherwise(f"{names[1]}_only").alias(out))


def waterfall_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, steps: list[tuple[str, list[str]]], fallback: DataFrame | None = None) -> DataFrame:
    """Rows (left_id, right_id, match_method): each left row takes the first step that gives exactly one candidate.

    Steps are (name, columns). Keys shared by several right rows are no match at that step; counting is a grouped
    aggregate on the right, so no step multiplies rows.
    """
    out = left
    for i, (_, cols) in enumerate(steps):
        cand = right.dropna(subset=cols).groupBy(*[F.col(c).alias(f"_{i}{c}") for c in cols]).agg(F.count(F.lit(1)).alias(f"_n{i}"), F.min(right_id).alias(f"_r{i}"))
        cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{i}{c}") for c in cols])
        out = out.join(cand.where(f"_n{i} = 1"), cond, "left")
    pick = F.coalesce(*[F.col(f"_r{i}") for i in range(len(steps))])
    how = F.coalesce(*[F.when(F.col(f"_r{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(steps)], F.lit("unmatched"))
    return out.select(F.col(left_id), pick.alias(right_id), how.alias("match_method"))


def unambiguous(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join after dropping every row of a key that the left table repeats."""
    n = spare(left.columns, "_n")
    return left.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col(n) == 1).drop(n).join(right, keys)


def spine_join(spine: DataFrame, df: DataFrame, keys: list[str], zeros: list[str] = ()) -> DataFrame:
    """Every row of ``spine``; counts in ``zeros`` are 0 where nothing was observed, other columns null."""
    out = spine.join(df, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros}) if zeros else out


def product_spine(*dims: DataFrame) -> DataFrame:
    """The product of small dimensions, such as weeks by platforms by themes; not for fact tables."""
    return reduce(lambda a, b: a.crossJoin(b), dims)


def members(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Overlapping membership: one row for each group of ``dim`` (exploded, small) that a fact's key is in."""
    return fact.join(dim, key)
