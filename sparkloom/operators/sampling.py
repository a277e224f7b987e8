"""Reproducible samples: rows are ordered by a seeded hash of their key, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from .windows import spare


def draw(key: str, seed: int | str) -> Column:
    """A hash that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, in hash order."""
    return df.orderBy(draw(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in hash order."""
    return df.orderBy(draw(key, seed), key)


def per_group(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` a group."""
    w = Window.partitionBy(*groups).orderBy(draw(key, seed), key)
    place = spare(df.columns, "_n")
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).drop(place)


def allocate(sizes: dict, n: int) -> dict:
    """Proportional by ceiling, at least one, then the largest give way until the sum is ``n``."""
    total = sum(sizes.values())
    got = {k: min(s, max(1, math.ceil(n * s / total))) for k, s in sizes.items()}
    while sum(got.values()) > max(n, len(got)):
        top = max(got, key=lambda k: (got[k], str(k)))
        got[top] -= 1
    return got


def proportional(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A stratified sample of ``n``: strata are counted (a row each), rows numbered within them."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return df
    own, quota, place = (spare(df.columns, c) for c in ("_s", "_quota", "_n"))
    table = df.sparkSession.createDataFrame([(k, v) for k, v in allocate(sizes, n).items()], f"`{own}` {df.schema[stratum].dataType.simpleString()}, `{quota}` int")
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    ranked = df.withColumn(place, F.row_number().over(w)).join(table, F.col(stratum).eqNullSafe(F.col(own)))
    return ranked.where(F.col(place) <= F.col(quota)).select(*df.columns)


def rounded_by_label(df: DataFrame, label: str, key: str, n: int, cap: int, seed: int = 42) -> DataFrame:
    """Round(n x share), at least one and at most ``cap`` a label."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    quota = per.withColumn("_quota", F.least(F.lit(cap), F.greatest(F.lit(1), F.bround(n * F.col("_c") / F.sum("_c").over(Window.partitionBy(F.lit(1))), 0).cast("int")))).select(F.col(label).alias("_l"), "_quota")
    w = Window.partitionBy(label).orderBy(draw(key, seed), key)
    own, most, place = (spare(df.columns, c) for c in ("_l", "_quota", "_n"))
    quota = quota.select(F.col("_l").alias(own), F.col("_quota").alias(most))
    return df.withColumn(place, F.row_number().over(w)).join(quota, F.col(label).eqNullSafe(F.col(own))).where(F.col(place) <= F.col(most)).select(*df.columns)


def unique_quota(df: DataFrame, stratum: str, key: str, unique: list[str], quota: int, seed: int = 42, slack: int = 50) -> DataFrame:
    """``quota`` rows a stratum, smallest stratum first, no value of ``unique`` twice in the whole sample.

    Sequential by nature, so it runs on the driver over the first candidates of each stratum in hash order; if they run
    out it asks for more, until the stratum has been seen whole. Raises if a stratum cannot be filled.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count(F.lit(1))).collect()}
    want = min(max(sizes.values(), default=0), quota * slack)
    while True:
        cand = per_group(df.select(stratum, key, *unique), [stratum], key, want, seed).withColumn("_d", draw(key, seed)).orderBy("_d", key).collect()
        seen, picked, short = [set() for _ in unique], [], None
        for s in sorted(sizes, key=lambda k: (sizes[k], str(k))):
            n = 0
            for r in (r for r in cand if r[stratum] == s):
                if n < quota and all(r[u] not in v for u, v in zip(unique, seen, strict=True)):
                    n += 1
                    picked.append((r[key],))
                    for u, v in zip(unique, seen, strict=True):
                        v.add(r[u])
            if n < quota:
                short = s
                break
        if short is None:
            break
        if want >= sizes[short]:
            raise ValueError(f"stratum {short!r} cannot give {quota} rows with unique {unique}")
        want *= 4
    keys = df.sparkSession.createDataFrame(picked, f"{key} {df.schema[key].dataType.simpleString()}")
    return df.join(keys, key, "left_semi")


def split(df: DataFrame, stratum: str, key: str, first: int, names: tuple[str, str] = ("calibration", "holdout"), seed: int = 42) -> DataFrame:
    """The first rows of each stratum in hash order under one name, the rest under the other."""
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    return df.withColumn("split", F.when(F.row_number().over(w) <= first, names[0]).otherwise(names[1]))


def public_ids(df: DataFrame, order: list[Column | str], pattern: str = "CTX-%03d", out: str = "review_id") -> DataFrame:
    """Numbers rows in the given order. A number, date or time in front orders any number of rows without one window; other
    orders are for samples."""
    from .windows import row_index

    cols = [spare(df.columns, f"_o{i}") for i in range(len(order))]
    held = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(c) for o, c in zip(order, cols, strict=True)])
    place = spare([*df.columns, *cols], "_place")
    if isinstance(held.schema[cols[0]].dataType, NumericType | DateType | TimestampType | TimestampNTZType):
        placed = row_index(held, cols, place).withColumn(place, F.col(place) + 1)
    else:
        placed = held.withColumn(place, F.row_number().over(Window.orderBy(*cols)))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], F.format_string(pattern, F.col(place)).alias(out))


def packets(df: DataFrame, key: str, annotators: list[str], blinded: list[str]) -> dict[str, DataFrame]:
    """Each annotator's rows in an order of their own, with the blinded columns only."""
    return {a: df.orderBy(draw(key, a), key).select(*blinded) for a in annotators}
