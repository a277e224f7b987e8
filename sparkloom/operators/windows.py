"""Window columns. Each takes names and returns an expression; ties are broken by a key the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import durable

#: Ranges into which ``row_index`` deals rows at most.
RANGES = 1000


def spare(columns: list[str], base: str) -> str:
    """``base``, with underscores behind it until no column has that name: for helper columns beside a caller's own."""
    have = {c.lower() for c in columns}
    while base.lower() in have:
        base += "_"
    return base


def group_size(*keys: str) -> Column:
    """Rows of the key."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys))


def group_distinct(value: str, *keys: str) -> Column:
    """Distinct values of the key; nulls are left out."""
    return F.size(F.collect_set(value).over(Window.partitionBy(*keys)))


def nth(keys: list[str], *order: Column | str) -> Column:
    """A row's number within its key, from 1."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def repeated(keys: list[str], *order: Column | str) -> Column:
    """True for all but the first of a key."""
    return nth(keys, *order) > 1


def ambiguous(*keys: str) -> Column:
    """True where the key repeats."""
    return group_size(*keys) > 1


def best(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    n = spare(df.columns, "_n")
    return df.withColumn(n, nth(keys, *order)).where(F.col(n) == 1).drop(n)


def first_in(value: str, keys: list[str], *order: Column | str) -> Column:
    """The key's first value by an order."""
    return F.first(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def previous(value: str, keys: list[str], *order: str, by: int = 1) -> Column:
    """The value ``by`` rows before."""
    return F.lag(value, by).over(Window.partitionBy(*keys).orderBy(*order))


def following(value: str, keys: list[str], *order: str, by: int = 1) -> Column:
    """The value ``by`` rows after."""
    return F.lead(value, by).over(Window.partitionBy(*keys).orderBy(*order))


def change(value: str, keys: list[str], *order: str) -> Column:
    """The value less that of the row before."""
    return F.col(value) - previous(value, keys, *order)


def rolling_mean(value: str, keys: list[str], *order: str, rows: int = 12) -> Column:
    """Over the last ``rows`` rows, this one included; fewer at the start."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0))


def trailing_mean(value: str, keys: list[str], *order: str, rows: int = 4) -> Column:
    """Over the ``rows`` rows before this one; null until there are so many."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def surge(value: str, keys: list[str], *order: str, rows: int = 4) -> Column:
    """The value over the mean of the rows before it."""
    return F.try_divide(F.col(value).cast("double"), F.nullif(trailing_mean(value, keys, *order, rows=rows), F.lit(0.0)))


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks from 1, ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def z_score(value: str, keys: list[str]) -> Column:
    """Distance from the key's mean in deviations."""
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def row_index(df: DataFrame, order: list[str], out: str = "source_row", chunk_rows: int = 200_000) -> DataFrame:
    """A gapless index from 0 in the total order of ``order``.

    Rows are dealt to ranges of all of ``order``, so equal leading values spread too, sorted there and written once with their
    place; only the ranges' sizes, a row each, meet in one place. A range is about ``chunk_rows`` rows, more beyond ``RANGES`` of them.
    """
    n = min(RANGES, max(1, -(-df.count() // chunk_rows)))
    p, r, b = (spare([*df.columns, out], c) for c in ("_p", "_r", "_b"))
    place = F.monotonically_increasing_id()  # the partition, then 33 bits for the row in it
    ranked = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(r, place)
    ranked = durable(ranked, "row-index").withColumn(p, F.shiftright(r, 33))
    before = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    base = ranked.groupBy(p).agg(F.count(F.lit(1)).alias("n")).select(p, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(b))
    return ranked.join(F.broadcast(base), p).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(b) + F.col(r).bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(out))
