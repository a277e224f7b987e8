"""Calendar functions. Weeks start on Monday in a zone the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

SNOWFLAKE_EPOCH_MS = 1288834974657


def week_start(ts: Column | str, zone: str = "UTC") -> Column:
    """The Monday of the week, in ``zone``."""
    local = col(ts) if zone == "UTC" else F.from_utc_timestamp(col(ts), zone)
    return F.date_trunc("week", local).cast("date")


def sunday_label(d: Column | str) -> Column:
    """The Sunday that ends a date's week: the label of a weekly grouper."""
    return F.next_day(F.date_sub(col(d).cast("date"), 1), "SUN")


def fortnight(week: Column | str, first: str) -> Column:
    """Number of the fortnight since ``first``, from 0."""
    return F.floor(F.datediff(col(week), F.lit(first).cast("date")) / 14).cast("int")


def snowflake_time(ident: Column | str) -> Column:
    """The time that a snowflake id carries."""
    return F.timestamp_millis(F.shiftright(col(ident).cast("long"), 22) + F.lit(SNOWFLAKE_EPOCH_MS))


def date_parts(d: Column | str) -> dict[str, Column]:
    """Year, month, quarter, ISO week and labels of a date, by name."""
    c = col(d)
    return {
        "year": F.year(c), "month": F.month(c), "quarter": F.quarter(c), "iso_week": F.weekofyear(c),
        "month_label": F.date_format(c, "yyyy-MM"), "iso_year_week": F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c)),
    }


def parse_times(df: DataFrame, name: str, out: str, share: float = 0.8) -> DataFrame:
    """Epoch seconds if over ``share`` of the values are numbers (one aggregate decides), else date text; failures are null."""
    n, total = df.agg(F.count(F.expr(f"try_cast(`{name}` as double)")), F.count(name)).first()
    if total and n > share * total:
        return df.withColumn(out, F.timestamp_seconds(F.expr(f"try_cast(`{name}` as double)")))
    return df.withColumn(out, F.expr(f"try_to_timestamp(cast(`{name}` as string))"))


def in_window(ts: Column | str, start: str, end: str) -> Column:
    """Half open; a plain range on the raw column, so that it reaches the scan. Nulls are out."""
    c = col(ts)
    return c.isNotNull() & (c >= F.lit(start).cast("timestamp")) & (c < F.lit(end).cast("timestamp"))


def calendar(spark, first: str, last: str, name: str = "week") -> DataFrame:
    """One row a week from ``first`` to ``last``, both Mondays."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 7 days"))).alias(name))
