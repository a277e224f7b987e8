"""Aggregations of activity, markets and their panels; each is one declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import growth, ratio
from ..functions.time import sunday_label
from .windows import group_size


def weekly_domain_share(activity: DataFrame, domains: DataFrame, groups: list[str] = ("platform", "week"), topic: str = "topic", unit: str = "training_key", record: str = "record_key", noise: int = -1) -> DataFrame:
    """Shares of (domain x group) activity under three denominators.

    ``domains`` has rows (domain, topic), overlapping. Columns: count, eligible_records, topic_assigned_records,
    share_all, share_assigned, topic_coverage, share_unique (after one record a ``unit`` and group). A domain without
    records in a group has count 0. Totals are one aggregate over the groups; domains meet facts by topic, after facts
    are reduced to (group, topic, unit).
    """
    groups = list(groups)
    per_unit = activity.groupBy(*groups, topic, unit).agg(F.count(F.lit(1)).alias("n"))
    totals = per_unit.groupBy(*groups).agg(
        F.sum("n").alias("eligible_records"),
        F.sum(F.when(F.col(topic) != noise, F.col("n")).otherwise(0)).alias("topic_assigned_records"),
        F.count_distinct(unit).alias("units"),
    )
    inside = per_unit.join(domains.select("domain", F.col(topic).alias(topic)).distinct(), topic)
    # a record is in a domain once, however many of the domain's topics it has
    hits = inside.groupBy("domain", *groups).agg(F.sum("n").alias("count"), F.count_distinct(unit).alias("unit_count"))
    spine = totals.crossJoin(domains.select("domain").distinct())
    out = spine.join(hits, ["domain", *groups], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("count", "unit_count")})
    return out.select(
        "domain", *groups, "count", "eligible_records", "topic_assigned_records",
        ratio("count", "eligible_records").alias("share_all"), ratio("count", "topic_assigned_records").alias("share_assigned"),
        ratio("topic_assigned_records", "eligible_records").alias("topic_coverage"), ratio("unit_count", "units").alias("share_unique"),
    )


def weighted_share(df: DataFrame, groups: list[str], weight: str, inside: Column, out: str = "weighted_share") -> DataFrame:
    """Share of the weight that lies inside, a group."""
    return df.groupBy(*groups).agg(F.try_divide(F.sum(F.when(inside, F.col(weight)).otherwise(0.0)), F.nullif(F.sum(weight), F.lit(0.0))).alias(out))


def unit_or_self(unit: str, record: str) -> Column:
    """A blank unit is the record itself: unknown threads or authors are never pooled."""
    u = F.coalesce(F.trim(F.col(unit).cast("string")), F.lit(""))
    return F.when(u == "", F.concat(F.lit("record:"), F.col(record).cast("string"))).otherwise(u)


def inverse_multiplicity(df: DataFrame, groups: list[str], unit: str, record: str, out: str = "weight") -> DataFrame:
    """Each record weighs one over its unit's records in the group."""
    named = df.withColumn("_u", unit_or_self(unit, record))
    return named.withColumn(out, F.lit(1.0) / group_size(*groups, "_u")).drop("_u")


def concentration(df: DataFrame, groups: list[str], unit: str) -> DataFrame:
    """Herfindahl index and top share over known units, and how much of the group is known."""
    known = F.coalesce(F.trim(F.col(unit).cast("string")), F.lit("")) != ""
    per = df.withColumn("_k", known).groupBy(*groups, "_k", unit).agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy(*groups).agg(
        F.sum("n").alias("records"),
        F.sum(F.when(F.col("_k"), F.col("n"))).alias("known_records"),
        F.sum(F.when(F.col("_k"), F.col("n") * F.col("n")).cast("double")).alias("squares"),
        F.max(F.when(F.col("_k"), F.col("n"))).alias("top"),
        F.count_if("_k").alias("units"),
    )
    k = F.col("known_records").cast("double")
    return tot.select(*groups, "records", "units", F.try_divide(F.col("squares"), k * k).alias("herfindahl"), F.try_divide(F.col("top").cast("double"), k).alias("top_share"), (100.0 * ratio("known_records", "records")).alias("known_pct"))


def repeat_accounting(df: DataFrame, key: str, author: str) -> DataFrame:
    """For each repeated key: rows, known authors, and its extra rows as same-, cross- and unknown-author ones."""
    known = F.coalesce(F.trim(F.col(author).cast("string")), F.lit("")) != ""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(known, F.col(author))).alias("known_authors"), F.count_if(known).alias("known_rows")).where("n > 1")
    first = F.when(F.col("known_authors") > 0, F.lit(1)).otherwise(F.lit(0))
    return g.select(
        key, "n", "known_authors", (F.col("n") - 1).alias("extra_rows"),
        (F.col("known_rows") - F.col("known_authors")).alias("same_author_extra"), (F.col("known_authors") - first).alias("cross_author_extra"),
        (F.col("n") - F.col("known_rows") - 1 + first).alias("unknown_author_extra"),
    )


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, count, share of all)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1))))


def wide(df: DataFrame, rows: list[str], names: str, values: list[str], agg: Column) -> DataFrame:
    """Long to wide with guaranteed columns, zeros where nothing was."""
    p = df.groupBy(*rows).pivot(names, values).agg(agg)
    return p.na.fill(0, subset=[str(v) for v in values])


def joined_set(c: str, sep: str = "|") -> Column:
    """The sorted distinct values as one text; nulls are left out."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def mix_shares(df: DataFrame, groups: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and, for each flag, its count and share."""
    g = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    return g.select("*", *[ratio(k, "total").alias(f"{k}_share") for k in flags])


def conditional_sum(value: Column | str, flag: Column) -> Column:
    """Sum of the values whose flag holds; 0 if none."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(flag, v)), F.lit(0.0))


def market_weeks(sales: DataFrame, when: Column, value: str, segment: str, segments: tuple[str, str], size: str | None = None) -> DataFrame:
    """Weekly count, sum, mean and exact median of values, by segment and in all, weeks on Monday."""
    wk = F.date_trunc("week", when).cast("date")
    s = sales.where((F.col(value) > 0) & when.isNotNull()).withColumn("week", wk)
    a, b = (F.col(segment) == x for x in segments)
    cols = [F.count(F.lit(1)).alias("sales"), F.sum(value).alias("total_value"), F.avg(value).alias("mean_value"), F.median(value).alias("median_value"), F.count_if(a).alias("first_sales"), F.count_if(b).alias("second_sales"), F.median(F.when(a, F.col(value))).alias("first_median"), F.median(F.when(b, F.col(value))).alias("second_median")]
    if size:
        cols.append(F.median(F.try_divide(F.col(value), F.nullif(F.col(size), F.lit(0.0)))).alias("median_unit_price"))
    return s.groupBy("week").agg(*cols)


def aggregated_periods(sales: DataFrame, period: Column, value: str) -> DataFrame:
    """Coarser periods from records: sums add up, medians are taken anew and never from medians."""
    return sales.withColumn("period", period).groupBy("period").agg(F.count(F.lit(1)).alias("sales"), F.sum(value).alias("total_value"), F.median(value).alias("median_value"))


def sunday_weeks(df: DataFrame, keys: list[str], day: str, *aggs: Column) -> DataFrame:
    """Aggregates a key and week, labelled by the Sunday that ends it."""
    return df.withColumn("week_end", sunday_label(day)).groupBy(*keys, "week_end").agg(*aggs)


def growth_panel(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Change on the period before; a panel of periods, so its window has no key."""
    w = Window.orderBy(order)
    return df.select("*", *[growth(F.col(v), F.lag(v).over(w)).alias(f"{v}_growth") for v in values])


def activity_stats(df: DataFrame, key: str, period: str, top: int) -> DataFrame:
    """Periods seen, mean and deviation of a key's rows a period; the ``top`` by mean."""
    per = df.groupBy(key, period).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(key).agg(F.count(F.lit(1)).alias("periods"), F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("volatility"), F.sum("n").alias("total"))
    return g.orderBy(F.desc("mean_n"), key).limit(top)


def top_panel(df: DataFrame, key: str, period: str, top: int) -> DataFrame:
    """Period x key counts of the ``top`` keys by total, with their rank."""
    per = df.groupBy(key, period).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy(key).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), key).limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), key)))
    return per.join(ranked, key).select(key, period, "n", "total", "rank")


def compositions(df: DataFrame, dims: list[str]) -> DataFrame:
    """One count table for each of ``dims``, in one pass by grouping sets: (dimension, value, n)."""
    out = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    full = (1 << len(dims)) - 1
    which = F.coalesce(*[F.when(F.col("gid") == full ^ (1 << (len(dims) - 1 - i)), F.lit(d)) for i, d in enumerate(dims)])
    value = F.coalesce(*[F.when(F.col("gid") == full ^ (1 << (len(dims) - 1 - i)), F.col(d).cast("string")) for i, d in enumerate(dims)])
    return out.select(which.alias("dimension"), value.alias("value"), "n")


def winsorized(df: DataFrame, value: str, out: str, share: float = 0.99, keys: list[str] = ()) -> DataFrame:
    """``df`` with ``out``: values cut at a quantile of their keys, or of the whole table. Quantiles come from one aggregate and
    are joined back, so no task holds a key's rows; null keys are a key."""
    from .windows import spare

    names = [spare(df.columns, f"_k{i}") for i in range(len(keys))]
    most = spare(df.columns, "_most")
    q = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.percentile(value, share).alias(most))
    if keys:
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
        joined = df.join(q, same)
    else:
        joined = df.crossJoin(q)  # one row
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(value).isNotNull(), F.least(F.col(value), F.col(most))).alias(out))


def quantiles(df: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact, with linear interpolation."""
    g = df.groupBy(*groups).agg(F.percentile(value, at).alias("q"))
    return g.select(*groups, *[F.col("q")[i].alias(f"q{str(a).replace('.', '_')}") for i, a in enumerate(at)])


def missing_census(df: DataFrame) -> DataFrame:
    """(column_name, missing) for every column, in one aggregate."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing")) for c in df.columns])).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows are further copies of another."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a column."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(value).alias("max"))


def exclusion_waterfall(df: DataFrame, rules: list[tuple[str, Column]], kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``exclusion_reason`` and ``eligible``, flow): a row leaves at the first rule it meets.

    flow: (stage_order, stage, kind, removed, retained). One aggregate counts all stages; the running totals are over
    the rules, a few rows.
    """
    reason = F.lit("")
    for name, mask in reversed(rules):
        reason = F.when(F.coalesce(mask, F.lit(False)), F.lit(name)).otherwise(reason)
    flagged = df.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason") == "")
    counts = flagged.groupBy(kind).agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("exclusion_reason") == n).alias(f"r{i}") for i, (n, _) in enumerate(rules)])
    stages = F.array(*[F.struct(F.lit(i + 1).alias("stage_order"), F.lit(n).alias("stage"), F.col(f"r{i}").alias("removed")) for i, (n, _) in enumerate(rules)])
    flow = counts.select(kind, "_all", F.explode(stages).alias("s")).select(kind, "_all", "s.*")
    gone = F.sum("removed").over(Window.partitionBy(kind).orderBy("stage_order").rowsBetween(Window.unboundedPreceding, 0))
    return flagged, flow.select("stage_order", "stage", kind, "removed", (F.col("_all") - gone).alias("retained"))


def retention(stages: DataFrame, group: str = "platform") -> DataFrame:
    """(group, stage_order, stage, count) with the count before, what went, and percentages of it and of the first."""
    w = Window.partitionBy(group).orderBy("stage_order")
    prev, first = F.lag("count").over(w), F.first("count").over(w)
    return stages.select(
        group, "stage_order", "stage", "count", prev.alias("previous_count"), (prev - F.col("count")).alias("removed"),
        F.bround(100.0 * F.try_divide(F.col("count").cast("double"), prev.cast("double")), 2).alias("pct_of_previous"),
        F.bround(100.0 * F.try_divide(F.col("count").cast("double"), first.cast("double")), 2).alias("pct_of_raw"),
    )


def identity_violations(shares: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows where share_all is not share_assigned times coverage; empty when the panel is consistent."""
    gap = F.abs(F.col("share_all") - F.col("share_assigned") * F.col("topic_coverage"))
    return shares.where(gap > tolerance)


def domain_coverage(activity: DataFrame, domains: DataFrame, platform: str = "platform", topic: str = "topic") -> DataFrame:
    """Records and percentage of each domain by platform."""
    per = activity.groupBy(platform, topic).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(platform).agg(F.sum("n").alias("all_records"))
    inside = per.join(domains.select("domain", topic).distinct(), topic).groupBy("domain", platform).agg(F.sum("n").alias("records"))
    return inside.join(total, platform).select("domain", platform, "records", (100.0 * ratio("records", "all_records")).alias("pct"))


def overlap(activity: DataFrame, domains: DataFrame, topic: str = "topic") -> DataFrame:
    """How many records are in no, one, two, ... domains."""
    per_topic = domains.select("domain", topic).distinct().groupBy(topic).agg(F.count(F.lit(1)).alias("memberships"))
    per = activity.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    return per.join(per_topic, topic, "left").groupBy(F.coalesce("memberships", F.lit(0)).alias("memberships")).agg(F.sum("n").alias("records"))


def largest_unit(df: DataFrame, groups: list[str], unit: str) -> DataFrame:
    """Records, the largest unit's records and its share, a group."""
    per = df.groupBy(*groups, unit).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*groups).agg(F.sum("n").alias("records"), F.max("n").alias("largest"), F.try_divide(F.max("n").cast("double"), F.sum("n").cast("double")).alias("largest_share"))


def weekly_panel(df: DataFrame, groups: list[str], thread: str, author: str, flags: dict[str, Column]) -> DataFrame:
    """A group's records, distinct threads, distinct known authors, and for each flag its records and their share."""
    known = F.when(F.trim(F.coalesce(F.col(author).cast("string"), F.lit(""))) != "", F.col(author))
    hit = {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}
    g = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(thread).alias("threads"), F.count_distinct(known).alias("authors"),
        *[F.count_if(c).alias(n) for n, c in hit.items()],
    )
    return g.select("*", *[ratio(F.col(n), F.col("records")).alias(f"{n}_share") for n in hit])


def filled_bins(df: DataFrame, period: str, spine: DataFrame, *aggs: Column, zero: tuple[str, ...] = ()) -> DataFrame:
    """One row for each period of ``spine``, empty ones too: the ``zero`` columns are 0 there and the others null."""
    out = spine.join(df.groupBy(period).agg(*aggs), period, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def per_group_filter(groups: DataFrame, facts: DataFrame, key: str, low: str, high: str, at: str, *aggs: Column) -> DataFrame:
    """For each row of ``groups`` the aggregates of its own part of ``facts``: same ``key``, ``at`` from ``low`` to before ``high``.

    One equality join and one aggregate for all groups; a group without facts keeps its row."""
    inside = facts.join(groups.select(key, low, high).distinct(), key).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return groups.join(inside.groupBy(key, low, high).agg(*aggs), [key, low, high], "left")


def numeric_differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows (keys, column, left, right) where two tables of the same keys disagree: a key that one lacks (column null), or a number
    further apart than ``tolerance`` times the larger of 1 and its size. Empty when a stored table is what is recomputed."""
    numbers = [c for c, k in left.dtypes if c not in keys and k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    side = lambda df, n: df.select(*[F.col(k).alias(f"{k}_{n}") for k in keys], F.lit(True).alias(f"in_{n}"), *[F.col(c).cast("double").alias(f"{c}_{n}") for c in numbers])
    on = None
    for k in keys:
        same = F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))
        on = same if on is None else on & same
    both = side(left, "a").join(side(right, "b"), on, "full")
    here, there = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    apart = lambda c: ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) & F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) > tolerance * F.greatest(F.lit(1.0), F.abs(f"{c}_a"), F.abs(f"{c}_b")), F.lit(True))
    none = F.lit(None).cast("double")
    found = [F.when(here & there & apart(c), F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("left"), F.col(f"{c}_b").alias("right"))) for c in numbers]
    found.append(F.when(~(here & there), F.struct(F.lit(None).cast("string").alias("column"), F.when(here, F.lit(1.0)).otherwise(none).alias("left"), F.when(there, F.lit(1.0)).otherwise(none).alias("right"))))
    rows = both.select(*[F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in keys], F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d"))
    return rows.select(*keys, "d.column", "d.left", "d.right")
