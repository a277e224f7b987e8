"""Statistics of weekly panels and label tables. Panels are long: (group columns, order, value columns)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation
from .windows import average_rank, row_index


def unpivot_specs(panel: DataFrame, keys: list[str], specs: list[str]) -> DataFrame:
    """A panel's specifications as rows (keys, spec, x)."""
    return panel.unpivot([F.col(k) for k in keys], [F.col(s) for s in specs], "spec", "x")


def lagged(x: DataFrame, y: DataFrame, groups: list[str], order: str, lags: list[int], value: str = "y") -> DataFrame:
    """x joined to y at ``order`` shifted forward by each lag in steps of the calendar: rows (groups, lag, order, x, y)."""
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    forward = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(value, k).over(w.orderBy(order)).alias("y")) for k in lags])
    ys = y.withColumn("_f", forward).select(*groups, order, F.explode("_f").alias("_f")).select(*groups, order, "_f.lag", "_f.y")
    return x.join(ys, [*groups, order]).where("x is not null and y is not null")


def association_grid(pairs: DataFrame, groups: list[str], order: str) -> DataFrame:
    """For each group: n, Pearson's r, Spearman's rho, r of first differences, and the range of r leaving one row out.

    Leaving one out is by downdating moments: no self join.
    """
    w = Window.partitionBy(*groups)
    d = pairs.withColumns({"rx": average_rank("x", groups), "ry": average_rank("y", groups)})
    d = d.withColumns({"dx": F.col("x") - F.lag("x").over(w.orderBy(order)), "dy": F.col("y") - F.lag("y").over(w.orderBy(order))})
    n1 = F.count(F.lit(1)).over(w) - 1
    mx, my = F.avg("x").over(w), F.avg("y").over(w)
    d = d.withColumns({"cx": F.col("x") - mx, "cy": F.col("y") - my})
    sxx, syy, sxy = (F.sum(a).over(w) for a in (F.col("cx") * F.col("cx"), F.col("cy") * F.col("cy"), F.col("cx") * F.col("cy")))
    scale = (n1 + 1) / F.nullif(n1, F.lit(0))
    vx, vy, vxy = sxx - F.col("cx") * F.col("cx") * scale, syy - F.col("cy") * F.col("cy") * scale, sxy - F.col("cx") * F.col("cy") * scale
    d = d.withColumn("loo", F.when((vx > 1e-12 * sxx) & (vy > 1e-12 * syy), vxy / F.sqrt(vx * vy)))
    return d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("r"), correlation("rx", "ry").alias("rho"),
        correlation("dx", "dy").alias("r_diff"), F.min("loo").alias("loo_min"), F.max("loo").alias("loo_max"),
    )


def detrended(df: DataFrame, groups: list[str], order: str, value: str, out: str) -> DataFrame:
    """Residuals of a straight line on the row's place in its group."""
    w = Window.partitionBy(*groups)
    d = df.withColumn("_t", (F.row_number().over(w.orderBy(order)) - 1).cast("double"))
    slope = F.regr_slope(value, "_t").over(w)
    level = F.regr_intercept(value, "_t").over(w)
    return d.withColumn(out, F.col(value) - (level + slope * F.col("_t"))).drop("_t")


def autocorrelation(df: DataFrame, groups: list[str], order: str, value: str, by: int = 1) -> DataFrame:
    """Correlation of a series with itself ``by`` steps before, a group."""
    w = Window.partitionBy(*groups).orderBy(order)
    return df.withColumn("_b", F.lag(value, by).over(w)).groupBy(*groups).agg(correlation(value, "_b").alias("autocorrelation"))


def circular_shift_p(pairs: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Share of all circular shifts of y whose |r| reaches the observed one. Groups are short series (shifts x length rows)."""
    w = Window.partitionBy(*groups)
    d = pairs.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    shifts = d.select(*groups, "x", "_i", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("shift")).withColumn("_j", (F.col("_i") + F.col("shift")) % F.col("_n"))
    ys = d.select(*groups, F.col("_i").alias("_j"), "y")
    r = shifts.join(ys, [*groups, "_j"]).groupBy(*groups, "shift").agg(correlation("x", "y").alias("r"))
    own = F.max(F.when(F.col("shift") == 0, F.abs("r"))).over(w)
    return r.withColumn("own", own).groupBy(*groups).agg((F.count_if(F.abs("r") >= F.col("own") - 1e-12) / F.count("r")).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, groups: list[str] = (), out: str = "q", chunk_rows: int = 200_000) -> DataFrame:
    """Monotone from the right, at most 1; a null p has a null q and counts for nothing.

    Without groups the whole table is one family: rows are numbered bucket by bucket, and the least value to the right of a
    row is the least in its bucket and of the later buckets' least, so no window spans the table.
    """
    known, none = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    if groups:
        w = Window.partitionBy(*groups)
        d = known.withColumn("_i", F.row_number().over(w.orderBy(p, key)))
        d = d.withColumn("_raw", F.col(p) * F.count(p).over(w) / F.col("_i"))
        tail = w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # from the right: a frame that only grows
        return d.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(tail))).drop("_raw", "_i").unionByName(none)
    total = known.count()
    d = row_index(known, [p, key], "_i", chunk_rows).withColumn("_raw", F.col(p) * F.lit(float(total)) / (F.col("_i") + 1)).withColumn("_c", F.floor(F.col("_i") / chunk_rows))
    least = d.groupBy("_c").agg(F.min("_raw").alias("_m"))
    later = Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    least = least.select("_c", F.min("_m").over(later).alias("_later"))
    tail = Window.partitionBy("_c").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # from the right: a frame that only grows
    d = d.withColumn("_raw", F.min("_raw").over(tail)).join(least, "_c")
    return d.select(*df.columns, F.least(F.lit(1.0), F.col("_raw"), F.coalesce("_later", F.lit(1.0))).alias(out)).unionByName(none)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation under independence, by Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def with_p(grid: DataFrame, r: str = "r", n: str = "n", out: str = "p") -> DataFrame:
    """p beside r, through an Arrow UDF over the grid's few rows."""

    @F.pandas_udf("double")
    def run(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(None if x != x else float(x), int(m)) for x, m in zip(rs, ns, strict=True)], dtype="float64")

    return grid.withColumn(out, run(r, n))


def stationary_indices(n: int, draws: int, block: float, seed: int) -> np.ndarray:
    """(draws, n) positions: blocks of geometric length with mean ``block``, wrapping around."""
    rng = np.random.default_rng(seed)
    out = np.empty((draws, n), dtype=np.int32)
    out[:, 0] = rng.integers(0, n, draws)
    for i in range(1, n):
        out[:, i] = np.where(rng.random(draws) < 1 / block, rng.integers(0, n, draws), (out[:, i - 1] + 1) % n)
    return out


def index_table(spark: SparkSession, n: int, draws: int, block: float, seed: int) -> DataFrame:
    """Rows (draw, pos, idx); draws x n small integers, made on the driver as they come from one generator."""
    idx = stationary_indices(n, draws, block, seed)
    return spark.createDataFrame(pd.DataFrame({"draw": np.repeat(np.arange(draws), n), "pos": np.tile(np.arange(n), draws), "idx": idx.ravel()}), "draw int, pos int, idx int")


def index_tables(lengths: DataFrame, draws: int, block: float, seed: int) -> DataFrame:
    """Rows (n, draw, pos, idx) for every distinct ``n`` of ``lengths``, made on the executors; a length's generator has
    the seed ``seed`` + 100 ``block`` + n."""

    def run(batches):
        for f in batches:
            for n in map(int, f["n"]):
                idx = stationary_indices(n, draws, block, int(seed + 100 * block + n))
                yield pd.DataFrame({"n": np.full(draws * n, n), "draw": np.repeat(np.arange(draws), n), "pos": np.tile(np.arange(n), draws), "idx": idx.ravel()})

    return lengths.select(F.col("n").cast("int").alias("n")).distinct().mapInPandas(run, "n int, draw int, pos int, idx int")


def bootstrap_correlations(pairs: DataFrame, groups: list[str], order: str, indices: DataFrame, rank: bool = False) -> DataFrame:
    """(groups, draw, r): both series resampled by the same positions; ``rank`` ranks within each draw.

    ``indices`` is an index_table, for groups of its length only (others are an error), or index_tables.
    """
    w = Window.partitionBy(*(groups or [F.lit(1)]))
    d = pairs.withColumns({"idx": F.row_number().over(w.orderBy(order)) - 1, "n": F.count(F.lit(1)).over(w).cast("int")})
    if "n" not in indices.columns:
        indices = indices.withColumn("n", F.lit((indices.agg(F.max("pos")).first()[0] or 0) + 1))
    lengths = [r.n for r in indices.select("n").distinct().collect()]  # a row a length
    unknown = F.raise_error(F.concat(F.lit("no indices for a series of length "), F.col("n").cast("string"))).cast("int")
    drawn = d.withColumn("n", F.when(F.col("n").isin(lengths), F.col("n")).otherwise(unknown)).join(indices, ["n", "idx"])
    if rank:
        drawn = drawn.withColumns({"x": average_rank("x", [*groups, "draw"]), "y": average_rank("y", [*groups, "draw"])})
    return drawn.groupBy(*groups, "draw").agg(correlation("x", "y").alias("r"))


def intervals(draws: DataFrame, groups: list[str], value: str = "r", at: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Quantiles of the draws, a group."""
    q = F.percentile(value, list(at))
    return draws.groupBy(*groups).agg(F.count(value).alias("valid_draws"), q[0].alias("low"), q[1].alias("high"))


def contrasts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two sets of draws on the same draws."""
    return a.withColumnRenamed("r", "_a").join(b.withColumnRenamed("r", "_b"), [*keys, "draw"]).select(*keys, "draw", (F.col("_a") - F.col("_b")).alias("r"))


def confusion(df: DataFrame, groups: list[str], gold: Column, guess: Column, zero: float | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; undefined ratios are ``zero``. Rows without both labels are out."""
    d = df.where(gold.isNotNull() & guess.isNotNull()).withColumns({"_g": gold.cast("boolean"), "_p": guess.cast("boolean")})
    g = d.groupBy(*groups).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("_g") & F.col("_p")), ("fp", ~F.col("_g") & F.col("_p")), ("fn", F.col("_g") & ~F.col("_p")), ("tn", ~F.col("_g") & ~F.col("_p")))])
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(zero).cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(*groups, "tp", "fp", "fn", "tn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def policy_grid(df: DataFrame, gold: list[str], policies: list[str], keys: list[str] = ()) -> DataFrame:
    """A confusion row for every (annotator, policy), the best F1 first: columns of 0/1 labels are unpivoted, not looped over."""
    pairs = F.array(*[F.struct(F.lit(g).alias("annotator"), F.lit(p).alias("policy"), F.col(g).cast("int").alias("gold"), F.col(p).cast("int").alias("guess")) for g in gold for p in policies])
    long = df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")
    grid = confusion(long, [*keys, "annotator", "policy"], F.col("gold") == 1, F.col("guess") == 1)
    return grid.orderBy(F.desc_nulls_last("f1"), *keys, "annotator", "policy")


def threshold_sweep(df: DataFrame, score: str, gold: Column, thresholds: list[float], zero: float | None = 0.0) -> DataFrame:
    """A confusion row for each threshold (score above it). Rows meet thresholds after a histogram of the few cut points."""
    ts = sorted(thresholds)
    passed = sum((F.col(score) > t).cast("int") for t in ts)
    hist = df.where(gold.isNotNull() & F.col(score).isNotNull()).groupBy(passed.alias("passed")).agg(F.count_if(gold.cast("boolean")).alias("pos"), F.count_if(~gold.cast("boolean")).alias("neg"))
    cut = hist.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("rank")) for i, t in enumerate(ts)])).alias("t"), "passed", "pos", "neg").select("t.*", "passed", "pos", "neg")
    over = F.col("passed") >= F.col("rank")
    g = cut.groupBy("threshold").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(over, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(over, 0).otherwise(F.col("neg"))).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(zero).cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("threshold", "tp", "fp", "fn", "tn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def agreement(df: DataFrame, groups: list[str], a: Column, b: Column) -> DataFrame:
    """Two annotators' binary labels: n, both yes, both no, agreement, Cohen's kappa and PABAK."""
    d = df.where(a.isNotNull() & b.isNotNull()).withColumns({"_a": a.cast("int"), "_b": b.cast("int")})
    g = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("both_yes"), F.count_if((F.col("_a") == 0) & (F.col("_b") == 0)).alias("both_no"), F.avg("_a").alias("_pa"), F.avg("_b").alias("_pb"))
    po = (F.col("both_yes") + F.col("both_no")) / F.col("n")
    pe = F.col("_pa") * F.col("_pb") + (1 - F.col("_pa")) * (1 - F.col("_pb"))
    return g.select(*groups, "n", "both_yes", "both_no", po.alias("agreement"), F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), (2 * po - 1).alias("pabak"))


def sample_size(population: int, z: float = 1.96, p: float = 0.5, margin: float = 0.05) -> int:
    """Cochran's with the finite-population correction."""
    n0 = z * z * p * (1 - p) / (margin * margin)
    return math.ceil(n0 / (1 + (n0 - 1) / population)) if population else 0


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from the contingency table's pair counts."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    both = cells.agg(F.sum(two(n)).alias("s"), F.sum("n").cast("double").alias("t"))
    one = cells.groupBy(a).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    other = cells.groupBy(b).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    j = both.crossJoin(one).crossJoin(other)  # three single rows
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("t")), F.lit(0.0))
    return j.select(F.coalesce(F.try_divide(F.col("s") - expected, F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def assigned_jaccard(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows that both conditions hold for, as a share of those that either does."""
    return df.agg(F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b).cast("double")).alias("jaccard"))
