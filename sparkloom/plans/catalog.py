"""Every operator of the library as a registered query over the test tables, beside the SQL it is held against.

Views that both sides share (an activity table made of events, a market made of orders) are written once, in the SQL
that Spark and DuckDB both read. Floating-point results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import numeric as N
from ..functions import rules as R
from ..functions import text as T
from ..functions import time as C
from ..operators import aggregates as A
from ..operators import agglomerate, clustering, corex, density, neardup, projection, reduction
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import sampling as Q
from ..operators import semantic as M
from ..operators import sets as U
from ..operators import statistics as K
from ..operators import windows as W
from ..streaming.weekly import weekly_counts
from . import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if k == "double" else F.col(f"`{n}`") for n, k in df.dtypes])


ACTIVITY = [
    "event_id AS record_key", "CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'reddit' END AS platform", "CAST(date_trunc('week', ts) AS DATE) AS week", "ts",
    "CAST((event_id * 7 + user_id) % 23 - 1 AS INT) AS topic", "CAST(floor(value) AS INT) AS training_key",
    "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('u', user_id % 37) END AS author", "concat('t', user_id % 40) AS thread_id", "event_type", "value", "user_id",
]
ACT = f"(SELECT {', '.join(ACTIVITY)} FROM events)"
DOMAINS = [("rent", 1), ("rent", 2), ("rent", 5), ("buy", 2), ("buy", 7), ("law", 3), ("law", 30), ("none", 99)]
DOM = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in DOMAINS) + ") AS v(domain, topic))"
MARKET = ["o_orderkey AS sale", "o_orderdate AS sold", "o_totalprice AS value", "o_orderstatus AS segment", "o_orderpriority AS area", "o_custkey AS buyer"]
MKT = f"(SELECT {', '.join(MARKET)} FROM orders)"


def activity(spark, d):
    return t(spark, d, "events").selectExpr(*ACTIVITY)


def domains(spark):
    return spark.createDataFrame(DOMAINS, "domain string, topic int")


def market(spark, d):
    return t(spark, d, "orders").selectExpr(*MARKET)


# --- aggregations -------------------------------------------------------------------------------------------------


@query(f"""
WITH a AS {ACT}, dm AS {DOM},
tot AS (SELECT platform, week, count(*) AS eligible_records, count(*) FILTER (topic <> -1) AS topic_assigned_records, count(DISTINCT training_key) AS units FROM a GROUP BY ALL),
hit AS (SELECT domain, platform, week, count(*) AS n, count(DISTINCT training_key) AS u FROM a JOIN dm USING (topic) GROUP BY ALL)
SELECT domain, platform, week, CAST(coalesce(n, 0) AS BIGINT) AS count, eligible_records, CAST(topic_assigned_records AS BIGINT) AS topic_assigned_records,
 round(coalesce(n, 0) / eligible_records, 6) AS share_all, round(coalesce(n, 0) / topic_assigned_records, 6) AS share_assigned,
 round(topic_assigned_records / eligible_records, 6) AS topic_coverage, round(coalesce(u, 0) / units, 6) AS share_unique
FROM tot CROSS JOIN (SELECT DISTINCT domain FROM dm) LEFT JOIN hit USING (domain, platform, week)""")
def flagship_weekly_share(spark, d):
    return rounded(A.weekly_domain_share(activity(spark, d), domains(spark)))


@query(f"""SELECT DISTINCT 'law' AS domain, platform, week FROM {ACT} WHERE week >= DATE '2024-01-15' AND topic <> -1""")
def share_identity_violations(spark, d):
    """A panel whose law shares are spoiled from the third week on: just those rows are found."""
    p = A.weekly_domain_share(activity(spark, d), domains(spark))
    spoiled = F.when((F.col("domain") == "law") & (F.col("week") >= "2024-01-15"), F.col("share_all") + 0.01).otherwise(F.col("share_all"))
    return A.identity_violations(p.withColumn("share_all", spoiled)).select("domain", "platform", "week")


@query(f"""SELECT CAST(date_trunc('week', sold) AS DATE) AS week, count(*) AS sales, round(sum(value), 2) AS total_value, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value,
 count(*) FILTER (segment = 'O') AS first_sales, count(*) FILTER (segment = 'F') AS second_sales, round(median(value) FILTER (segment = 'O'), 6) AS first_median, round(median(value) FILTER (segment = 'F'), 6) AS second_median
 FROM {MKT} WHERE value > 0 AND sold IS NOT NULL GROUP BY 1""")
def market_weekly_panel(spark, d):
    p = rounded(A.market_weeks(market(spark, d), F.col("sold"), "value", "segment", ("O", "F")))
    return p.withColumn("total_value", F.round("total_value", 2))


@query(f"SELECT CAST(floor(datediff('day', DATE '1995-01-02', CAST(date_trunc('week', sold) AS DATE)) / 14) AS INT) AS period, count(*) AS sales, round(sum(value), 2) AS total_value, round(median(value), 6) AS median_value FROM {MKT} GROUP BY 1")
def market_fortnights(spark, d):
    m = market(spark, d)
    return A.aggregated_periods(m, C.fortnight(C.week_start("sold"), "1995-01-02"), "value").select("period", "sales", F.round("total_value", 2).alias("total_value"), F.round("median_value", 6).alias("median_value"))


@query(f"SELECT area, CAST(date_trunc('week', sold) AS DATE) + 6 AS week_end, count(*) AS n, round(avg(value), 6) AS mean_value FROM {MKT} GROUP BY ALL")
def market_sunday_weeks(spark, d):
    return rounded(A.sunday_weeks(market(spark, d), ["area"], "sold", F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


@query(f"""WITH m AS (SELECT CAST(date_trunc('month', sold) AS DATE) AS month, count(*) AS sales, median(value) AS price FROM {MKT} GROUP BY 1)
SELECT month, sales, round(price, 6) AS price, round(sales / lag(sales) OVER w - 1, 6) AS sales_growth, round(price / lag(price) OVER w - 1, 6) AS price_growth FROM m WINDOW w AS (ORDER BY month)""")
def market_growth(spark, d):
    m = market(spark, d).groupBy(F.date_trunc("month", "sold").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("sales"), F.median("value").alias("price"))
    return rounded(A.growth_panel(m, "month", ["sales", "price"]))


@query(f"""WITH w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY platform, week, CASE WHEN trim(author) = '' THEN 'record:' || record_key ELSE author END) AS weight FROM {ACT})
SELECT platform, week, round(sum(CASE WHEN topic IN (1, 2, 5) THEN weight ELSE 0 END) / sum(weight), 6) AS weighted_share FROM w GROUP BY ALL""")
def weighted_share(spark, d):
    w = A.inverse_multiplicity(activity(spark, d), ["platform", "week"], "author", "record_key")
    return rounded(A.weighted_share(w, ["platform", "week"], "weight", F.col("topic").isin(1, 2, 5)))


@query(f"""WITH p AS (SELECT platform, author, author <> '' AS k, count(*) AS n FROM {ACT} GROUP BY ALL)
SELECT platform, sum(n)::BIGINT AS records, count(*) FILTER (k) AS units, round(sum(n * n) FILTER (k) / (sum(n) FILTER (k))::DOUBLE ^ 2, 6) AS herfindahl, round(max(n) FILTER (k) / sum(n) FILTER (k), 6) AS top_share, round(100.0 * sum(n) FILTER (k) / sum(n), 6) AS known_pct FROM p GROUP BY 1""")
def author_concentration(spark, d):
    return rounded(A.concentration(activity(spark, d), ["platform"], "author"))


@query(f"""SELECT training_key, count(*) AS n, count(DISTINCT nullif(author, '')) AS known_authors, count(*) - 1 AS extra_rows, count(nullif(author, '')) - count(DISTINCT nullif(author, '')) AS same_author_extra,
 count(DISTINCT nullif(author, '')) - CASE WHEN count(nullif(author, '')) > 0 THEN 1 ELSE 0 END AS cross_author_extra,
 count(*) - count(nullif(author, '')) - 1 + CASE WHEN count(nullif(author, '')) > 0 THEN 1 ELSE 0 END AS unknown_author_extra FROM {ACT} GROUP BY 1 HAVING count(*) > 1""")
def repeat_accounting(spark, d):
    return A.repeat_accounting(activity(spark, d), "training_key", "author")


@query(f"WITH p AS (SELECT platform, week, thread_id, count(*) AS n FROM {ACT} GROUP BY ALL) SELECT platform, week, sum(n)::BIGINT AS records, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share FROM p GROUP BY ALL")
def largest_thread(spark, d):
    return rounded(A.largest_unit(activity(spark, d), ["platform", "week"], "thread_id"))


@query(f"WITH a AS {ACT}, s AS (SELECT platform, count(*) AS al FROM a GROUP BY 1) SELECT domain, platform, count(*) AS records, round(100.0 * count(*) / any_value(al), 6) AS pct FROM a JOIN {DOM} USING (topic) JOIN s USING (platform) GROUP BY ALL")
def domain_coverage(spark, d):
    return rounded(A.domain_coverage(activity(spark, d), domains(spark)))


@query(f"WITH m AS (SELECT topic, count(DISTINCT domain) AS k FROM {DOM} GROUP BY 1) SELECT coalesce(k, 0) AS memberships, count(*) AS records FROM {ACT} LEFT JOIN m USING (topic) GROUP BY 1")
def domain_overlap(spark, d):
    return A.overlap(activity(spark, d), domains(spark))


@query("SELECT event_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, d):
    return rounded(A.value_counts(t(spark, d, "events"), ["event_type"]))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\", count(*) FILTER (o_orderpriority = 'absent') AS absent FROM orders GROUP BY 1")
def pivot_wide(spark, d):
    return A.wide(t(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "5-LOW", "absent"], F.count(F.lit(1)))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def joined_sets(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(A.joined_set("event_type").alias("kinds"))


@query(f"""SELECT area, count(*) AS total, count(*) FILTER (segment = 'O') AS offplan, count(*) FILTER (value > 200000) AS large, round(count(*) FILTER (segment = 'O') / count(*), 6) AS offplan_share, round(count(*) FILTER (value > 200000) / count(*), 6) AS large_share FROM {MKT} GROUP BY 1""")
def mix_shares(spark, d):
    return rounded(A.mix_shares(market(spark, d), ["area"], {"offplan": F.col("segment") == "O", "large": F.col("value") > 200000}))


@query(f"SELECT area, round(coalesce(sum(value) FILTER (segment = 'O'), 0.0), 2) AS offplan_value FROM {MKT} GROUP BY 1")
def conditional_sum(spark, d):
    return market(spark, d).groupBy("area").agg(F.round(A.conditional_sum("value", F.col("segment") == "O"), 2).alias("offplan_value"))


@query("WITH p AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, count(*) AS periods, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS volatility, sum(n)::BIGINT AS total FROM p GROUP BY 1 ORDER BY avg(n) DESC, user_id LIMIT 10")
def activity_stats_top10(spark, d):
    e = t(spark, d, "events").withColumn("week", C.week_start("ts"))
    return rounded(A.activity_stats(e, "user_id", "week", 10))


@query(f"""WITH p AS (SELECT buyer, CAST(date_trunc('month', sold) AS DATE) AS month, count(*) AS n FROM {MKT} GROUP BY ALL),
b AS (SELECT buyer, sum(n)::BIGINT AS total, CAST(row_number() OVER (ORDER BY sum(n) DESC, buyer) AS INT) AS rank FROM p GROUP BY 1 QUALIFY rank <= 15)
SELECT buyer, month, n, total, rank FROM p JOIN b USING (buyer)""")
def top_panel15(spark, d):
    m = market(spark, d).withColumn("month", F.date_trunc("month", "sold").cast("date"))
    return A.top_panel(m, "buyer", "month", 15)


@query("SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def compositions(spark, d):
    return A.compositions(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def crosstab(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT area, round(quantile_cont(value, 0.5), 6) AS q0_5, round(quantile_cont(value, 0.9), 6) AS q0_9, round(quantile_cont(value, 0.99), 6) AS q0_99, round(quantile_cont(value, 1.0), 6) AS q1_0 FROM {MKT} GROUP BY 1")
def quantiles(spark, d):
    return rounded(A.quantiles(market(spark, d), ["area"], "value", [0.5, 0.9, 0.99, 1.0]))


@query(f"WITH q AS (SELECT area, quantile_cont(value, 0.99) AS q FROM {MKT} GROUP BY 1) SELECT area, round(sum(least(value, q)), 2) AS winsorized FROM {MKT} JOIN q USING (area) GROUP BY 1")
def winsorized(spark, d):
    return A.winsorized(market(spark, d), "value", "w", 0.99, ["area"]).groupBy("area").agg(F.round(F.sum("w"), 2).alias("winsorized"))


@query("SELECT count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem")
def describe(spark, d):
    return rounded(A.describe(t(spark, d, "lineitem"), "l_quantity"))


@query("SELECT 'quality' AS column_name, count(*) - count(quality) AS missing FROM labels UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM labels UNION ALL SELECT 'doc_id', count(*) - count(doc_id) FROM labels")
def missing_census(spark, d):
    return A.missing_census(t(spark, d, "labels"))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)")
def duplicate_rows(spark, d):
    return A.duplicate_rows(t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(f"""WITH f AS (SELECT platform, CASE WHEN value < 5 THEN 'small' WHEN topic = -1 THEN 'noise' WHEN author = '' THEN 'anonymous' ELSE '' END AS r FROM {ACT}),
s AS (SELECT * FROM (VALUES (1, 'small'), (2, 'noise'), (3, 'anonymous')) AS v(stage_order, stage)),
c AS (SELECT platform, stage_order, stage, count(*) FILTER (r = stage) AS removed, count(*) AS al FROM f CROSS JOIN s GROUP BY ALL)
SELECT CAST(stage_order AS INT) AS stage_order, stage, platform, removed, CAST(al - sum(removed) OVER (PARTITION BY platform ORDER BY stage_order) AS BIGINT) AS retained FROM c""")
def exclusion_waterfall(spark, d):
    rules = [("small", F.col("value") < 5), ("noise", F.col("topic") == -1), ("anonymous", F.col("author") == "")]
    return A.exclusion_waterfall(activity(spark, d), rules, "platform")[1]


@query(f"""WITH s AS (SELECT platform, 1 AS stage_order, 'raw' AS stage, count(*) AS count FROM {ACT} GROUP BY 1 UNION ALL SELECT platform, 2, 'topic', count(*) FROM {ACT} WHERE topic <> -1 GROUP BY 1 UNION ALL SELECT platform, 3, 'author', count(*) FROM {ACT} WHERE topic <> -1 AND author <> '' GROUP BY 1)
SELECT platform, stage_order, stage, count, lag(count) OVER w AS previous_count, lag(count) OVER w - count AS removed, round_even(100.0::DOUBLE * count / lag(count) OVER w, 2) AS pct_of_previous, round_even(100.0::DOUBLE * count / first(count) OVER w, 2) AS pct_of_raw FROM s WINDOW w AS (PARTITION BY platform ORDER BY stage_order)""")
def retention_ledger(spark, d):
    c = activity(spark, d).groupBy("platform").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("topic") != -1).alias("b"), F.count_if((F.col("topic") != -1) & (F.col("author") != "")).alias("c"))
    stages = c.select("platform", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("stage_order"), F.lit(n).alias("stage"), F.col(x).alias("count")) for i, (n, x) in enumerate((("raw", "a"), ("topic", "b"), ("author", "c")))])).alias("s")).select("platform", "s.*")
    return A.retention(stages)


# --- windows --------------------------------------------------------------------------------------------------------


@query(f"""SELECT record_key, count(*) OVER (PARTITION BY training_key) AS family_size, row_number() OVER (PARTITION BY training_key ORDER BY ts, record_key) = 1 AS representative,
 CAST((SELECT count(DISTINCT b.author) FROM {ACT} b WHERE b.training_key = a.training_key) AS INT) AS authors, first(record_key) OVER (PARTITION BY training_key ORDER BY ts, record_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_record FROM {ACT} a""")
def family_windows(spark, d):
    f = D.families(activity(spark, d), "training_key", "ts", "record_key")
    f = f.withColumns({"authors": W.group_distinct("author", "training_key"), "first_record": W.first_in("record_key", ["training_key"], "ts", "record_key")})
    return f.select("record_key", "family_size", "representative", "authors", "first_record")


@query(f"""WITH p AS (SELECT area, CAST(date_trunc('week', sold) AS DATE) AS week, count(*) AS n FROM {MKT} GROUP BY ALL)
SELECT area, week, n, lag(n) OVER w AS prev, lead(n) OVER w AS next, n - lag(n) OVER w AS diff, round(avg(n) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS rolling12,
 round(CASE WHEN count(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN avg(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END, 6) AS trailing4,
 round(CASE WHEN count(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN n / avg(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END, 6) AS surge,
 rank() OVER (PARTITION BY area ORDER BY n) + (count(*) OVER (PARTITION BY area, n) - 1) / 2 AS avg_rank, round((n - avg(n) OVER (PARTITION BY area)) / stddev_samp(n) OVER (PARTITION BY area), 6) AS z FROM p WINDOW w AS (PARTITION BY area ORDER BY week)""")
def series_windows(spark, d):
    p = market(spark, d).withColumn("week", C.week_start("sold")).groupBy("area", "week").agg(F.count(F.lit(1)).alias("n"))
    k = ["area"]
    return rounded(p.withColumns({"prev": W.previous("n", k, "week"), "next": W.following("n", k, "week"), "diff": W.change("n", k, "week"), "rolling12": W.rolling_mean("n", k, "week"), "trailing4": W.trailing_mean("n", k, "week"), "surge": W.surge("n", k, "week"), "avg_rank": W.average_rank("n", k), "z": W.z_score("n", k)}))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS source_row FROM orders")
def row_index(spark, d):
    return W.row_index(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], chunk_rows=5_000).select("o_orderkey", "source_row")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_per_key(spark, d):
    return D.best_engagement(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_nationkey, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_join(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_name", "c_name")


@query("SELECT l.doc_id, l.quality AS quality_a1, 1 - l.quality AS quality_a2 FROM labels l")
def one_to_one_join(spark, d):
    a = t(spark, d, "labels").select("doc_id", "quality")
    return J.one_to_one(a, a.withColumn("quality", F.lit(1) - F.col("quality")), ["doc_id"], ("_a1", "_a2"))


@query("""WITH last AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), seg AS (SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_acctbal > 0)
SELECT c.c_custkey, coalesce(l.s, g.s, 'unknown') AS label FROM customer c LEFT JOIN last l ON l.o_custkey = c.c_custkey LEFT JOIN seg g ON g.c_custkey = c.c_custkey""")
def lookup_fallback(spark, d):
    last = J.keep_last(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "o_custkey", "o_orderstatus", "o_orderkey")
    seg = t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return J.lookup(t(spark, d, "customer").select("c_custkey"), F.col("c_custkey"), [(last, "o_custkey", "o_orderstatus"), (seg, "c_custkey", "c_mktsegment")], "label", "unknown")


@query("SELECT a.conv_id, a.turn, coalesce(sha256(p.text), '') AS parent_hash FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 AND a.role = 'assistant'")
def same_thread_parent(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "text", F.format_string("%d-%d", "conv_id", "turn").alias("id"), F.when(F.col("role") == "assistant", F.format_string("%d-%d", F.col("conv_id"), F.col("turn") - 1)).alias("parent_id"))
    p = J.same_thread_parent(c, "id", "parent_id", "conv_id", "text")
    return p.select("conv_id", "turn", F.when(F.col("immediate_parent") == "", "").otherwise(F.sha2(F.col("immediate_parent").cast("binary"), 256)).alias("parent_hash"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, d):
    return J.semi(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, d):
    return J.anti(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000)
SELECT k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'regex_only' ELSE 'semantic_only' END AS source_label FROM a FULL JOIN b USING (k)""")
def provenance(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return J.provenance(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 400000"), "k")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, round(s_acctbal) AS bal FROM supplier), l AS (SELECT c_custkey, c_nationkey, round(c_acctbal) AS bal FROM customer),
x AS (SELECT s_nationkey, bal, min(s_suppkey) AS id FROM r GROUP BY ALL HAVING count(*) = 1), y AS (SELECT bal, min(s_suppkey) AS id FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT c_custkey, coalesce(x.id, y.id) AS s_suppkey, CASE WHEN x.id IS NOT NULL THEN 'nation+balance' WHEN y.id IS NOT NULL THEN 'balance' ELSE 'unmatched' END AS match_method
FROM l LEFT JOIN x ON x.s_nationkey = l.c_nationkey AND x.bal = l.bal LEFT JOIN y ON y.bal = l.bal""")
def waterfall_match(spark, d):
    left = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.round("c_acctbal").alias("bal"))
    right = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.round("s_acctbal").alias("bal"))
    return J.waterfall_match(left, right, "c_custkey", "s_suppkey", [("nation+balance", ["nation", "bal"]), ("balance", ["bal"])])


@query("WITH u AS (SELECT * FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1) SELECT o_custkey, o_orderkey, c_name FROM u JOIN customer ON c_custkey = o_custkey")
def unambiguous_join(spark, d):
    return J.unambiguous(t(spark, d, "orders").select("o_custkey", "o_orderkey"), t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), ["o_custkey"])


@query("""WITH w AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-12', INTERVAL 7 DAY)) AS DATE) AS week), k AS (SELECT DISTINCT event_type FROM events),
p AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, median(value) AS v FROM events GROUP BY ALL)
SELECT week, event_type, coalesce(n, 0) AS n, round(v, 6) AS v FROM w CROSS JOIN k LEFT JOIN p USING (week, event_type)""")
def calendar_spine(spark, d):
    e = t(spark, d, "events").withColumn("week", C.week_start("ts"))
    spine = J.product_spine(C.calendar(spark, "2023-12-25", "2024-02-12"), e.select("event_type").distinct())
    return rounded(J.spine_join(spine, e.groupBy("week", "event_type").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("v")), ["week", "event_type"], ["n"]))


# --- sets, samples ---------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000), f AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b USING (k))
SELECT count(x) AS a_size, count(y) AS b_size, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, count(*) AS either FROM f""")
def overlap_sizes(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return U.overlap_sizes(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 400000"), "k")


@query("SELECT doc_id AS k, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_differences(spark, d):
    return U.differences(t(spark, d, "documents").select(F.col("doc_id").alias("k")), t(spark, d, "labels").select(F.col("doc_id").alias("k")))


@query("SELECT n_name AS name, n_nationkey AS key, CAST(NULL AS INT) AS region FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def union_by_name(spark, d):
    return U.union_by_name(t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), t(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")))


@query("""WITH s AS (SELECT p_type, p_name, max(p_retailprice) AS s FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY s DESC, p_name) AS n FROM s WHERE s >= 905)
SELECT p_type, CAST((n - 1) // 6 AS INT) AS chunk, string_agg('"' || p_name || '"', ' OR ' ORDER BY n) AS query FROM r WHERE n <= 18 GROUP BY ALL""")
def top_term_chunks(spark, d):
    s = t(spark, d, "part").groupBy("p_type", "p_name").agg(F.max("p_retailprice").alias("s"))
    return U.top_chunks(s, "p_type", "p_name", "s", 905, 18, 6)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def simple_sample(spark, d):
    return Q.simple_sample(t(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 20")
def sample_per_group(spark, d):
    return Q.per_group(t(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 20)


@query("""WITH s AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), g AS (SELECT lang, least(c, greatest(1, ceil(97 * c / sum(c) OVER ())))::INT AS g FROM s),
k AS (SELECT greatest(0, sum(g) - greatest(97, count(*))) AS k FROM g), u AS (SELECT *, row_number() OVER (ORDER BY level DESC, lang DESC) AS n FROM (SELECT lang, unnest(range(1, g + 1)) AS level FROM g)),
q AS (SELECT lang, count(*) AS quota FROM u, k WHERE n > k GROUP BY 1)
SELECT lang, doc_id FROM documents JOIN q USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= quota""")
def sample_proportional(spark, d):
    return Q.proportional(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 97)


@query("""WITH n AS (SELECT lang, least(30, greatest(1, CAST(round_even(100 * count(*) / sum(count(*)) OVER (), 0) AS INT))) AS q FROM documents GROUP BY 1)
SELECT lang, doc_id FROM documents JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= q""")
def sample_rounded(spark, d):
    return Q.rounded_by_label(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 100, 30)


@query()
def sample_unique_quota(spark, d):
    docs = t(spark, d, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("family"))
    return Q.unique_quota(docs, "lang", "doc_id", ["family"], 10).select("lang", "doc_id")


@query("SELECT lang, doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 40 THEN 'calibration' ELSE 'holdout' END AS split FROM documents")
def sample_split(spark, d):
    return Q.split(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 40)


@query("SELECT item_id, printf('CTX-%03d', row_number() OVER (ORDER BY md5('7:' || item_id), item_id)) AS review_id FROM benchmark")
def public_ids(spark, d):
    lead = F.conv(F.substring(Q.draw("item_id", 7), 1, 12), 16, 10).cast("long")  # a number that stands as the hash does
    return Q.public_ids(t(spark, d, "benchmark").select("item_id"), [lead, Q.draw("item_id", 7), "item_id"])


# --- statistics -------------------------------------------------------------------------------------------------------

SERIES = "(SELECT area, CAST(date_trunc('month', sold) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS x, median(value) AS y FROM " + MKT + " GROUP BY ALL)"


def series(spark, d):
    m = market(spark, d).withColumn("month", F.date_trunc("month", "sold").cast("date"))
    return m.groupBy("area", "month").agg(F.count(F.lit(1)).cast("double").alias("x"), F.median("value").alias("y"))


@query(f"""WITH s AS {SERIES}, l AS (SELECT area, month, unnest([0, 1, 2]) AS lag, unnest([y, lead(y) OVER w, lead(y, 2) OVER w]) AS y FROM s WINDOW w AS (PARTITION BY area ORDER BY month)),
p AS (SELECT s.area, l.lag, s.month, s.x, l.y FROM s JOIN l USING (area, month) WHERE l.y IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY area, lag ORDER BY x) + (count(*) OVER (PARTITION BY area, lag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY area, lag ORDER BY y) + (count(*) OVER (PARTITION BY area, lag, y) - 1) / 2 AS ry,
 x - lag(x) OVER v AS dx, y - lag(y) OVER v AS dy FROM p WINDOW v AS (PARTITION BY area, lag ORDER BY month)),
o AS (SELECT a.area, a.lag, a.month, corr(b.x, b.y) AS loo FROM p a JOIN p b ON a.area = b.area AND a.lag = b.lag AND a.month <> b.month GROUP BY ALL),
m AS (SELECT area, lag, min(loo) AS lo, max(loo) AS hi FROM o GROUP BY ALL)
SELECT area, lag, count(*) AS n, round(corr(x, y), 6) AS r, round(corr(rx, ry), 6) AS rho, round(corr(dx, dy), 6) AS r_diff, round(any_value(lo), 6) AS loo_min, round(any_value(hi), 6) AS loo_max FROM r JOIN m USING (area, lag) GROUP BY ALL""")
def association_grid(spark, d):
    s = series(spark, d)
    pairs = K.lagged(s.select("area", "month", "x"), s.select("area", "month", "y"), ["area"], "month", [0, 1, 2])
    return rounded(K.association_grid(pairs, ["area", "lag"], "month"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month) - 1.0 AS t FROM {SERIES}), c AS (SELECT area, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM s GROUP BY 1)
SELECT area, month, round(x - (a + b * t), 6) AS rest FROM s JOIN c USING (area)""")
def detrended(spark, d):
    return rounded(K.detrended(series(spark, d), ["area"], "month", "x", "rest").select("area", "month", "rest"))


@query(f"WITH s AS (SELECT *, lag(x) OVER (PARTITION BY area ORDER BY month) AS b FROM {SERIES}) SELECT area, round(corr(x, b), 6) AS autocorrelation FROM s WHERE b IS NOT NULL GROUP BY 1")
def autocorrelation(spark, d):
    return rounded(K.autocorrelation(series(spark, d), ["area"], "month", "x"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY area) AS n FROM {SERIES}),
r AS (SELECT a.area, k.k, corr(a.x, b.y) AS r FROM s a JOIN (SELECT unnest(range(0, 400)) AS k) k ON k.k < a.n JOIN s b ON b.area = a.area AND b.i = (a.i + k.k) % a.n GROUP BY ALL),
o AS (SELECT area, abs(r) AS own FROM r WHERE k = 0)
SELECT area, round(count(*) FILTER (abs(r) >= own - 1e-12) / count(*), 6) AS p FROM r JOIN o USING (area) GROUP BY 1""")
def circular_shift_p(spark, d):
    return rounded(K.circular_shift_p(series(spark, d), ["area"], "month"))


@query("""WITH p AS (SELECT p_partkey AS k, (p_size % 37 + 1) / 100.0::DOUBLE AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw FROM p)
SELECT k, p, round(least(1.0, min(raw) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def benjamini_hochberg(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_size") % 37 + 1) / F.lit(100.0)).alias("p"))
    return rounded(K.benjamini_hochberg(p, "p", "k"))


@query()
def bootstrap_intervals(spark, d):
    s = series(spark, d)
    lengths = s.groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    draws = K.bootstrap_correlations(s, ["area"], "month", K.index_tables(lengths, 4999, 3, 20260909))
    return rounded(K.intervals(draws, ["area"]))


@query(f"""WITH g AS (SELECT area, count(*) AS n, corr(x, y) AS r FROM {SERIES} GROUP BY 1), i AS (SELECT unnest(range(0, 401)) AS i),
f AS (SELECT area, any_value(n) AS n, any_value(r) AS r, sum((CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * cos(asin(abs(r)) * i / 400) ^ (n - 3) * asin(abs(r)) / 1200) AS part FROM g, i GROUP BY 1)
SELECT area, n, round(r, 6) AS r, round(1 - 2 * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt(pi()) * part, 6) AS p FROM f""")
def association_p(spark, d):
    return rounded(K.with_p(K.association_grid(series(spark, d), ["area"], "month")).select("area", "n", "r", "p"))


@query("""SELECT toxic, count(*) FILTER (quality = 1 AND g) AS tp, count(*) FILTER (quality = 0 AND g) AS fp, count(*) FILTER (quality = 1 AND NOT g) AS fn, count(*) FILTER (quality = 0 AND NOT g) AS tn,
 round(count(*) FILTER (quality = 1 AND g) / nullif(count(*) FILTER (g), 0), 6) AS precision, round(count(*) FILTER (quality = 1 AND g) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall,
 round(2 * count(*) FILTER (quality = 1 AND g) / nullif(2 * count(*) FILTER (quality = 1 AND g) + count(*) FILTER (quality = 0 AND g) + count(*) FILTER (quality = 1 AND NOT g), 0), 6) AS f1,
 round(count(*) FILTER ((quality = 1) = g) / count(*), 6) AS accuracy FROM (SELECT *, doc_id % 3 > 0 AS g FROM labels) GROUP BY 1""")
def confusion_matrix(spark, d):
    return rounded(K.confusion(t(spark, d, "labels"), ["toxic"], F.col("quality") == 1, F.col("doc_id") % 3 > 0))


@query("""WITH s AS (SELECT quality = 1 AS g, (doc_id % 100) / 100.0::DOUBLE AS s FROM labels), x AS (SELECT unnest([0.25, 0.4, 0.6])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (s > threshold AND g) AS tp, count(*) FILTER (s > threshold AND NOT g) AS fp, count(*) FILTER (s <= threshold AND g) AS fn, count(*) FILTER (s <= threshold AND NOT g) AS tn FROM s CROSS JOIN x GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def threshold_sweep(spark, d):
    s = t(spark, d, "labels").select("quality", ((F.col("doc_id") % 100) / F.lit(100.0)).alias("s"))
    return rounded(K.threshold_sweep(s, "s", F.col("quality") == 1, [0.25, 0.4, 0.6]))


@query("""WITH l AS (SELECT quality AS a, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS b FROM labels), s AS (SELECT count(*) AS n, count(*) FILTER (a = 1 AND b = 1) AS yy, count(*) FILTER (a = 0 AND b = 0) AS nn, avg(a) AS pa, avg(b) AS pb FROM l)
SELECT n, yy AS both_yes, nn AS both_no, round((yy + nn) / n, 6) AS agreement, round(((yy + nn) / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa, round(2 * (yy + nn) / n - 1, 6) AS pabak FROM s""")
def annotator_agreement(spark, d):
    other = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return rounded(K.agreement(t(spark, d, "labels"), [], F.col("quality"), other))


@query("""WITH c AS (SELECT label AS a, vec_id % 4 AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM s, x, y""")
def adjusted_rand(spark, d):
    return rounded(K.adjusted_rand(t(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("b")), "label", "b"))


@query("SELECT round(count(*) FILTER (label > 2 AND vec_id % 3 > 0) / count(*) FILTER (label > 2 OR vec_id % 3 > 0), 6) AS jaccard FROM embeddings")
def assigned_jaccard(spark, d):
    return rounded(K.assigned_jaccard(t(spark, d, "embeddings"), F.col("label") > 2, F.col("vec_id") % 3 > 0))


# --- embeddings and terms -----------------------------------------------------------------------------------------------

UNIT = "(SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"


@query(f"""WITH v AS {UNIT}, s AS (SELECT a.vec_id, b.vec_id::VARCHAR AS i, list_inner_product(a.u, b.u) AS s FROM v a JOIN v b ON b.vec_id < 8), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS n FROM s)
SELECT vec_id, round(max(s) FILTER (n = 1), 6) AS sim_max, max(i) FILTER (n = 1) AS sim_best, round(avg(s) FILTER (n <= 2), 6) AS sim_top_mean FROM r GROUP BY 1""")
def reference_similarity(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(M.reference_similarity(e, "embedding", e.where("vec_id < 8"), "embedding", "vec_id").drop("embedding"))


@query(f"""WITH v AS {UNIT}, p AS (SELECT a.vec_id, max(list_inner_product(a.u, b.u)) AS s FROM v a JOIN v b ON b.vec_id < 8 GROUP BY 1), q AS (SELECT a.vec_id, max(list_inner_product(a.u, b.u)) AS s FROM v a JOIN v b ON b.vec_id BETWEEN 8 AND 15 GROUP BY 1)
SELECT vec_id, round(p.s, 6) AS pos_max, round(q.s, 6) AS neg_max, p.s >= 0.3 AND p.s - q.s >= 0.06 AS keep FROM p JOIN q USING (vec_id)""")
def contrastive_filter(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(M.contrastive_filter(e, "embedding", e.where("vec_id < 8"), e.where("vec_id between 8 and 15"), "embedding", "vec_id", 0.3).select("vec_id", "pos_max", "neg_max", "keep"))


@query("SELECT vec_id FROM embeddings WHERE abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.00000005")
def embedding_norm_drift(spark, d):
    return M.norm_violations(t(spark, d, "embeddings"), "embedding", 5e-8).select("vec_id")


@query(f"""WITH m AS (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY p) AS c FROM m GROUP BY 1),
s AS (SELECT v.label, list_inner_product(u, c) / sqrt(list_inner_product(c, c)) AS s FROM {UNIT} v JOIN c USING (label))
SELECT label, count(*) AS n, round(avg(s), 6) AS mean_cosine, round(median(s), 6) AS median_cosine FROM s GROUP BY 1""")
def topic_cohesion(spark, d):
    return rounded(M.cohesion(t(spark, d, "embeddings"), "label", "embedding"))


TERMS = r"(SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', ' ', 'g'), '[@#]', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS term FROM documents) WHERE length(term) > 1 GROUP BY ALL)"


@query(f"""WITH t AS {TERMS}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM t, n GROUP BY ALL HAVING count(*) >= 5 AND count(*) <= 0.8 * any_value(n)),
w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM t JOIN f USING (term), n), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY 1)
SELECT term, round(sum(w / z) / any_value(n), 6) AS mean_weight FROM w JOIN z USING (doc_id), n GROUP BY 1 ORDER BY sum(w / z) DESC, term LIMIT 25""")
def mean_tfidf_terms(spark, d):
    docs = t(spark, d, "documents")
    n = docs.count()
    return rounded(M.mean_tfidf(M.tfidf(M.terms(docs, "doc_id", "text"), "doc_id", n, 5, 0.8), n, 25))


@query(f"""WITH p AS (SELECT lang, term, sum(tf)::BIGINT AS n FROM {TERMS} GROUP BY ALL), w AS (SELECT lang, sum(n) AS words FROM p GROUP BY 1), m AS (SELECT avg(words) AS m FROM w), f AS (SELECT term, sum(n) AS f FROM p GROUP BY 1 HAVING sum(n) >= 2),
s AS (SELECT lang, term, n / words * ln(1 + m / f) AS weight FROM p JOIN f USING (term) JOIN w USING (lang), m)
SELECT lang, term, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def class_tfidf_terms(spark, d):
    return rounded(M.class_tfidf(M.terms(t(spark, d, "documents"), "lang", "text"), "lang", 10, 2))


@query(f"WITH n AS (SELECT training_key, min(topic) AS tp FROM {ACT} WHERE topic < 12 GROUP BY 1) SELECT coalesce(tp, -1) AS topic, count(*) AS count FROM {ACT} a LEFT JOIN n USING (training_key) GROUP BY 1")
def topic_table(spark, d):
    a = activity(spark, d)
    trained = a.where("topic < 12").groupBy("training_key").agg(F.min("topic").alias("topic"))
    return M.topic_table(M.inherit_topic(a.drop("topic"), trained, "training_key", "topic"), "topic")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY value DESC, record_key) AS n FROM {ACT}), s AS (SELECT *, CASE WHEN n <= 3 THEN 'representative' ELSE 'random' END AS part FROM r)
SELECT topic, record_key, part FROM s QUALIFY part = 'representative' OR row_number() OVER (PARTITION BY topic, part ORDER BY md5('42:' || record_key), record_key) <= 5""")
def review_packet_rows(spark, d):
    return M.review_packet(activity(spark, d), "topic", "record_key", "value").select("topic", "record_key", "part")


@query(f"SELECT topic, theme, CASE WHEN topic = -1 THEN 'noise is mapped' WHEN topic > 21 THEN 'unknown group' ELSE 'no theme' END AS problem FROM (VALUES (-1, 'a'), (3, ''), (99, 'b')) v(topic, theme) WHERE topic IN (SELECT topic FROM {ACT}) OR topic = 99")
def mapping_problems(spark, d):
    m = spark.createDataFrame([(-1, "a"), (3, ""), (99, "b"), (4, "ok")], "topic int, theme string")
    return M.mapping_problems(m, activity(spark, d), "topic", "theme")


@query()
def linkage_study(spark, d):
    return rounded(clustering.linkage_study(M.centroids(t(spark, d, "embeddings"), "label", "embedding"), "label", "centroid", k=4))


@query()
def centroid_groups(spark, d):
    return clustering.group_centroids(M.centroids(t(spark, d, "embeddings"), "label", "embedding"), "label", "centroid", 4)


@query(r"SELECT count(*) AS texts, count(*) FILTER (n > 256) AS cut, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, CAST(max(n) AS INT) AS longest FROM (SELECT len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS n FROM documents)")
def truncation_audit(spark, d):
    return M.truncation_audit(t(spark, d, "documents"), "text", 256)


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) WHERE term NOT IN ('the', 'of', 'und') GROUP BY ALL")
def dtm_terms(spark, d):
    return M.dtm_terms(t(spark, d, "documents"), "doc_id", "text", ["the", "of", "und", "and"], ["and"])


@query("""SELECT doc_id, 'row without vector' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'vector without row' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def alignment_problems(spark, d):
    return M.alignment_problems(t(spark, d, "documents").select("doc_id"), t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""WITH l AS (SELECT quality AS a1, 1 - toxic AS a2, CAST(doc_id % 3 > 0 AS INT) AS strict, CAST(doc_id % 2 AS INT) AS loose FROM labels), x AS (SELECT unnest(['a1', 'a1', 'a2', 'a2']) AS annotator, unnest(['strict', 'loose', 'strict', 'loose']) AS policy, unnest([a1, a1, a2, a2]) AS g, unnest([strict, loose, strict, loose]) AS p FROM l),
c AS (SELECT annotator, policy, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g = 0 AND p = 1) AS fp, count(*) FILTER (g = 1 AND p = 0) AS fn, count(*) FILTER (g = 0 AND p = 0) AS tn FROM x GROUP BY ALL)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def policy_grid(spark, d):
    l = t(spark, d, "labels").select(F.col("quality").alias("a1"), (1 - F.col("toxic")).alias("a2"), (F.col("doc_id") % 3 > 0).cast("int").alias("strict"), (F.col("doc_id") % 2).cast("int").alias("loose"))  # noqa: E741
    return rounded(K.policy_grid(l, ["a1", "a2"], ["strict", "loose"]))


@query()
def density_topics(spark, d):
    """All vectors, grouped by density."""
    return rounded(density.topics(t(spark, d, "embeddings"), "vec_id", "embedding", 20, 10))


@query()
def anchored_topics(spark, d):
    """The topic of every document by its words, with two anchored groups of words."""
    _, docs = corex.anchored_topics(t(spark, d, "documents"), "doc_id", "text", ["the", "of"], topics=6, anchors=[["und", "der"], ["que", "los"]], rounds=10)
    return rounded(docs.select(F.col("doc").alias("doc_id"), "topic", F.array_max("p").alias("most")))


@query()
def anchored_topic_words(spark, d):
    """The ten words that tell most about each of those topics."""
    words, _ = corex.anchored_topics(t(spark, d, "documents"), "doc_id", "text", ["the", "of"], topics=6, anchors=[["und", "der"], ["que", "los"]], rounds=10)
    return rounded(words)


@query()
def reduced_topics(spark, d):
    """The documents' sources as topics, merged while their words are alike."""
    docs = t(spark, d, "documents").select(F.regexp_extract("source", r"(\d+)", 1).try_cast("int").alias("topic"), "text")
    labels, _ = reduction.reduced_topics(M.terms(docs, "topic", "text").withColumnRenamed("tf", "n"), 0.8)
    return labels


@query()
def topic_discovery(spark, d):
    """All vectors, projected to five dimensions, then grouped by density."""
    return rounded(projection.discovered_topics(t(spark, d, "embeddings"), "vec_id", "embedding", rounds=8))


@query()
def projection_overlap(spark, d):
    """How many of each vector's nearest stay its nearest in two dimensions."""
    e = t(spark, d, "embeddings")
    return rounded(projection.neighbour_overlap(e, "vec_id", "embedding", projection.project(e, "vec_id", "embedding", components=2, rounds=8)))


@query()
def noise_clustering(spark, d):
    """All vectors by average and complete linkage, cut at three heights."""
    return agglomerate.clustering_study(t(spark, d, "embeddings"), "vec_id", "embedding")


# --- near-duplicates -------------------------------------------------------------------------------------------------------


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 20), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.85),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node AS key, min(root) AS family FROM r GROUP BY 1""")
def near_families(spark, d):
    return neardup.near_families(t(spark, d, "documents"), "doc_id", "text")


def nearest_sql(texts: str, limit: int) -> str:
    """SQL of every text's nearest other of its kind by character runs; ``texts`` selects (k, kind, text, who)."""
    return rf"""WITH src AS ({texts}),
w AS (SELECT k, kind, w, count(*) AS n FROM (SELECT k, kind, unnest(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS w FROM src) WHERE w <> '' GROUP BY ALL),
g AS (SELECT k, kind, n, len AS size, ' ' || w || ' ' AS p FROM w, (VALUES (3), (4), (5)) AS v(len)),
tf AS (SELECT k, kind, term, sum(n) AS tf FROM (SELECT k, kind, n, unnest([substring(p, i::INT, size) FOR i IN range(1, length(p) - size + 2)]) AS term FROM g WHERE length(p) >= size) GROUP BY ALL),
df AS (SELECT kind, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL HAVING count(*) >= 2),
voc AS (SELECT kind, term, ln((1.0 + docs) / (1.0 + df)) + 1.0 AS idf FROM (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY kind ORDER BY total DESC, term) <= {limit}) JOIN (SELECT kind, count(*) AS docs FROM src GROUP BY 1) USING (kind)),
raw AS (SELECT k, kind, term, tf * idf AS x FROM tf JOIN voc USING (kind, term)),
wt AS (SELECT k, kind, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM raw),
sim AS (SELECT a.kind, a.k AS a, b.k AS b, round(sum(a.x * b.x), 9) AS s FROM wt a JOIN wt b ON a.kind = b.kind AND a.term = b.term AND a.k < b.k GROUP BY ALL HAVING sum(a.x * b.x) >= 0.9 - 1e-9),
pairs AS (SELECT kind, a AS k, b AS o, s FROM sim UNION ALL SELECT kind, b, a, s FROM sim),
best AS (SELECT kind, k, o, s FROM pairs QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, o) = 1)
SELECT DISTINCT kind, least(k, o) AS a, greatest(k, o) AS b, round(s, 6) AS similarity FROM best"""


@query("SELECT a, b, similarity FROM (" + nearest_sql("SELECT doc_id AS k, '' AS kind, text FROM documents", 1 << 40) + ")")
def char_gram_neighbours(spark, d):
    return rounded(neardup.nearest_by_char_runs(t(spark, d, "documents"), "doc_id", "text", 0.9))


LONG_TURNS = r"SELECT conv_id || '-' || turn AS k, role AS kind, text FROM conversations WHERE length(text) >= 40 AND len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) >= 6"


@query("SELECT kind AS role, a, b, similarity, split_part(a, '-', 1) = split_part(b, '-', 1) AS same_author FROM (" + nearest_sql(LONG_TURNS, 50_000) + ")")
def near_duplicate_audit(spark, d):
    """Every turn of every conversation; a turn's author is its conversation."""
    c = t(spark, d, "conversations").withColumn("key", F.format_string("%d-%d", "conv_id", "turn"))
    return rounded(neardup.near_duplicate_audit(c, "key", "text", "role", "conv_id"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem), k AS (SELECT l_orderkey FROM r GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1)
SELECT l_orderkey, l_returnflag, l_linestatus FROM r JOIN k USING (l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus) = 1""")
def registration_dedup(spark, d):
    return D.registrations(t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey", ["l_returnflag"], ["l_linestatus"])[0]


@query("""WITH a AS (SELECT lang, doc_id, source, length(text) AS n, lower(text) AS k FROM documents), b AS (SELECT *, CASE WHEN coalesce(k, '') = '' THEN 'id:' || doc_id ELSE 't:' || k END AS u FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)
SELECT doc_id, lang, source FROM b QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, doc_id) = 1""")
def id_then_text_dedup(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", F.char_length("text").alias("n"), F.lower("text").alias("k"))
    return D.by_id_then_text(docs, "doc_id", "k", "n").select("doc_id", "lang", "source")


@query(f"SELECT record_key, (SELECT count(DISTINCT b.author) FROM {ACT} b WHERE b.training_key = a.training_key) > 1 AS is_cross_author_duplicate FROM {ACT} a")
def cross_author_flag(spark, d):
    return D.cross_author_flag(activity(spark, d), "author", "training_key").select("record_key", "is_cross_author_duplicate")


@query(f"""SELECT platform, week, count(*) AS records, count(DISTINCT thread_id) AS threads, count(DISTINCT nullif(trim(author), '')) AS authors, count(*) FILTER (topic = -1) AS noise, count(*) FILTER (value > 50) AS large,
 round(count(*) FILTER (topic = -1) / count(*), 6) AS noise_share, round(count(*) FILTER (value > 50) / count(*), 6) AS large_share FROM {ACT} GROUP BY ALL""")
def weekly_activity_panel(spark, d):
    return rounded(A.weekly_panel(activity(spark, d), ["platform", "week"], "thread_id", "author", {"noise": F.col("topic") == -1, "large": F.col("value") > 50}))


@query("""WITH w AS (SELECT CAST(unnest(generate_series(DATE '2023-12-04', DATE '2024-03-25', INTERVAL 7 DAY)) AS DATE) AS week), p AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, avg(value) AS v FROM events GROUP BY 1)
SELECT week, coalesce(n, 0) AS n, round(v, 6) AS v FROM w LEFT JOIN p USING (week)""")
def empty_bins(spark, d):
    e = t(spark, d, "events").withColumn("week", C.week_start("ts"))
    return rounded(A.filled_bins(e, "week", C.calendar(spark, "2023-12-04", "2024-03-25"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"), zero=("n",)))


@query("""WITH g AS (SELECT o_orderpriority AS area, min(o_orderdate) + INTERVAL 1 YEAR AS since, min(o_orderdate) + INTERVAL 2 YEAR AS until FROM orders GROUP BY 1)
SELECT area, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM g JOIN orders ON o_orderpriority = area AND o_orderdate >= since AND o_orderdate < until GROUP BY 1""")
def per_group_filter(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("area"), "o_orderdate", "o_totalprice")
    first = o.groupBy("area").agg(F.min("o_orderdate").alias("a")).select("area", F.expr("a + interval 1 year").alias("since"), F.expr("a + interval 2 year").alias("until"))
    return A.per_group_filter(first, o, "area", "since", "until", "o_orderdate", F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value")).select("area", "n", "value")


@query("SELECT nullif(author, '') AS author, count(*) AS n FROM " + ACT + " GROUP BY 1")
def group_with_null_key(spark, d):
    return activity(spark, d).groupBy(F.when(F.col("author") != "", F.col("author")).alias("author")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT platform, week, count(*) AS n, sum(value) AS v FROM {ACT} GROUP BY ALL)
SELECT platform, week, 'n' AS "column", n::DOUBLE AS "left", n + 1.0::DOUBLE AS "right" FROM w WHERE week = DATE '2024-01-15'
UNION ALL SELECT platform, week, NULL, 1.0::DOUBLE, NULL FROM w WHERE week = DATE '2024-01-08' AND platform = 'x'""")
def numeric_verifier(spark, d):
    """A stored panel with one week's count spoiled and one row lost: just those are found."""
    p = activity(spark, d).groupBy("platform", "week").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    stored = p.withColumn("n", F.when(F.col("week") == "2024-01-15", F.col("n") + 1).otherwise(F.col("n"))).where("not (week = '2024-01-08' and platform = 'x')")
    return A.numeric_differences(p, stored, ["platform", "week"])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS shown, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'other' END AS coarse, contains(lower(o_orderpriority), 'urgent') AS urgent, contains(lower(o_orderpriority), 'low') AS low FROM orders""")
def label_maps(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", R.mapped_label("o_orderstatus", {"F": "finished", "O": "open"}).alias("shown"), R.mapped_label("o_orderstatus", {"F": "finished"}, "other").alias("coarse"), R.contains_class("o_orderpriority", "URGENT").alias("urgent"), R.contains_class("o_orderpriority", "low").alias("low"))


@query("SELECT annotator, doc_id, CAST(row_number() OVER (PARTITION BY annotator ORDER BY md5(annotator || ':' || doc_id), doc_id) AS INT) AS place FROM labels CROSS JOIN (SELECT unnest(['a1', 'a2']) AS annotator)")
def annotator_packets(spark, d):
    """Each annotator's rows as a packet numbers them."""
    out = None
    for a in ("a1", "a2"):
        p = W.row_index(t(spark, d, "labels").select("doc_id", F.conv(F.substring(Q.draw("doc_id", a), 1, 12), 16, 10).cast("long").alias("h"), Q.draw("doc_id", a).alias("k")), ["h", "k", "doc_id"], "place").select(F.lit(a).alias("annotator"), "doc_id", (F.col("place") + 1).cast("int").alias("place"))
        out = p if out is None else out.unionByName(p)
    return out


@query("""WITH r AS (SELECT event_type, user_id, value, concat('s', user_id % 3) AS stream FROM events)
SELECT user_id, round(max(value), 6) AS value, CASE WHEN user_id % 3 = 0 THEN 's0' ELSE 's1' END AS source_label, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS event_type FROM r GROUP BY 1""")
def merged_streams(spark, d):
    e = t(spark, d, "events").select("user_id", "value", "event_type", F.concat(F.lit("s"), F.col("user_id") % 3).alias("stream"))
    return rounded(D.merge_streams(e, "user_id", "value", "stream", "event_type", ("s0", "s1")).select("user_id", "value", "source_label", "event_type"))


@query(f"""SELECT record_key, CASE WHEN author = '' THEN false ELSE row_number() OVER (PARTITION BY author, training_key ORDER BY ts, record_key) > 1 END AS is_same_author_exact_text_repeat FROM {ACT}""")
def same_author_repeats(spark, d):
    return D.same_author_repeat(activity(spark, d), "author", "training_key", "ts", "record_key").select("record_key", "is_same_author_exact_text_repeat")


@query("SELECT sha256(lower(text)) AS family, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, min_by(doc_id, doc_id) AS example FROM documents GROUP BY 1 HAVING count(*) >= 2")
def duplicate_groups(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang", F.sha2(F.lower("text").cast("binary"), 256).alias("family"))
    return D.duplicate_groups(docs, "family", {"sources": "source", "langs": "lang"}, "doc_id", "doc_id")


# --- text functions -----------------------------------------------------------------------------------------------------------

KEYWORDS = ["the", "and", "of the", "und", "der", "que", "les"]


@query(r"""WITH u AS (SELECT doc_id, text, regexp_replace(lower(text), 'https?://\S+|www\.\S+', ' ', 'g') AS l FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(l, '[@#]', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS text_key, md5(trim(regexp_replace(regexp_replace(l, '[^a-z0-9\s\-_/+.%]', ' ', 'g'), '\s+', ' ', 'g'))) AS match_key,
 substr(sha256(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))), 1, 24) AS family, CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS BIGINT) AS words FROM u""")
def text_keys(spark, d):
    h = lambda c: F.md5(c.cast("binary"))
    return t(spark, d, "documents").select("doc_id", h(T.text_key("text")).alias("text_key"), h(T.match_key("text")).alias("match_key"), T.family("text").alias("family"), T.space_words("text").alias("words"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_\\pM]){k}($|[^\\pL\\pN_\\pM])') THEN '{k}' END" for k in KEYWORDS if " " not in k and k != "of the") + r"""], lambda x: x IS NOT NULL))), '|') AS hits FROM documents""")
def bounded_keywords(spark, d):
    words = [k for k in KEYWORDS if " " not in k]
    return t(spark, d, "documents").select("doc_id", F.array_join(T.bounded_hits("text", words), "|").alias("hits"))


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', ' ', 'g'), '[^a-z0-9\s\-_/+.%]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN contains(k, '{w}') THEN '{w}' END" for w in KEYWORDS) + r"""], lambda x: x IS NOT NULL), '|') AS hits FROM k""")
def substring_keywords(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(T.substring_hits("text", KEYWORDS), "|").alias("hits"))


@query()
def text_rules(spark, d):
    c = t(spark, d, "conversations").withColumn("kind", F.when(F.col("role") == "assistant", R.REDDIT_COMMENT).otherwise("reddit_post"))
    sure, unsure = R.promotion(*R.cues("text").values())
    return c.select(
        "conv_id", "turn", sure.alias("promotion"), unsure.alias("ambiguous"), R.contact_only("text", "kind").alias("contact_only"), R.reaction_only("text", "kind").alias("reaction_only"), R.low_information("text", "kind").alias("low_information"),
        R.extra_contact_variant("text", "kind").alias("extra_contact"), R.short_contact_comment("text", "kind").alias("short_contact"), R.explicit_offer("text").alias("offer"), R.triage("text", F.lit(""), "role").alias("triage"),
        R.spam_without_domain("text").alias("spam"), R.long_or_domain("text").alias("long_or_domain"), R.domain_listing_keep("text")["keep"].alias("keep"), T.repeated_filler("text").alias("filler"), R.district("text", [("the", "T"), ("und", "U")]).alias("district"),
    )


#: Endings that give the invented turns something for the rules to find, by conversation.
ENDINGS = [
    " For sale: 2BR apartment, AED 900k, brand new. DM me", " market report: prices fell, AED 900 a sqft, studio and 1br vacant", " tenancy and ejari questions, whatsapp me", " bitcoin airdrop, hiring now",
    " we are offering our inventory, for rent, fully furnished", " thanks", "",
]
SPOKEN = "(SELECT conv_id, turn, role, concat(coalesce(text, ''), CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS)) + " ELSE '' END) AS said FROM conversations)"


def spoken(spark, d):
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.pmod("conv_id", F.lit(7)) + 1).cast("int"))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.coalesce(ending, F.lit(""))).alias("said"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _phrase_sql(words: list[str]) -> str:
    import re

    return r"regexp_matches(said, '(?i)(^|[^\pL\pN_\pM])(?:" + "|".join(re.escape(w).replace("'", "''").replace(r"\ ", " ").replace(r"\-", "-") for w in words) + r")($|[^\pL\pN_\pM])')"


def _count_sql(words: list[str], key: str) -> str:
    return f"len(list_filter({_quoted(list(dict.fromkeys(words)))}, lambda w: contains({key}, w)))"


@query(rf"""WITH s AS {SPOKEN}, l AS (SELECT *, regexp_replace(lower(said), 'https?://\S+|www\.\S+', ' ', 'g') AS u FROM s),
k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(u, '[@#]', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS tk, trim(regexp_replace(regexp_replace(u, '[^a-z0-9\s\-_/+.%]', ' ', 'g'), '\s+', ' ', 'g')) AS mk FROM l),
f AS (SELECT conv_id, turn, {_phrase_sql(L.DOMAIN_TERMS)} AS target, {_phrase_sql(L.CONTACT)} AS contact, {_phrase_sql(L.LISTING)} AS listing, regexp_matches(said, '(?i){L.SPEC}') AS spec, regexp_matches(said, '(?is){L.SOLICIT.replace("'", "''").replace(".{0,55}", "[^" + chr(92) + "n]{0,55}")}') AS solicit,
 {_count_sql(L.AGENT_LISTING_CUES, 'mk')} >= 2 AS listing_v0, {_count_sql(L.STRONG_LISTING_2, 'mk')} AS s2, {_count_sql(L.WEAK_LISTING, 'mk')} AS w2, {_count_sql(L.ANALYSIS_2, 'mk')} AS p2,
 {_count_sql(L.STRONG_LISTING_3, 'tk')} AS s3, {_count_sql(L.WEAK_LISTING, 'tk')} AS w3, {_count_sql(L.ANALYSIS_3, 'tk')} AS p3, {_count_sql(L.NOISE_CUES, 'mk')} AS noise, {_count_sql(L.DOMAIN_TERMS, 'mk')} AS domain FROM k)
SELECT conv_id, turn, target AS has_target_property_cue, contact AS contact_cue, listing AS listing_cue, spec AS spec_cue, solicit AS solicitation_cue, (contact AND (target OR spec OR listing)) OR (listing AND spec AND solicit) AS promotion,
 (contact OR listing OR solicit) AND NOT ((contact AND (target OR spec OR listing)) OR (listing AND spec AND solicit)) AS ambiguous, listing_v0,
 (s2 >= 2 OR (s2 >= 1 AND w2 >= 1) OR (w2 >= 4 AND p2 = 0)) AND NOT (p2 >= 1 AND s2 = 0) AS listing_v2, (s3 >= 2 OR (s3 >= 1 AND w3 >= 1) OR (w3 >= 4 AND p3 = 0)) AND NOT (p3 >= 1 AND s3 = 0) AS listing_v3,
 domain > 0 AND noise <= 1 AS domain_relevant, noise >= 2 AND NOT target AS spam FROM f""")
def discourse_flags(spark, d):
    s = spoken(spark, d)
    sure, unsure = R.promotion(*R.cues("said").values())
    return s.select(
        "conv_id", "turn", *[c.alias(n) for n, c in R.cues("said").items()], sure.alias("promotion"), unsure.alias("ambiguous"), R.agent_listing("said").alias("listing_v0"), R.refined_listing("said").alias("listing_v2"),
        R.refined_listing_with_contact("said", "said", F.lit("post")).alias("listing_v3"), R.domain_listing_keep("said")["is_domain_relevant"].alias("domain_relevant"), R.spam_without_domain("said").alias("spam"),
    )


@query(r"""WITH a AS (SELECT doc_id, text, '  @Ann_1 #Rent ' || text AS x FROM documents),
b AS (SELECT doc_id, x, regexp_replace(regexp_replace(lower(x), 'https?://\S+|www\.\S+', ' ', 'g'), '@[\pL\pN_\pM]+', ' ', 'g') AS m,
 string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', ' ', 'g'), '[@#]', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM a)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(m, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS dup_key, substr(sha256(trim(regexp_replace(replace(lower(nfc_normalize(x)), 'ß', 'ss'), '\s+', ' ', 'g'))), 1, 24) AS family,
 'u ' || doc_id AS author, 'p' || doc_id AS bare_id, len(list_filter(w, lambda v: v IN ('the', 'and', 'of', 'to', 'in', 'is', 'it', 'that', 'for', 'was', 'on', 'are', 'with', 'this', 'you', 'be', 'at', 'have', 'not', 'or'))) >= 0.1 * len(w) AS likely_english,
 substr(sha256(doc_id::VARCHAR), 1, 16) AS public_author FROM b""")
def text_cleaning(spark, d):
    a = t(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("  @Ann_1 #Rent "), "text").alias("x"))
    who, ident = F.concat(F.lit("  U "), F.col("doc_id")), F.concat(F.lit("t3_p"), F.col("doc_id"))
    return a.select("doc_id", F.md5(T.dup_key("x").cast("binary")).alias("dup_key"), T.family("x").alias("family"), T.author_key(who).alias("author"), T.strip_long_id(ident).alias("bare_id"), T.likely_english("text").alias("likely_english"), T.public_author("doc_id").alias("public_author"))


@query("SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '[؀-ۿऀ-ॿ一-鿿]') THEN 1 ELSE 0 END AS INT) AS non_latin, CASE WHEN lower(trim(lang)) <> '' THEN lower(trim(lang)) IN ('en', 'english') WHEN length(text) < 20 THEN true END AS english FROM documents")
def language_flags(spark, d):
    return t(spark, d, "documents").select("doc_id", F.col("text").rlike(L.NON_LATIN).cast("int").alias("non_latin"), T.english("lang", "text").alias("english"))


@query()
def corpus_flow(spark, d):
    c = t(spark, d, "conversations")
    root = F.format_string("%d-0", F.col("conv_id"))
    a = c.select(
        F.format_string("%d-%d", "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 3 == 0, "x").otherwise("reddit").alias("platform"),
        F.when(F.col("conv_id") % 3 == 0, "x_post").when(F.col("turn") == 0, "reddit_post").otherwise("reddit_comment").alias("post_type"),
        F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit(" rent in dubai marina")).otherwise(F.lit(""))).alias("raw_text"), F.concat(F.lit("u"), F.col("conv_id") % 50).alias("username"),
        F.timestamp_seconds(F.lit(1769904000) + F.col("conv_id") * 600 + F.col("turn")).alias("timestamp_utc"), root.alias("thread_id"), F.concat(F.lit("t1_"), F.format_string("%d-%d", F.col("conv_id"), F.col("turn") - 1)).alias("parent_id"), F.lit(True).alias("source_english"),
    )
    return corpus.build(a, "2026-01-01", "2026-05-01")[1]


# --- time and numbers -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS sunday, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(weekofyear(o_orderdate) AS INT) AS iso_week,
 strftime(o_orderdate, '%Y-%m') AS month_label, printf('%d-W%02d', isoyear(o_orderdate), weekofyear(o_orderdate)) AS iso_year_week FROM orders""")
def date_parts(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.week_start("o_orderdate").alias("week"), C.sunday_label("o_orderdate").alias("sunday"), *[c.alias(n) for n, c in C.date_parts("o_orderdate").items()])


@query("SELECT event_id, CAST(date_trunc('week', ts + INTERVAL 4 HOUR) AS DATE) AS week FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def window_filter_zone(spark, d):
    e = t(spark, d, "events")
    return e.where(C.in_window("ts", "2024-01-05", "2024-01-20")).select("event_id", C.week_start("ts", "Asia/Dubai").alias("week"))


@query("SELECT event_id, epoch_ms((((event_id + 1) * 4194304 * 1000) >> 22) + 1288834974657) AS at FROM events")
def snowflake_times(spark, d):
    return t(spark, d, "events").select("event_id", C.snowflake_time((F.col("event_id") + 1) * 4194304 * 1000).cast("timestamp_ntz").alias("at"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN '(0, 10]' WHEN l_quantity <= 30 THEN '(10, 30]' WHEN l_quantity <= 50 THEN '(30, 50]' END AS bin, l_quantity + 3 * l_discount + 2 * l_tax + 2 * l_linenumber AS score, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem""")
def scalar_numbers(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.bins("l_quantity", [0, 10, 30, 50]).alias("bin"), N.interaction(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")).alias("score"), N.ratio("l_extendedprice", "l_quantity").alias("unit_price"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS records, count(*) FILTER (value > 50) AS inside, round(count(*) FILTER (value > 50) / count(*), 6) AS share FROM events GROUP BY ALL")
def streaming_weekly_counts(spark, d):
    return rounded(weekly_counts(t(spark, d, "events"), "ts", ["event_type"], F.col("value") > 50))


@query("SELECT n_regionkey, round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def star_join_value(spark, d):
    o = t(spark, d, "orders").where(C.in_window("o_orderdate", "1996-01-01", "1998-01-01") & F.col("o_orderstatus").isin("F", "O"))
    j = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_regionkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n"))


