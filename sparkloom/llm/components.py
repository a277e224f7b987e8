"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges``; root is the smallest node that it reaches.

    Large-star links each larger neighbour of a node to the smallest one around it; small-star does so for the
    smaller neighbours. Both only group by node with a min (combined before the shuffle) and join that one row back,
    so that a hub's rows can be split. Each round is a table in the shared folder; rounds grow with the logarithm of
    a component's diameter. Self loops and nulls are ignored; an empty table gives no rows.
    """
    cur = (
        edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    cur = durable(cur, "cc")
    before = _signature(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = durable(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        # each row of ``large`` has v < u: the smaller neighbours of u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = durable(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        discard(large)
        discard(cur)
        cur, after = nxt, _signature(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(cur.select(F.col("v"), F.col("v"))).distinct()
