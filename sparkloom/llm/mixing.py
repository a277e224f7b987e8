"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Slot i of the mix sits at frac(i * golden ratio) on the cumulative target weights, which names its source; the slot's
rank among its source's slots names a block of equally many words of that source's shuffled documents, round and round.
Low discrepancy keeps every stretch of the mix near the target weights; a source's last slot is cut, or the missing ones
are appended, so that its words add up to its target.

At scale: text is read once, for its number of words. No window spans a source: documents are ordered within
(source, hash bucket) and slots within (source, chunk), with running totals over the small per-bucket sums. Slots meet
sources by cells of the unit interval and documents meet slots by (source, block): equality joins of small rows with no
hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

GOLDEN = 0.6180339887498949
#: Slots to aim at, and the most words in a block.
SLOTS, MOST_BLOCK = 1 << 17, 4096
CELLS, CHUNK = 1 << 12, 1 << 16
#: Rows of a group of like rows that one task writes out at a time.
COPIES = 1 << 14


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Rows (source, sid, source_size, target): one a source, so every window here runs over the list of sources.

    Sources by code point, nulls last, take the weights in turn. The targets share all words; a target stops at ``cap``
    times its source's size. The common level is the first, by size over weight, at which the rest fits the rest.
    """
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(by_name))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("full", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("full") / F.col("w"))
    everything = Window.orderBy("one").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("one", F.lit(1))
    s = s.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("level_here", (F.col("all_words") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(everything))
    target = F.when(F.col("all_words") > 0, F.least("full", F.coalesce(F.col("level") * F.col("w"), F.col("full")))).otherwise(F.lit(0.0))
    return s.select("source", "sid", "source_size", target.alias("target"))


def schedule(sources: DataFrame, total: int, block: int, cap: float = 3.0) -> DataFrame:
    """Rows (slot, sid, rank, block, words, part): the mix in order. ``rank`` counts a source's slots from 0.

    A source's due is its target to the word. The slot of its last rank takes only the first ``words`` of its block where
    less is due (``part``). What the golden ratio deals a source beyond its due is void; ranks that it deals too few take the
    void slots and then follow after all others. So every source gives its due, however small it is beside a block.
    """
    spark, deal = sources.sparkSession, -(-total // block)
    in_turn = Window.orderBy("sid")
    upto = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sources.where("source_size > 0 and target > 0").withColumn("hi_", F.sum("target").over(upto) / F.lit(float(total)))
    cut = cut.withColumn("lo_", F.coalesce(F.lag("hi_").over(in_turn), F.lit(0.0)))
    cut = cut.withColumn("hi_", F.when(F.lead("sid").over(in_turn).isNull(), F.lit(2.0)).otherwise(F.col("hi_")))
    cut = cut.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(float(block))).cast("long")).withColumn("due", F.round("target").cast("long"))
    cut = cut.withColumn("rest", F.col("due") % F.col("source_size")).withColumn("end_blocks", F.ceil(F.col("rest") / F.lit(float(block))).cast("long"))
    cut = cut.withColumn("ranks", F.expr("due div source_size") * F.col("blocks") + F.col("end_blocks"))
    due = durable(cut.select("sid", "lo_", "hi_", "source_size", "blocks", "rest", "end_blocks", "ranks"), "mix-due")
    cells = due.select("sid", "lo_", "hi_", "ranks", F.explode(F.sequence(F.least(F.floor(F.col("lo_") * CELLS), F.lit(CELLS - 1)), F.least(F.floor(F.col("hi_") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = spark.range(deal).select(F.col("id").alias("slot"), F.expr(f"id * {GOLDEN!r}D - floor(id * {GOLDEN!r}D)").alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    named = slots.join(cells, "cell").where("u >= lo_ and u < hi_").select("slot", "chunk", "sid", "ranks")
    sums = durable(named.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n")), "mix-chunks")
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = lambda sums: sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    last = based(sums).join(due.select("sid", "ranks"), "sid").where("base + n > ranks").select("sid", "chunk", "base", "ranks")
    void = named.select("slot", "chunk", "sid").join(last, ["sid", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).where("rank >= ranks")
    void = durable(void.select("slot", (F.row_number().over(Window.orderBy("slot")) - 1).cast("long").alias("at")), "mix-void")  # a few a source, as what is late
    late = due.join(sums.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("few", F.greatest(F.lit(0), F.col("ranks") - F.coalesce("got", F.lit(0))))
    late = late.withColumn("at", F.sum("few").over(upto) - F.col("few")).where("few > 0").select("sid", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("few") - 1)).alias("at"))
    late = late.join(void, "at", "left").select(F.coalesce("slot", F.col("at") + deal).alias("slot"), "sid")
    named = durable(named.select("slot", "sid").join(void, "slot", "left_anti").unionByName(late), "mix-slots").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    base = based(named.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))).drop("n")
    ranked = named.withColumn("r", F.row_number().over(inside) - 1).join(base, ["sid", "chunk"])
    placed = ranked.select("slot", "sid", (F.col("base") + F.col("r")).alias("rank")).join(due.drop("lo_", "hi_"), "sid")
    placed = placed.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("part", (F.col("rank") == F.col("ranks") - 1) & (F.col("rest") > 0))
    whole = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    return placed.select("slot", "sid", "rank", "block", F.when(F.col("part"), F.col("rest") - (F.col("end_blocks") - 1) * block).otherwise(whole).alias("words"), "part")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, slots), one for each row of ``docs``.

    taken counts the words that the mix takes from the row, repeats counted, at most ``cap`` times its size. slots are the
    places in the mix where the row begins, one each time it is taken, in order; the last may take its first words only.
    A source's blocks wear evenly: the first few of its shuffled order are taken once more than the rest. Null texts have size 0
    and give nothing; null sources are one source, last; repeated rows are rows of their own; an empty table gives no
    rows; other columns are not read. Rows alike in source, id and size are laid out as one group, so that no id, null
    ones included, can fill a window.
    """
    sized = durable(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.col(source_col).cast("string").alias("source"),
        ),
        "mix-sizes",
    )
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total, block = int(total), max(1, min(MOST_BLOCK, int(total) // SLOTS))
    sources = durable(source_targets(sized, weights, cap).coalesce(1), "mix-sources")
    named = _name(sized, sources)
    groups = durable(named.where("size > 0").groupBy("sid", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    most = groups.agg(F.max("n")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(2, rows / 2048), 16)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = groups.withColumn("all_", F.col("n") * F.col("size")).withColumn("k", key).withColumn("bucket", F.substring("k", 1, digits))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("all_").alias("s"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = keyed.withColumn("upto", F.sum("all_").over(inside)).join(sums, ["sid", "bucket"])
    laid = laid.select("doc_id", "size", "sid", "n", (F.col("base") + F.col("upto") - F.col("all_")).alias("start"))
    if most > COPIES:  # large groups are dealt out in chunks before their rows are written one by one
        laid = laid.withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition(max(1, -(-rows // (64 * COPIES))), F.xxhash64("sid", "start", "from_"))
        laid = laid.select("doc_id", "size", "sid", F.least(F.col("n") - F.col("from_"), F.lit(COPIES)).alias("n"), (F.col("start") + F.col("from_") * F.col("size")).alias("start"))
    if most > 1:
        laid = laid.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("start") + F.col("i") * F.col("size"))
    taken = _by_slots(laid.select("doc_id", "size", "sid", "start"), sources, total, block, cap)
    none = named.where("size = 0").select("sid", F.lit(-1).cast("long").alias("start"), "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("slots"))
    out = taken.unionByName(none).join(sources.select("sid", "source_size", "target"), "sid")
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "slots")


def _by_slots(laid: DataFrame, sources: DataFrame, total: int, block: int, cap: float) -> DataFrame:
    """Rows (sid, start, doc_id, size, taken, slots): documents cut into blocks, each taken once for every slot that names it.

    A block is named ``cap`` + 1 times at most, so its slots are a short list; a document begins in those of its first block."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = laid.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    uses = schedule(sources, total, block, cap).groupBy("sid", "block").agg(F.count_if(~F.col("part")).alias("uses"), F.max(F.when(F.col("part"), F.col("words"))).alias("first_words"), F.sort_array(F.collect_list("slot")).alias("named"))
    taken = cut.withColumn("begin", begin).withColumn("end", end).join(uses, ["sid", "block"], "left")
    words = (F.col("end") - F.col("begin")) * F.coalesce("uses", F.lit(0)) + F.greatest(F.lit(0), F.least("end", F.coalesce("first_words", F.lit(0))) - F.col("begin"))
    named = F.coalesce("named", F.array().cast("array<long>"))
    begins = F.when(F.col("begin") >= F.coalesce("first_words", F.lit(block)), F.slice(named, 1, F.size(named) - 1)).otherwise(named)  # the last slot ends before it
    return taken.groupBy("sid", "start", "doc_id", "size").agg(F.sum(words).alias("taken"), F.max(F.when(F.col("block") == first, begins)).alias("slots"))


def _name(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with its source's number, nulls matched too."""
    s = sources.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"), "sid")
    d = sized.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    return d.join(s, ["_null", "_name"]).select("doc_id", "size", "sid")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix's rows in its order, with the columns of ``docs``: a document stands wherever a slot begins to take it.

    Where a source's last slot ends within a document, its last row has just the first words, joined by single spaces.
    Documents without words give nothing. Every source gives its target to the word: where ids repeat or are missing,
    rows are numbered and written first, so that each has a share of its own, whatever its id or source.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # whole rows ride in one column, so that no name can clash
    rows, known, ids = docs.select(F.count(F.lit(1)), F.count(id_col), F.count_distinct(F.col(id_col).cast("long"))).first()
    if rows == known == ids:
        held = docs.select(doc, F.col(id_col).cast("long").alias("row"))
    else:
        held = durable(docs.select(doc, F.monotonically_increasing_id().alias("row")), "mix-rows")
    taken = mix(held.select("row", F.col("doc").getField(text_col).alias("text"), F.col("doc").getField(source_col).alias("source")), id_col="row", **options)
    taken = taken.where("taken > 0").select(F.col("doc_id").alias("row_"), "size", "taken", F.posexplode("slots").alias("copy", "slot"))
    left = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).cast("int")
    rows = held.join(taken, F.col("row") == F.col("row_")).withColumn("left", left).orderBy("slot", "row")
    body, is_whole = F.col("doc").getField(text_col), F.col("left") == F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(F.col("left"), F.lit(1))), " ")
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.when(is_whole, body).otherwise(part).alias(c))
        elif c == "n_chars":
            out.append(F.when(is_whole, F.col("doc").getField(c)).otherwise(F.char_length(part).cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col("doc").getField(c).alias(c))
    return rows.select(*out)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents, and the slot where it first takes each."""
    taken = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
t AS (SELECT sum(size)::BIGINT AS total FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio, (SELECT total FROM t) AS total,
   (SELECT total FROM t) - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS words_left,
   sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS w_left FROM s1),
s3 AS (SELECT *, max(CASE WHEN words_left / w_left <= ratio THEN words_left / w_left END) OVER () AS level FROM s2),
s4 AS (SELECT source, sid, source_size, least(cap, level * w) AS target, total FROM s3),
e AS (SELECT *, round(target)::BIGINT AS due, greatest(1, least(4096, total // 131072)) AS block FROM s4),
g AS (SELECT source, sid, source_size, target, block, total, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN due % source_size ELSE 0 END AS rest FROM e),
z AS (SELECT *, whole * ceil(source_size / block)::BIGINT + ceil(rest / block)::BIGINT AS ranks, sum(target) OVER (ORDER BY sid) / total AS hi FROM g WHERE source_size > 0 AND target > 0),
q AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0.0) AS lo, CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN 2.0 ELSE hi END AS up FROM z),
deal AS (SELECT ceil((SELECT total FROM t) / (SELECT max(block) FROM e))::BIGINT AS n),
u AS (SELECT i AS slot, i * {GOLDEN!r}::DOUBLE - floor(i * {GOLDEN!r}::DOUBLE) AS u FROM (SELECT unnest(range((SELECT n FROM deal))) AS i)),
named AS (SELECT slot, sid, ranks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS r FROM u JOIN q ON u.u >= q.lo AND u.u < q.up),
void AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS place FROM named WHERE r >= ranks),
few AS (SELECT q.sid, greatest(0, q.ranks - coalesce(got, 0)) AS few FROM q LEFT JOIN (SELECT sid, count(*) AS got FROM named GROUP BY sid) c ON c.sid = q.sid),
late AS (SELECT sid, unnest(range(few)) + coalesce(sum(few) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM few),
slots AS (SELECT slot, sid FROM named WHERE r < ranks UNION ALL SELECT coalesce(slot, place + (SELECT n FROM deal)), sid FROM late LEFT JOIN void USING (place)),
ranked AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS r FROM slots),
p AS (SELECT doc_id, size, source, sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
SELECT doc_id, p.size, g.source_size, g.target, CAST(whole * p.size + greatest(0, least(p.size, rest - start)) AS BIGINT) AS taken,
 CASE WHEN p.size > 0 AND (whole > 0 OR rest > start) THEN ranked.slot END AS first_slot
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN ranked ON ranked.sid = g.sid AND ranked.r = start // block
"""
