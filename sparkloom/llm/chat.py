"""Chat formatting by prefix-target expansion; DataFrame functions only.

Every assistant turn becomes an example: the turns before it are context, its own text alone is trainable. Examples of
a conversation share their prefixes, so the stored form is one rendered text a conversation plus, for each example,
where its context ends and its target begins and ends; it grows with the conversation and not with its square.
``expand`` writes the examples out as rows of text where that is wanted.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` is doubled, ``<|``
becomes ``<\\|`` and, in roles, a line feed becomes ``<\\n``: no control string can appear, and three replacements undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column, role: bool = False) -> Column:
    """``c`` without control strings; in roles without line feeds too."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("<\\n")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    """What ``escape`` was given."""
    c = F.replace(c, F.lit("<\\n"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted, examples), one a conversation.

    examples: array of (segment, context_end, target_start, target_end), one for each ``trainable`` turn in order; the
    offsets are code points in ``formatted``, segment is the turn's place. Null texts and roles are empty; a
    conversation without trainable turns has no examples but is still rendered; turns stand by number (nulls first),
    role, text, and repeated rows all count; null ids are one conversation; other columns are not read. Only turns of
    one conversation meet in a task, by one shuffle on its id.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("body", escape(F.col("text"))).withColumn("head", head)
    rows = rows.withColumn("seg", F.row_number().over(in_order) - 1).withColumn("chars", F.char_length("head") + F.char_length("body") + F.lit(len(END)))
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("begin", F.sum("chars").over(upto) - F.col("chars"))
    part = F.struct(
        "seg", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == trainable).alias("train"),
        F.col("begin").alias("context_end"), (F.col("begin") + F.char_length("head")).alias("target_start"), (F.col("begin") + F.char_length("head") + F.char_length("body")).alias("target_end"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return conv.select(
        "conv_id",
        F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("formatted"),
        F.transform(F.filter("p", lambda x: x["train"]), lambda x: F.struct(x["seg"].alias("segment"), x["context_end"], x["target_start"], x["target_end"])).alias("examples"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, example, context, target): the examples written out, context and target as rendered."""
    rows = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    cut = lambda a, b: F.substring(F.col("formatted"), (a + 1).cast("int"), (b - a).cast("int"))
    return rows.select("conv_id", "example", cut(F.lit(0), F.col("e.target_start")).alias("context"), cut(F.col("e.target_start"), F.col("e.target_end")).alias("target"))


def turns_of(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, an array of (role, text) parsed from the rendered text and unescaped, and with ``segments``,
    the rendered turns without their end marks."""
    segs = formatted.withColumn("segments", F.split("formatted", r"<\|im_end\|>\n"))
    segs = segs.withColumn("segments", F.slice("segments", 1, F.size("segments") - 1))
    turn = lambda x: F.struct(unescape(F.substr(F.substring_index(x, "\n", 1), F.lit(len(START) + 1)), role=True).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"))
    return segs.withColumn("turns", F.transform("segments", turn))


def examples(parsed: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Rows (conv_id, *keep, example, context_chars, target): each example of what ``turns_of`` gave as a row of its own.

    target is the trainable text that the example's span cuts, unescaped; the context is the ``context_chars`` code points of
    the rendered text before it. A span is cut from its own segment, as a cut from the whole text would walk it from its
    beginning each time; a context that does not end where that segment begins is an error. A conversation without examples
    is one row with null example and target.
    """
    # how far an example's segment is from that of the one before it, for context_end to be held against
    chars = lambda a, b: F.aggregate(F.slice("segments", (a + 1).cast("int"), (b - a).cast("int")), F.lit(0).cast("long"), lambda n, x: n + F.char_length(x) + F.lit(len(END)))
    last = lambda i, field: F.when(i > 0, F.get("examples", i - 1)[field].cast("long")).otherwise(F.lit(0).cast("long"))
    follows = lambda e, i: e["context_end"] - last(i, "context_end") == chars(last(i, "segment"), e["segment"])
    rows = F.transform("examples", lambda e, i: F.struct(i.alias("example"), F.get("segments", e["segment"]).alias("turn"), follows(e, i).alias("follows"), e["context_end"].alias("from"), e["target_start"].alias("start"), e["target_end"].alias("end")))
    out = parsed.select("conv_id", *keep, F.explode_outer(rows).alias("e"))
    span = F.substr(F.col("e.turn"), (F.col("e.start") - F.col("e.from") + 1).cast("int"), (F.col("e.end") - F.col("e.start")).cast("int"))
    wrong = F.raise_error(F.lit("a context does not end where its example's turn begins")).cast("string")
    return out.select("conv_id", *keep, "e.example", F.col("e.start").alias("context_chars"), F.when(F.col("e").isNull() | F.col("e.follows"), unescape(span)).otherwise(wrong).alias("target"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what is read back: the turns from the rendered text, the loss from the examples' rows.

    A conversation's rows meet where its one rendered text was made, without another shuffle.
    """
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = turns_of(formatted).select(
        "conv_id", "segments", "examples", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = ["n_turns", "turns_sha256", "formatted_chars"]
    rows = examples(read, whole).groupBy("conv_id").agg(*[F.first(c).alias(c) for c in whole], F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "target")))).alias("t"))
    loss = F.concat_ws("", F.transform("t", lambda t: t["target"]))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


ODD = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that is made of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return digests(format_conversations(turns.unionByName(odd)))


ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{ODD}'), (-1, 1, 'assistant', '{ODD}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
