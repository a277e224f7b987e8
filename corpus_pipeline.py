"""From raw documents to packed training sequences: quality, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``docs``. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language, mixing, packing, quality, simhash
from sparkloom.llm.common import durable, free_name, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go; null and empty texts are scored as any other."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language that the machines agree on (score below 0.5) go.

    The machines are fitted on ``docs`` itself; null and empty texts have no letter; repeated rows are judged alike."""
    return language.keep_identified(docs, language.fit(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id.

    Null and empty texts are one group. Where a doc_id repeats or is missing, rows are told apart by a number of their own,
    so that rows of one id with different texts are documents in their own right; of rows that are alike one stays. Rows
    without a doc_id give way to those that have one. An empty table gives no rows.
    """
    rows, known, ids = docs.select(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows == known == ids:
        mark = free_name(docs.columns, "_keep")
        found = simhash.near_duplicates(docs)
        keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(mark))
        return docs.join(keep, F.col("doc_id") == F.col(mark), "left_semi")
    numbered = durable(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    found = simhash.near_duplicates(numbered.select("row", "doc.text"), id_col="row")
    order = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")), "row")
    keep = found.join(numbered.select("row", order.alias("o")), F.col("doc_id") == F.col("row")).groupBy("component_id").agg(F.min_by("row", "o").alias("row"))
    return numbered.join(keep.select("row"), "row", "left_semi").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; one that it takes in part comes with just those words.

    Every source gives its target to the word, however small it is beside the corpus. Documents without words give nothing;
    rows without a source are one source."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as ``packing.pack`` gives them; columns other than doc_id and text end here."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers, fingerprints and tokens are not SQL's to compute; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
