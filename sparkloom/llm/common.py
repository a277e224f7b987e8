"""What the operators of this subpackage share: tables, folds, durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def as_text(c: str | Column) -> Column:
    """An id as text, for its way through Python workers: pandas would turn longs beside a null into doubles."""
    return (F.col(c) if isinstance(c, str) else c).cast("long").cast("string")


def as_long(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column that ``as_text`` made back as long."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one below the warehouse where it is unset.

    A warehouse on a local path is shared only where the master is local too; elsewhere this is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if at.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return at


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no recomputation.

    The files go when the application ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``durable`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], base: str) -> str:
    """``base``, with underscores appended until no column in ``taken`` has that name."""
    lower = {t.lower() for t in taken}
    while base.lower() in lower:
        base += "_"
    return base
