"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder below the warehouse where it is unset, which must not be a local path then
    unless the master is local too."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if at.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return at


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here. The files go when the application ends.

    Nothing reads the shuffles behind it any more, so their files go at once and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANED, was) if was is not None else spark.conf.unset(CLEANED)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``durable`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
