"""Readers and writers over files: dispatch by extension, fallbacks, padding to a schema, resumable jobs, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at a path of any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, or an error that names them all."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Parquet, CSV, JSON, JSON lines, ORC or text by the path's extension; a chosen list of columns prunes the scan."""
    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    r = spark.read.options(**options)
    if schema is not None:
        r = r.schema(schema)
    if kind == "csv":
        base = {"header": "true", "multiLine": "true", "escape": '"'}
        df = r.options(**{k: v for k, v in base.items() if k not in options}).csv(path)
    elif kind in ("jsonl", "ndjson"):
        df = r.json(path)
    elif kind == "json":
        df = r.option("multiLine", "true").json(path)
    elif kind in ("parquet", "orc"):
        df = getattr(r, kind)(path)
    elif kind == "txt":
        df = r.text(path)
    else:
        raise ValueError(f"no reader for {path!r}")
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """Write by the path's extension; refuses to overwrite unless told to."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    w = df.write.mode(mode).options(**options)
    if kind == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        w.json(path)
    elif kind in ("parquet", "orc"):
        getattr(w, kind)(path)
    else:
        raise ValueError(f"no writer for {path!r}")


def read_encoded_csv(spark: SparkSession, path: str, required: list[str], encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), separators: tuple[str, ...] = (",", ";", "\t", "|")) -> DataFrame:
    """The first encoding without replacement characters and the first separator whose header has ``required``."""
    for e in encodings:
        for s in separators:
            df = read(spark, path, encoding=e, sep=s)
            if set(required) <= set(df.columns):
                if e == encodings[-1] or not df.where(" or ".join(f"contains(coalesce(cast(`{c}` as string), ''), '�')" for c in df.columns)).limit(1).count():
                    return df
                break
    raise ValueError(f"no encoding and separator of {path!r} give columns {required}")


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that exists, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def coalesced(df: DataFrame, candidates: list[str], default: str | None = None) -> Column:
    """The first of the candidate columns that a table has, by row; ``default`` where all are null."""
    got = [F.col(f"`{c}`").cast("string") for c in candidates if c in df.columns]
    return F.coalesce(*got, F.lit(default)) if got else F.lit(default).cast("string")


def to_schema(df: DataFrame, schema: StructType, drop: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the fields of ``schema``, cast, missing ones null; ``drop`` names are left out even if present."""
    have = set(df.columns) - set(drop)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def consolidate(spark: SparkSession, glob: str, key: list[str], order: str, source: str = "source_file") -> DataFrame:
    """All files of a pattern with their name, one row a key: the last by ``order``."""
    from ..operators.windows import best

    df = spark.read.option("mergeSchema", "true").parquet(glob).withColumn(source, F.element_at(F.split(F.input_file_name(), "/"), -1))
    return best(df, key, F.desc_nulls_last(order), F.asc(source))


def resumable(spark: SparkSession, path: str, build, cap: int | None = None) -> tuple[DataFrame, dict]:
    """(rows, telemetry): what stands at ``path`` is used, else ``build()`` is written there; an empty result keeps its schema."""
    fresh = not exists(spark, f"{path.rstrip('/')}/_SUCCESS")
    if fresh:
        build().write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    n = df.count()
    return df, {"path": path, "rows": n, "built": fresh, "cap_hit": cap is not None and n >= cap}


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def hash_problems(spark: SparkSession, expected: dict[str, str]) -> DataFrame:
    """Frozen inputs that are missing or changed: (path, problem); empty when all hashes agree."""
    have = [p for p in expected if exists(spark, p)]
    missing = [(p, "missing") for p in expected if p not in have]
    out = spark.createDataFrame(missing, "path string, problem string")
    if have:
        want = spark.createDataFrame([(p.rsplit("/", 1)[-1], expected[p]) for p in have], "name string, want string")
        got = file_hashes(spark, have).withColumn("name", F.element_at(F.split("path", "/"), -1))
        out = out.unionByName(got.join(want, "name").where("sha256 <> want").select("path", F.lit("changed").alias("problem")))
    return out


def config_rows(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """A nested JSON configuration {name: {field: [items]}} as rows (name, item)."""
    raw = spark.read.option("wholetext", "true").text(path)
    m = F.from_json("value", f"map<string,struct<{field}:array<string>>>")
    return raw.select(F.explode(m).alias("name", "v")).select("name", F.explode(F.col("v")[field]).alias(item))


def objects(df: DataFrame, json: str, schema: str) -> DataFrame:
    """JSON objects as rows; fields that are absent or of another type are null."""
    return df.select(F.from_json(json, schema).alias("o")).select("o.*")


def query_manifest(streams: DataFrame, cohorts: DataFrame, limit: int = 512) -> DataFrame:
    """Every (stream, sub-query) in every cohort, with its length and whether it fits."""
    q = streams.crossJoin(cohorts)  # two short lists
    text = F.format_string("(%s) since:%s until:%s", F.col("subquery"), F.col("start"), F.col("stop"))
    return q.withColumn("query", text).withColumn("query_length", F.char_length("query")).withColumn("fits", F.col("query_length") <= limit)
