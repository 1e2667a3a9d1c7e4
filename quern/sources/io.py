"""Scans and sinks: JSON, snapshots, registries, the chunk index, logs. All through Spark's file systems."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.policy import redact

REGISTRY = T.StructType([T.StructField("sources", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "source_type", "scheme_name", "authority_level", "retrieval_timestamp", "refresh_frequency")])))])
ALLOWLIST = T.StructType(
    [T.StructField("mode", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("allow_domain_only", "allow_subpaths", "allow_query_variants", "allow_redirect_to_unlisted_url")]
    + [T.StructField("approved_urls", T.ArrayType(T.StringType())), T.StructField("rejection_policy", T.MapType(T.StringType(), T.StringType()))]
)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict: a missing path raises; rows that do not parse are kept apart in _corrupt_record."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path, multiLine=True)


def read_json_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant: a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, day: Column, private: tuple[str, ...] = ("query",)) -> None:
    """One JSON row per processed query, without personal data in ``private`` columns, partitioned by day, so that old days can be dropped whole."""
    clean = df.withColumns({c: redact(F.col(f"`{c}`")) for c in private if c in df.columns})
    clean.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def expire_log(spark: SparkSession, path: str, first_day: str) -> list[str]:
    """Deletes the log's days before ``first_day`` (yyyy-MM-dd) and returns them."""
    root, fs = _files(spark, path)
    old = sorted(d for s in fs.listStatus(root) if (d := s.getPath().getName().removeprefix("day=")) < first_day and s.getPath().getName().startswith("day="))
    for d in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"day={d}"), True)
    return old


def registry(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """One row per source; the fallback where the file is missing or has no sources."""
    rows = read_json_or_empty(spark, path, REGISTRY).select(F.explode("sources").alias("s")).select("s.*")
    return fallback if fallback is not None and rows.isEmpty() else rows


def approved_urls(spark: SparkSession, path: str) -> DataFrame:
    return read_json_or_empty(spark, path, ALLOWLIST).select(F.explode("approved_urls").alias("url")).distinct()


def entity_urls(registry_rows: DataFrame) -> DataFrame:
    """key (lower-cased name), url."""
    return registry_rows.select(F.lower("scheme_name").alias("key"), "url").distinct()


def gate_urls(urls: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allowed rows and rejected rows, by exact match only."""
    listed = approved.select("url").distinct()
    return urls.join(listed, "url", "left_semi"), urls.join(listed, "url", "left_anti")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """path, html: files as text, without bytes that are not UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("html"))


def scalar_metadata(df: DataFrame, keep: tuple[str, ...] = ("chunk_id", "text", "embedding"), defaults: tuple[str, ...] = ("scheme", "doc_type", "source_url")) -> DataFrame:
    """Metadata as strings (nested values as JSON), filter keys never null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in keep:
            c = F.to_json(c) if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)) else c.cast("string")
            c = F.coalesce(c, F.lit("")) if f.name in defaults else c
        out.append(c.alias(f.name))
    return df.select(*out)


def write_index(df: DataFrame, path: str, partition: str = "scheme") -> DataFrame:
    """The chunk index as Parquet partitioned by its filter key; returns the index as read."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def index_report(chunks: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("scheme", "doc_type", "source_url")) -> DataFrame:
    """One row: totals, dimension, and whether a filter on each key finds rows."""
    m = index.agg(F.count(F.lit(1)).alias("total_indexed_chunks"), F.max(F.size("embedding")).alias("embedding_dim"), *[F.coalesce(F.max(F.col(k) != ""), F.lit(False)).alias(f"_{k}") for k in keys])
    n = chunks.agg(F.count(F.lit(1)).alias("total_input_chunks"))
    return n.crossJoin(F.broadcast(m)).select("total_input_chunks", "total_indexed_chunks", "embedding_dim", F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"_{k}"))]).alias("filter_checks"))


def find(index: DataFrame, key: str, value: str, limit: int = 3) -> DataFrame:
    return index.where(F.col(key) == value).limit(limit)


def publish(df: DataFrame, root: str) -> str:
    """Writes a new version beside the old ones and returns its path; readers switch by path, so a failed run changes nothing."""
    path = f"{root}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def switch(spark: SparkSession, root: str, version_path: str) -> None:
    """Makes a published version the current one: a pointer is written beside the old one and takes its place."""
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    name, (folder, fs) = version_path.rsplit("/", 1)[-1], _files(spark, root)
    n = max((int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("current-")), default=-1) + 1
    # A new name each time: a rename to a fresh name is one step on every file system, and the highest number counts.
    written = Path(folder, f"_next-{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray(name, "utf-8"))
    out.close()
    if not fs.rename(written, Path(folder, f"current-{n:012d}")):
        raise RuntimeError("another switch came first")


def current(spark: SparkSession, root: str) -> str | None:
    """The path of the current version."""
    folder, fs = _files(spark, root)
    pointers = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("current-"))
    if not pointers:
        return None
    return f"{root}/{spark.read.text(f'{root}/{pointers[-1]}').first()[0]}"
