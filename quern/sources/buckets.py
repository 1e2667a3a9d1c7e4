"""A table of rows by key that is changed bucket by bucket, in versions.

Below one root, ``version=X/rows/bucket=N`` has the rows whose key hashes to N as version X left
them, and ``version=X/manifest`` names for each bucket the version that has it. A change
rewrites the buckets of its keys into a new version and refers to all others where they are.
Only when its files are complete does the new version become the current one, by claiming the
next number; a writer that fails, or that began from a version which is no longer the current
one, changes nothing that readers see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import small_side


class Lost(RuntimeError):
    """Another change came first; read again and retry."""


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, root: str) -> list[str]:
    path, fs = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The highest number that was claimed, and the version that stands."""
    claims, stands = [0], (0, None)
    for name in _names(spark, root):
        kind, _, rest = name.partition("-")
        if kind == "claim":
            claims.append(int(rest))
        elif kind == "current":
            number, version = rest.split("-")
            stands = max(stands, (int(number), version))
    return max(claims), stands[1]


def _make_current(spark: SparkSession, root: str, version: str, number: int) -> None:
    path, fs = _fs(spark, root)
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    # Creating a file that must not be there is one step; so is a rename to a name of one's own.
    if not fs.createNewFile(Path(path, f"claim-{number:012d}")):
        raise Lost("another change came first")
    if not fs.createNewFile(Path(path, f"current-{number:012d}-{version}")):
        raise Lost("another change came first")


def manifest(spark: SparkSession, root: str, version: str | None = None) -> dict[int, str]:
    """The version of each bucket that has rows; one entry a bucket."""
    version = version or _current(spark, root)[1]
    if version is None:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version string").parquet(f"{root}/version={version}/manifest").collect()}


def _read(spark: SparkSession, root: str, parts: dict[int, str], like: DataFrame) -> DataFrame:
    if not parts:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(*[f"{root}/version={v}/rows/bucket={b}" for b, v in sorted(parts.items())])


def read_buckets(spark: SparkSession, root: str, schema: str, version: str | None = None) -> DataFrame:
    """All rows of a version, the current one if none is named. Versions stay readable until vacuum()."""
    return _read(spark, root, manifest(spark, root, version), spark.createDataFrame([], schema))


def upsert(root: str, rows: DataFrame, key: str, buckets: int, removed: DataFrame | None = None) -> dict[str, object]:
    """Replaces all rows of the keys in ``rows`` by these, and takes out those of the keys in ``removed``.

    Returns the new version, and how many buckets were written and kept. Rows without a key are left
    out. Only the buckets of the keys are read and written; that their number
    (at most ``buckets``) is the same for all changes of a root is the caller's to see to.
    """
    spark = rows.sparkSession
    number, base = _current(spark, root)
    before = manifest(spark, root, base) if base else {}
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")
    rows = rows.where(F.col(f"`{key}`").isNotNull())
    keys = rows.select(F.col(f"`{key}`"))
    if removed is not None:
        keys = keys.unionByName(removed.select(F.col(f"`{key}`").cast(rows.schema[key].dataType)))
    keys = keys.where(F.col(f"`{key}`").isNotNull()).distinct()
    touched = sorted(r["b"] for r in keys.select(bucket.alias("b")).distinct().collect())
    old = _read(spark, root, {b: before[b] for b in touched if b in before}, rows)
    # Counted: up to a million keys are sent to the old rows, which are then exchanged once, to be written.
    kept = old.join(small_side(keys, 1_000_000), key, "left_anti").select(*rows.columns)
    version = uuid.uuid4().hex
    written = kept.unionByName(rows).withColumn("bucket", bucket)
    written.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/version={version}/rows")
    there = [int(n.split("=")[1]) for n in _names(spark, f"{root}/version={version}/rows") if n.startswith("bucket=")]
    after = {b: v for b, v in before.items() if b not in set(touched)} | dict.fromkeys(there, version)
    spark.createDataFrame(sorted(after.items()), "bucket int, version string").coalesce(1).write.parquet(f"{root}/version={version}/manifest")
    _make_current(spark, root, version, number + 1)
    return {"version": version, "written": len(there), "kept": len(after) - len(there)}


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes the versions that the current one does not refer to; the caller sees to it that no reader or writer uses them."""
    _, version = _current(spark, root)
    used = {version, *manifest(spark, root, version).values()} if version else set()
    path, fs = _fs(spark, root)
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    gone = [n.split("=")[1] for n in _names(spark, root) if n.startswith("version=") and n.split("=")[1] not in used]
    for v in gone:
        fs.delete(Path(path, f"version={v}"), True)
    return gone
