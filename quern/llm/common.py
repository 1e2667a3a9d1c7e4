"""What several operators share: reading tables, folds, cutting lineage, samples."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all contracts define it, for Java regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Only in local mode, where it
    may be unset, a temporary folder takes its place; on a cluster it must be set,
    since executors don't see each other's folders.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return df.checkpoint(eager=True)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def release(df: DataFrame) -> None:
    """Deletes the files of a cut() that nothing reads any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "Scan ExistingRDD" or plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what Python makes of texts stays small.

    Spark itself ends a batch at 64 MB, or after one longer row.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces_by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have at most ``most`` bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, end - at)
            at, before = end, int(ends[end - 1])


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(parts)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_unit(seed: str, id_col: str | Column) -> Column:
    """A fixed pseudo-random whole number in [0, 2**32) for an id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), c.cast("string"))), 1, 8), 16, 10).cast("long")


def sample_limit(size: int, total: int) -> int:
    """Below which hash_unit() a sample of ``size`` out of ``total`` ids is found, with room for chance and for counts 10 % off."""
    return min(1 << 32, int((1.2 * size + 10 * size**0.5 + 50) / max(1, total) * (1 << 32)) + 1)


def sampled(rows: DataFrame, id_col: str, size: int, seed: str) -> DataFrame:
    """At most ``size`` rows, in a fixed pseudo-random order of the id.

    The order is total up to equal rows, so reruns and retries agree. The rows are
    counted first, and only those whose hash is low enough for the sample are
    ordered, so what the last task merges does not grow with the table.
    """
    low = rows.where(hash_unit(seed, id_col) < sample_limit(size, rows.count()))
    return low.orderBy(hash_unit(seed, id_col), F.col(id_col)).limit(size)
