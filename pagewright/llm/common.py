"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column | str, n: int = 5) -> Column:
    """crc32 of the decimal id, modulo n. A null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and all run in one process, a local one; on a cluster that is an error."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.gettempdir() + "/pagewright-checkpoints"


def row_ids(docs: DataFrame, name: str = "uid") -> DataFrame:
    """docs with a number for each row that is the same whenever docs is read again.

    docs must be a stored table (or cached): then rows are numbered by scan partition and place. How files
    are dealt to partitions would follow the number of cores in use, which falls when an executor is lost
    between two scans; it is pinned for the session at its first value.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs.withColumn(name, F.monotonically_increasing_id())


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow batches have that many rows at most: texts are large, and a batch is held by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return free memory to the system: workers outlive tasks, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker gives free memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group, after which its worker gives free memory back."""

    def wrapped(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            give_back()

    return wrapped


def tidied_groups(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two groups, after which its worker gives free memory back."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return wrapped


def by_size(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batch with about `limit` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, base + limit)) - at)
        yield batch.slice(at, n)
        at += n


def stash(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    Bytes that nothing makes smaller, such as hashes, are better written with compression "uncompressed": that takes no buffers.

    The application's tables go when its driver ends, or earlier by sweep().
    """
    spark = df.sparkSession
    top, fs = stash_dir(spark)
    path = f"{top.toString()}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    fs.deleteOnExit(top)
    return spark.read.schema(df.schema).parquet(path)


def stash_dir(spark: SparkSession) -> tuple:
    """The folder of this application's tables, and its file system (both of the JVM)."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pagewright-stash/{spark.sparkContext.applicationId}")
    return top, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession, *stashed: DataFrame) -> None:
    """Delete tables of stash() that nothing reads any more."""
    top, fs = stash_dir(spark)
    for df in stashed:
        for folder in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.toString()}/{folder}"), True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a query's shuffle files when the query ends, not when the driver's memory is next collected."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def sweep(spark: SparkSession) -> None:
    """Delete what stash() wrote in this application."""
    top, fs = stash_dir(spark)
    fs.delete(top, True)
