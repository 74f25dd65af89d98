"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a (long key) relation up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000

#: Bytes of an Arrow batch of texts, and Spark's own setting, which they replace.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"

#: Words are maximal runs of anything but these ASCII characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one only where all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage.

    See ``shared_folder`` for the folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    done = df.checkpoint(eager=True)
    # A checkpoint keeps the constraints and partitionings of its plan, whose numbers double with every
    # joined round of a loop: the rows alone are taken over. Spark deletes the files with the last reference.
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches kept to BATCH_BYTES where they have Spark's default size.

    Workers and the buffers beside the executor's heap hold whole batches, which long texts make large. The setting
    stays with the session: what an operator returns is computed later. Results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) == DEFAULT_BATCH:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def release() -> None:
    """Gives memory that this worker no longer uses back to the system: idle workers wait beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, which releases its memory when it is done."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return out


def keep_ids(df: DataFrame, ids: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the distinct ``ids``; n: their measured number.

    Up to BROADCAST_ROWS ids travel to the executors, so that the wide side is not shuffled; more ids
    are joined by a shuffle.
    """
    ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    return df.join(ids, column, "left_semi")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hex_of(column: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column, 256)
