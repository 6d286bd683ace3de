"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics.session import discard, ensure_checkpoint_dir, materialize, scratch_path, ship_package

__all__ = ["ASCII_SPACE", "discard", "ensure_checkpoint_dir", "free_worker", "held_out", "kept_in_worker", "long_rows", "lower_ascii", "materialize",
           "prepare", "read_table", "release", "scratch_path"]

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
BYTES_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
READER_SETTING, READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 4
#: the white space of the query contracts: \x20 and \x09-\x0D
ASCII_SPACE = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Ready the session for an operator: the shared folder is set, functions travel inside the task closures.

    Texts and shingle sets are long, so the Arrow batches that tasks exchange with Python are kept to BATCH_ROWS rows;
    with the default of 10,000 a few batches in flight take hundreds of MB of an executor. Rows may be MB long, so that
    batches end at BATCH_BYTES too (Spark's default is 64 MB).
    """
    ensure_checkpoint_dir(spark)
    if int(spark.conf.get(BATCH_SETTING)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if to_bytes(spark.conf.get(BYTES_SETTING)) > BATCH_BYTES:
        spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))
    ship_package(spark)
    return spark


@contextmanager
def long_rows(spark: SparkSession):
    """Run a block that reads tables with rows of MBs: Spark's parquet reader holds READER_ROWS of them at a time, instead
    of 4,096, which are all rows of a task."""
    before = spark.conf.get(READER_SETTING)
    spark.conf.set(READER_SETTING, str(READER_ROWS))
    try:
        yield spark
    finally:
        spark.conf.set(READER_SETTING, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects its garbage, which
    a long job on a driver with memory to spare may put off until the executors' disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


KEPT = "_kept_in_this_worker"


def kept_in_worker(key: str, make):
    """What ``make`` gives, made once in a Python worker: a worker runs many tasks, whose functions are unpickled anew.

    Only the last key's value is kept. A worker outlives its query, so tasks of the other operators call ``free_worker``.
    """
    store = sys.modules.setdefault(KEPT, types.ModuleType(KEPT))
    if getattr(store, "key", None) != key:
        store.key, store.value = key, make()
    return store.value


def free_worker() -> None:
    """Give back what tasks of an earlier step kept in this Python worker (an encoder with full caches is 230 MB)."""
    store = sys.modules.pop(KEPT, None)
    if store is not None:
        store.__dict__.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):       # no glibc
            pass


def held_out(id_col: str | Column, folds: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is never held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
