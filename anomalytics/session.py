"""Session helpers: defaults, checkpoint folder, materialisation."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "anomalytics") -> SparkSession:
    """Session for tests and local runs. On a cluster, use the cluster's session.

    ``spark.python.sql.dataFrameDebugging.enabled=false`` turns off PySpark's
    Python call-site capture for error messages: with it on, every column
    function (``F.col``, ``F.sum`` ...) makes extra JVM calls and an import
    attempt, about 10 ms each here, which made building a report's plan on the
    driver cost 0.2-0.4 s. Results are unaffected; only error messages lose the
    Python line. PySpark reads the setting once per process, so it must be set
    before the first DataFrame call.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is only
    set here when the session has none, and only in local mode (tests): a
    machine-local temporary folder would leave written tables on whichever
    executor wrote them, so a cluster session without the setting is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_local(spark):
            raise ValueError(
                "set spark.checkpoint.dir to a folder every executor can reach (written tables and stream "
                "checkpoints are kept there); a machine-local temporary folder does not work on a cluster"
            )
        conf_dir = tempfile.mkdtemp(prefix="anomalytics-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def is_local(spark: SparkSession) -> bool:
    """True for a single-JVM session (master ``local``, ``local[n]``, ``local[*]``, ``local[n,m]``)."""
    return spark.sparkContext.master.startswith("local")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (for sinks and stream state)."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where one derived table feeds several passes (statistics, flags,
    reports, forest). Like ``checkpoint()`` it cuts the lineage and survives a
    lost executor (the files are on shared storage), and unlike a row
    checkpoint the result is columnar: later passes read only the columns they
    use, with filters pushed into the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` once all that was to be read of them has been written elsewhere: a long job would
    keep all its steps on the shared disk otherwise. What was derived from them and not written cannot be read any more."""
    for table in tables:
        store, path = file_system(table.sparkSession, table._written_to)
        store.delete(path, True)


TASK_BYTES = 16 << 20   # of input files or shuffled data in a task under ``bounded_tasks``


@contextmanager
def bounded_tasks(df: DataFrame):
    """Run a block with tasks whose size does not grow with the inputs of ``df``.

    Spark's defaults give a scan up to 128 MB of files a task, whatever part of the columns it reads, and a shuffle the
    session's fixed number of partitions, so on larger inputs the aggregations and sorts of a task outgrow its memory
    and spill. Inside the block a scan task reads ``TASK_BYTES`` of files at most, and the number of shuffle partitions
    follows from the bytes that the plan's scans hold; AQE joins partitions that turn out to be smaller. The session's
    settings are kept where they are finer, and are restored afterwards. Only task sizes change, no rows.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    wanted = -(-sum(n for n in sizes if n < 1 << 60) // TASK_BYTES)         # a table of unknown size counts as 2^63 - 1
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan, target = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {key: spark.conf.get(key, None) for key in (scan, target, first)}
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key in (scan, target):
        spark.conf.set(key, str(min(TASK_BYTES, to_bytes(spark.conf.get(key)))))
    spark.conf.set(first, str(max(fixed, int(before[first] or 0), wanted)))
    try:
        yield df
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as Hadoop has it (any scheme that Spark reads)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def is_written(spark: SparkSession, path: str) -> bool:
    """True if a write to ``path`` has been committed (Spark's _SUCCESS file is there)."""
    store, jpath = file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return store.exists(jpath)


@contextmanager
def utc_session(spark: SparkSession):
    """Run a block with the session time zone set to UTC, then restore the caller's zone.

    Event times are wall-clock TIMESTAMP_NTZ values, but a stream's watermark
    needs TIMESTAMP, and NTZ -> TIMESTAMP casts and 1-day windows follow the
    session zone. Inside the block the cast is exact (no daylight-saving gaps or
    overlaps). A started stream runs on its own clone of the session, and the
    time zone of a cast is fixed when the plan is analysed, so restoring the
    zone afterwards changes neither a running stream nor a built DataFrame.
    """
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, "UTC")
    try:
        yield spark
    finally:
        spark.conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Make this package's functions usable in Python workers.

    pandas functions run on executors. The package is registered with
    PySpark's cloudpickle to be pickled by value, so the functions travel
    inside the task closure: nothing is written to any disk and executors need
    no copy of the package.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["anomalytics"])
