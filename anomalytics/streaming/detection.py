"""Flag arriving events against stored statistics; windowed rates.

The statistics (mean, sample std, IQR fences of ``value``) are computed in
batch and applied to the stream as literals — the stream holds no state for
R2. R3 groups by 1-day event-time windows with a watermark, so state for a
window is dropped once the watermark passes its end and rows later than the
watermark are dropped instead of reopening closed windows.

Sources are files (parquet) read as a stream; sinks are parquet files with a
checkpoint location under the session's shared checkpoint folder, so a query
restarted after a failure resumes where it stopped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.operators.stats import ColumnStats, column_stats, iqr_flag, unguarded_zscore
from anomalytics.session import file_system, scratch_path, utc_session

HIGH_VALUE = "HIGH_VALUE"
LOW_VALUE = "LOW_VALUE"


@dataclass(frozen=True)
class StreamRun:
    output: DataFrame
    path: str
    checkpoint: str


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream: ``name`` under ``folder`` is a parquet file or a folder of part files."""
    path = f"{folder.rstrip('/')}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    store, jpath = file_system(spark, path)
    if store.getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)       # a single file: its folder, that name only


def flag_events(events: DataFrame, stats: ColumnStats) -> DataFrame:
    """R2 row logic (works on a stream or a batch frame)."""
    k = config.IQR_MULTIPLIER
    high = F.col("value") > F.lit(stats.q3) + F.lit(k) * (F.lit(stats.q3) - F.lit(stats.q1))
    low = F.col("value") < F.lit(stats.q1) - F.lit(k) * (F.lit(stats.q3) - F.lit(stats.q1))
    z = unguarded_zscore("value", stats.mean, stats.std)
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.round(z, 6).alias("value_zscore"),
        F.when(high, F.lit(HIGH_VALUE)).when(low, F.lit(LOW_VALUE)).otherwise(F.lit(config.LABEL_NORMAL)).alias("value_flag"),
        F.coalesce(iqr_flag("value", stats.q1, stats.q3, k), F.lit(False)).alias("is_outlier"),
    )


def _run(df: DataFrame, name: str, mode: str = "append") -> StreamRun:
    out = scratch_path(df.sparkSession, f"{name}-out")
    return append_run(df, out, scratch_path(df.sparkSession, f"{name}-ckpt"), mode)


def append_run(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamRun:
    """One availableNow run of a stream into parquet; goes on from the checkpoint if there is one."""
    q = (
        df.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return StreamRun(df.sparkSession.read.schema(df.schema).parquet(out), out, checkpoint)


def stream_flags(spark: SparkSession, folder: str, stats: ColumnStats | None = None) -> StreamRun:
    """R2: every event flagged against batch statistics, written by an availableNow stream."""
    if stats is None:
        stats = column_stats(spark.read.parquet(f"{folder}/events.parquet"), "value")
    with utc_session(spark):
        return _run(flag_events(event_stream(spark, folder), stats), "stream-flags")


def windowed_rates(events: DataFrame, stats: ColumnStats, window: str = "1 day",
                   delay: str = "1 hour") -> DataFrame:
    """R3 logic: per (event-time window, event_type): events, outliers, outlier rate.

    Build it inside ``utc_session`` (as ``stream_window_rates`` does) so that
    windows are wall-clock days whatever the caller's session zone is.
    """
    is_outlier = F.coalesce(iqr_flag("value", stats.q1, stats.q3, config.IQR_MULTIPLIER), F.lit(False))
    return flagged_rates(events.withColumn("is_outlier", is_outlier), window, delay)


def flagged_rates(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """R3 logic over events that carry ``is_outlier``."""
    t = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    g = (
        t.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("is_outlier").cast("bigint")).alias("n_outliers"))
    )
    return _rate_columns(g)


def _rate_columns(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "event_type", "n_events", "n_outliers",
        (F.col("n_outliers").cast("double") * F.lit(100.0) / F.col("n_events").cast("double")).alias("outlier_rate"),
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """Windows of a ``windowed_rates`` stream that its watermark has not closed, from the state the stream keeps.

    None if the stream has had no batch yet. Call it inside ``utc_session`` and while the stream is not running; the
    rows are those of the last committed batch when they are read.
    """
    store, commits = file_system(spark, f"{checkpoint}/commits")
    if not store.exists(commits) or not store.listStatus(commits):
        return None
    state = spark.read.format("statestore").load(checkpoint)
    window_field = state.schema["key"].dataType.fieldNames()[0]
    return _rate_columns(state.select(
        F.col("key").getField(window_field).alias("w"), F.col("key.event_type"),
        F.col("value.count").alias("n_events"), F.col("value.sum").alias("n_outliers"),   # the buffers' names
    ))


def stream_window_rates(spark: SparkSession, folder: str, stats: ColumnStats | None = None,
                        window: str = "1 day", delay: str = "1 hour") -> StreamRun:
    """Every window of the finite input.

    The stream (append mode) writes the windows that its watermark has closed. When the input ends, the windows that
    are still open are taken from the stream's state; the events are read by the stream alone.
    """
    if stats is None:
        stats = column_stats(spark.read.parquet(f"{folder}/events.parquet"), "value")
    with utc_session(spark):   # windows are wall-clock days; see utc_session
        closed = _run(windowed_rates(event_stream(spark, folder), stats, window, delay), "stream-windows")
        last = open_windows(spark, closed.checkpoint)
        if last is None:
            return closed
        path = scratch_path(spark, "open-windows")
        last.write.parquet(path)
    return StreamRun(closed.output.unionByName(spark.read.parquet(path)), closed.path, closed.checkpoint)
