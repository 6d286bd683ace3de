"""R2, R3 as a job that is triggered again and again: versioned statistics, flags, closed windows, late rows.

``EventMonitor`` keeps everything under one folder, so any session can go on with it:

=============  ==========================================================================================
statistics/    the statistics row, one folder a version; a version never changes
flags/         R2: flagged events, with the run and the version of the statistics they were judged by
late/          events of a run whose window was closed before the run, or that have no time; one folder a run
progress/      the latest event time of each run
windows/       R3: windows that the watermark has closed
=============  ==========================================================================================

``advance`` is one run: the newest statistics are read, new files of the source are flagged (one micro-batch), and the
flagged rows feed the window stream. Both streams go on from their checkpoints. A run that was cut off is finished by
the next call, before it looks at the source, with the rows and the watermark it had.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics.operators.stats import ColumnStats
from anomalytics.session import file_system, is_written, utc_session
from anomalytics.streaming import detection

STATISTICS = "version bigint, n bigint, mean double, std double, q1 double, q3 double"


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """N of every committed folder ``name``=N, ascending."""
    store, jpath = file_system(spark, folder)
    if not store.exists(jpath):
        return []
    found = [status.getPath() for status in store.listStatus(jpath) if status.isDirectory()]
    named = [p for p in found if p.getName().startswith(f"{name}=") and is_written(spark, p.toString())]
    return sorted(int(p.getName().split("=")[1]) for p in named)


class StatisticsTable:
    """Versions 1, 2, ... of the statistics row that events are judged by. One publisher at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def publish(self, stats: ColumnStats) -> int:
        version = max(_numbers(self.spark, self.folder, "version"), default=0) + 1
        row = [(version, stats.n, stats.mean, stats.std, stats.q1, stats.q3)]
        self.spark.createDataFrame(row, STATISTICS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/version={version}")
        return version

    def read(self, version: int | None = None) -> tuple[int, ColumnStats]:
        """The newest version, or the one asked for. An error if there is none."""
        if version is None:
            version = max(_numbers(self.spark, self.folder, "version"), default=0)
            if not version:
                raise ValueError(f"no statistics under {self.folder}: publish a version first")
        row = self.spark.read.schema(STATISTICS).parquet(f"{self.folder}/version={version}").first()
        return version, ColumnStats(n=row["n"], mean=row["mean"], std=row["std"], q1=row["q1"], q3=row["q3"])


class EventMonitor:
    """Flags and window rates of the events that arrive as parquet files in ``source``.

    A window counts the outliers by the flags that its events got, so windows that span a new version of the
    statistics keep the judgement of the time. Repeated rows count repeatedly. Without new files a run changes nothing.
    One ``advance`` at a time.
    """

    def __init__(self, spark: SparkSession, source: str, folder: str, window: str = "1 day", delay: str = "1 hour"):
        self.spark, self.source, self.folder = spark, source, folder.rstrip("/")
        self.window, self.delay = window, delay
        self.statistics = StatisticsTable(spark, f"{self.folder}/statistics")

    def _at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    # ---- one run --------------------------------------------------------------------------
    def advance(self) -> int:
        """Take what has arrived; returns the number of the last finished run (0: none yet)."""
        with utc_session(self.spark):          # windows are wall-clock days; see utc_session
            flagged = self._flagged_runs()
            done = _numbers(self.spark, self._at("progress"), "run")
            if flagged and (not done or flagged[-1] > done[-1]):
                self._count(flagged[-1])       # a run that was cut off after its events were flagged
            self._flag(max(flagged, default=0) + 1)
            for run in self._flagged_runs():
                if run > max(flagged, default=0):
                    self._count(run)
            return max(_numbers(self.spark, self._at("progress"), "run"), default=0)

    def _flagged_runs(self) -> list[int]:
        if not self._has_flags():
            return []
        rows = self.spark.read.parquet(self._at("flags")).select("run").distinct().collect()   # one row a run
        return sorted(r["run"] for r in rows)

    def _has_flags(self) -> bool:
        store, jpath = file_system(self.spark, self._at("flags/_spark_metadata"))
        return store.exists(jpath) and bool(store.listStatus(jpath))

    def _flag(self, run: int) -> None:
        """R2: new files -> flags, judged by the newest statistics, in one micro-batch."""
        version, stats = self.statistics.read()
        schema = self.spark.read.parquet(self.source).schema
        events = self.spark.readStream.schema(schema).parquet(self.source)
        flags = detection.flag_events(events, stats).select(
            "*", F.lit(version).cast("bigint").alias("stats_version"), F.lit(run).cast("int").alias("run"))
        q = (flags.writeStream.format("parquet").partitionBy("run").option("path", self._at("flags"))
             .option("checkpointLocation", self._at("checkpoints/flags")).trigger(availableNow=True).start())
        q.awaitTermination()

    def _count(self, run: int) -> None:
        """Late rows of a run aside, the others into their windows. Repeating it changes nothing."""
        rows = self.spark.read.parquet(self._at("flags")).where(F.col("run") == run)
        if not is_written(self.spark, self._at(f"late/run={run}")):     # before the window stream sees the run
            border = self._watermark(run)
            no_time = F.col("ts").isNull()
            late = rows.where(no_time)
            if border is not None:
                limit = F.lit(str(border)).cast("timestamp_ntz")
                older = rows.where(F.col("ts") < limit)                 # pushed to the scan: most files hold none
                ended = older.withColumn("w", F.window("ts", self.window)).where(F.col("w.end") <= limit)
                late = late.unionByName(ended.drop("w"))
            late.drop("run").write.mode("overwrite").parquet(self._at(f"late/run={run}"))
        flagged = self.spark.readStream.schema(rows.schema).parquet(self._at("flags"))
        windows = detection.flagged_rates(flagged, self.window, self.delay)
        detection.append_run(windows, self._at("windows"), self._at("checkpoints/windows"))
        rows.agg(F.max("ts").alias("latest")).coalesce(1).write.mode("overwrite").parquet(self._at(f"progress/run={run}"))

    def _watermark(self, run: int) -> dt.datetime | None:
        """The latest event time before ``run`` less the delay: windows that end by then are closed."""
        runs = [r for r in _numbers(self.spark, self._at("progress"), "run") if r < run]
        if not runs:
            return None
        seen = self.spark.read.parquet(*[self._at(f"progress/run={r}") for r in runs])
        return seen.select((F.max("latest") - F.expr(f"INTERVAL {self.delay}")).alias("border")).first()[0]

    # ---- results --------------------------------------------------------------------------
    def flags(self) -> DataFrame:
        return self.spark.read.parquet(self._at("flags"))

    def late(self) -> DataFrame:
        return self.spark.read.parquet(self._at("late"))

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(self._at("windows"))

    def still_open(self) -> DataFrame:
        """Windows that later events may still change, from the state of the window stream."""
        with utc_session(self.spark):
            return detection.open_windows(self.spark, self._at("checkpoints/windows"))

    def windows(self) -> DataFrame:
        """Every window so far; for a finite input, after its last run: every window."""
        return self.closed().unionByName(self.still_open())
