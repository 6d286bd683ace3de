"""Shared building blocks of the named queries: tables, enriched orders, flags.

A ``Workspace`` is built per (session, data folder); each accessor returns a
lazy DataFrame except the statistics, which are a few scalars computed once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from anomalytics.operators import detector, enrich, flags as flags_op, stats as stats_op
from pyspark.sql import functions as F
from anomalytics.plans.kept import KeptTables
from anomalytics.session import bounded_tasks, materialize
from anomalytics.sources.adapters import read_raw, testdata_tables


RESULT_TTL_SECONDS = 3600   # S8: processed results are kept for one hour


class Workspace:
    """Shared state of one input folder in one session.

    ``Workspace.get`` returns the same workspace for the same (session, folder)
    for ``RESULT_TTL_SECONDS`` (S8: the reference dashboard keeps its processed
    detector for an hour), so the written enriched table, the statistics and
    the fitted forest are computed once and every report reuses them. The
    inputs are read-only; ``Workspace(spark, folder)`` always starts fresh.

    With ``kept`` the enriched table is shared with other sessions, by the files of the input folder (``KeptTables``).
    """

    _kept: dict[tuple[str, int, str], tuple[float, "Workspace"]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, kept: KeptTables | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.kept = kept

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str, ttl: float = RESULT_TTL_SECONDS) -> "Workspace":
        import os
        import time

        key = (spark.sparkContext.applicationId, id(spark), os.path.abspath(sf_dir))
        hit = cls._kept.get(key)
        now = time.monotonic()
        if hit is not None and now - hit[0] < ttl:
            return hit[1]
        ws = cls(spark, sf_dir)
        cls._kept[key] = (now, ws)
        return ws

    @classmethod
    def forget(cls) -> None:
        cls._kept.clear()

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return testdata_tables(self.spark, self.sf_dir)

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enriched_orders(self.tables)

    @cached_property
    def enriched_table(self) -> DataFrame:
        """The enriched orders written once to the checkpoint folder.

        Statistics need two passes and the flag table a third; reading a
        written table is cheaper than redoing the joins each time, and it
        survives a lost executor (lineage is cut at the checkpoint).
        """
        with bounded_tasks(self.enriched):
            if self.kept is not None:
                return self.kept.get("enriched", [self.sf_dir], lambda: self.enriched)
            return materialize(self.enriched)

    @cached_property
    def stats(self) -> stats_op.GlobalStats:
        return stats_op.global_stats(self.enriched_table)

    @cached_property
    def flags(self) -> DataFrame:
        return flags_op.anomaly_flags(self.enriched_table, self.stats)

    @cached_property
    def features(self) -> DataFrame:
        """E7 detector rows: a filter and projection of the kept enriched table (no second pipeline)."""
        return enrich.features_from_enriched(self.enriched_table)

    @cached_property
    def detector_stats(self) -> stats_op.ColumnStats:
        """A7/A8 statistics of the detector's amount, taken from A1 without another pass.

        The detector rows are exactly the enriched rows with an amount, the rows
        A1 is computed over, with the same mean (exact sum / count), sample std
        and exact quartiles; a test checks the two agree with a direct
        ``column_stats`` of the detector rows.
        """
        s = self.stats
        return stats_op.ColumnStats(s.n, s.mean_amount, s.std_amount, s.q1, s.q3)

    @cached_property
    def detector_z(self) -> DataFrame:
        """Detector rows with A7/A8 and the z-score method (A9) as the model flag.

        ``is_anomaly_z`` stands in for the forest's flag wherever a report
        must be checked value by value against SQL.
        """
        df = detector.with_statistical_flags(self.features, stats=self.detector_stats)
        df = df.withColumn(Z_FLAG, stats_op.zscore_flag("amount_zscore"))
        return detector.with_anomaly_type(df, Z_FLAG, detector.IQR)

    @cached_property
    def default_filters(self) -> dict:
        """The dashboard's initial filter values (amount [min, p99], all dates), computed once.

        They depend only on the amount and the purchase time of the detector
        rows, which every detector variant (z-score or forest flag) shares.
        """
        from anomalytics.operators import dashboard

        # the detector rows are the rows A1 counts (enriched rows with an amount)
        return dashboard.default_filters(self.features, stats=self.stats)

    @cached_property
    def seller_table(self) -> DataFrame:
        """One row per seller (G10), written once: the seller statistics and their output read it."""
        from anomalytics.operators import reports

        return materialize(reports.seller_performance(self.tables["order_items"], self.tables["sellers"]), "sellers")

    @cached_property
    def event_stats(self) -> stats_op.ColumnStats:
        """Statistics of the events' value, computed in batch once; the streams flag against them."""
        return stats_op.column_stats(self.raw("events"), "value")

    @cached_property
    def forest(self) -> detector.ForestResult:
        return detector.with_isolation_forest(self.features)

    @cached_property
    def detector_ml(self) -> DataFrame:
        """Detector rows with the Isolation Forest flag, statistical flags and anomaly_type."""
        df = detector.with_statistical_flags(self.forest.scored, stats=self.detector_stats)
        return detector.with_anomaly_type(df, detector.ML, detector.IQR)


Z_FLAG = "is_anomaly_z"
