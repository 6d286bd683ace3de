"""The analysis views under the names the reference's SQL uses.

After ``register_analysis_views`` a user's report SQL runs unchanged through
``spark.sql`` against ``v_orders_enriched``, ``v_global_stats``,
``v_anomaly_stats``, ``v_anomaly_summary`` and ``v_high_risk_transactions``.
The views sit on the kept (written) enriched table, so every SQL query gets
column pruning and filter pushdown into that table's parquet scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from anomalytics.operators import reports
from anomalytics.plans.workspace import Workspace

# ---- fixed values: view names used by the reference's SQL ------------------------
VIEW_NAMES = (
    "v_orders_enriched",
    "v_global_stats",
    "v_anomaly_stats",
    "v_anomaly_summary",
    "v_high_risk_transactions",
)
# ------------------------------------------------------------------------------------


def register_analysis_views(spark: SparkSession, ws: Workspace) -> tuple[str, ...]:
    ws.enriched_table.createOrReplaceTempView("v_orders_enriched")
    ws.stats.as_frame(spark).createOrReplaceTempView("v_global_stats")
    ws.flags.createOrReplaceTempView("v_anomaly_stats")
    # money stays DECIMAL in the views, so sums over them are exact
    reports.anomaly_summary(ws.flags, money_as_double=False).createOrReplaceTempView("v_anomaly_summary")
    reports.high_risk_transactions(ws.flags, money_as_double=False).createOrReplaceTempView("v_high_risk_transactions")
    return VIEW_NAMES
