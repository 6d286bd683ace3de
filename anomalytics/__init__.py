"""anomalytics — retail order anomaly analytics on Spark DataFrames.

Layers:
  sources/    readers, test-table adapters, sinks
  functions/  column-expression helpers (time parts, ratios, labels, formats)
  operators/  enrichment, quality checks, statistics, flags, reports,
              Isolation Forest, detector facade, dashboard tables
  plans/      named query catalog (``queries()``) and its DuckDB oracle SQL
  streaming/  Structured Streaming flagging and windowed rates
"""

from anomalytics.config import Thresholds, DEFAULT_THRESHOLDS

__all__ = ["Thresholds", "DEFAULT_THRESHOLDS"]
