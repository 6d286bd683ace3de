"""Anomaly rate per product category; outlier sellers by revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.functions.columns import count_when, pct
from anomalytics.operators import stats as stats_op
from anomalytics.operators.enrich import per_order


def category_anomalies(flags: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Per product category, distinct delivered orders, anomalous ones (amount flag) and the rate.

    Items meet the flagged orders first, on ``order_id``: that drops the items of other orders, and the same
    partitioning serves the distinct (order, product) and (order, category) pairs. Both sides grow with the orders, so
    the join is a sort-merge join (never a broadcast).
    """
    p = products.select(F.col("product_id").alias("p_id"), "product_category_name")
    f = flags.select("order_id", (F.col("amount_flag") != F.lit(config.LABEL_NORMAL)).alias("_anom"))
    bought = order_items.select("order_id", "product_id").join(per_order(f), "order_id").distinct()
    pairs = (bought.join(p, F.col("product_id") == F.col("p_id"), "left")
             .select("order_id", "_anom", "product_category_name").distinct())
    g = pairs.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("order_count"),
        count_when(F.col("_anom")).alias("anomaly_count"),
    )
    return g.withColumn("anomaly_rate", pct("anomaly_count", "order_count")).orderBy(
        F.desc("anomaly_rate"), F.asc_nulls_last("product_category_name")
    )


def seller_anomalies(performance: DataFrame, column: str = "total_revenue") -> DataFrame:
    """Z-score and IQR outlier test over seller revenue (generic A7/A8)."""
    s = stats_op.column_stats(performance, column)
    return performance.select(
        "seller_id", "seller_state", "order_count", column,
        stats_op.unguarded_zscore(column, s.mean, s.std).alias("revenue_zscore"),
        F.coalesce(stats_op.iqr_flag(column, s.q1, s.q3), F.lit(False)).alias("is_outlier_iqr"),
        stats_op.zscore_flag(stats_op.unguarded_zscore(column, s.mean, s.std)).alias("is_outlier_z"),
    ).orderBy(F.desc(column), F.asc_nulls_last("seller_id"))
