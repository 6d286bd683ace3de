"""Q1–Q2: data-quality checks (Q3 lives in ``stats.amount_summary``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_AUDIT_FIELDS = ("order_id", "total_amount", "customer_state", "payment_value")


def null_audit(df: DataFrame, fields=NULL_AUDIT_FIELDS) -> DataFrame:
    """Q1: per field, null count and total — one scan, then ``stack`` into one row per field."""
    agg = df.agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(F.col(f).isNull()).alias(f"n_{i}") for i, f in enumerate(fields)],
    )
    pairs = ", ".join(f"'{f}', n_{i}" for i, f in enumerate(fields))
    return agg.selectExpr(f"stack({len(fields)}, {pairs}) AS (field, null_count)", "total_count").select(
        "field", F.col("null_count").cast("bigint").alias("null_count"), F.col("total_count").cast("bigint")
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Q2: key values that occur more than once, with their count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where(F.col("cnt") > 1)
    )
