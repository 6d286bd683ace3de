"""Aggregate reports over the flag table and the item table.

Every report is one ``groupBy`` (partial aggregation before the shuffle, so a
hot group is combined map-side) with exact DECIMAL sums; averages divide the
exact sum by the count. Window functions only ever run over the handful of
grouped rows (G1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.functions.columns import (
    count_when, day_name, decimals_to_double, mean_decimal, pct, sum_when, zscore_bucket,
)


def _is_anomaly() -> Column:
    return F.col("amount_flag") != F.lit(config.LABEL_NORMAL)


def _n() -> Column:
    return F.count(F.lit(1))


def anomaly_summary(flags: DataFrame, money_as_double: bool = True) -> DataFrame:
    """A5: per (amount_flag, time_flag, installment_flag)."""
    out = (
        flags.groupBy("amount_flag", "time_flag", "installment_flag")
        .agg(
            _n().alias("order_count"),
            F.sum("total_amount").alias("total_revenue"),
            mean_decimal("total_amount").alias("avg_order_value"),
            F.min("total_amount").alias("min_order_value"),
            F.max("total_amount").alias("max_order_value"),
        )
        .orderBy(F.desc("order_count"))
    )
    return decimals_to_double(out) if money_as_double else out


HIGH_RISK_COLUMNS = (
    "order_id", "customer_id", "customer_state", "order_purchase_timestamp", "total_amount",
    "total_items", "payment_installments", "amount_flag", "time_flag", "installment_flag",
    "anomaly_flag_count", "amount_zscore",
)


def high_risk_transactions(flags: DataFrame, min_flags: int = 2, money_as_double: bool = True) -> DataFrame:
    """Orders with at least ``min_flags`` flags, most flags and largest amount first."""
    out = (
        flags.where(F.col("anomaly_flag_count") >= F.lit(min_flags))
        .select(*HIGH_RISK_COLUMNS)
        .orderBy(F.desc("anomaly_flag_count"), F.desc_nulls_last("total_amount"), F.asc("order_id"))
    )
    return decimals_to_double(out) if money_as_double else out


def flag_share(flags: DataFrame) -> DataFrame:
    """G1: per amount_flag, with share of orders and of revenue (window over <= 3 grouped rows)."""
    g = flags.groupBy("amount_flag").agg(
        _n().alias("order_count"),
        F.sum("total_amount").alias("total_revenue"),
        mean_decimal("total_amount").alias("avg_order_value"),
    )
    everything = Window.partitionBy()
    return decimals_to_double(
        g.select(
            "*",
            pct("order_count", F.sum("order_count").over(everything)).alias("pct_of_orders"),
            pct("total_revenue", F.sum("total_revenue").over(everything)).alias("pct_of_revenue"),
        ).orderBy(F.desc("order_count"))
    )


def _rate_measures() -> list[Column]:
    return [
        _n().alias("total_orders"),
        count_when(_is_anomaly()).alias("anomaly_count"),
    ]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("anomaly_rate", pct("anomaly_count", "total_orders"))


def monthly_trends(flags: DataFrame) -> DataFrame:
    """Per (year, month), chronological."""
    g = flags.groupBy("order_year", "order_month").agg(
        *_rate_measures(),
        F.sum("total_amount").alias("total_revenue"),
        sum_when(_is_anomaly(), "total_amount").alias("anomaly_revenue"),
        mean_decimal("total_amount").alias("avg_order_value"),
    )
    return decimals_to_double(
        _with_rate(g).select(
            "order_year", "order_month", "total_orders", "anomaly_count", "anomaly_rate",
            "total_revenue", "anomaly_revenue", "avg_order_value",
        ).orderBy(F.asc_nulls_last("order_year"), F.asc_nulls_last("order_month"))
    )


def regional_distribution(flags: DataFrame) -> DataFrame:
    """Per customer state (a null state is its own group)."""
    g = flags.groupBy("customer_state").agg(
        *_rate_measures(),
        F.sum("total_amount").alias("total_revenue"),
        sum_when(F.col("amount_flag") == F.lit(config.LABEL_HIGH_AMOUNT), "total_amount").alias("high_amount_revenue"),
        mean_decimal("total_amount").alias("avg_order_value"),
    )
    return decimals_to_double(
        _with_rate(g).select(
            "customer_state", "total_orders", "anomaly_count", "anomaly_rate", "total_revenue",
            "high_amount_revenue", "avg_order_value",
        ).orderBy(F.desc("anomaly_count"))
    )


def hourly_distribution(flags: DataFrame) -> DataFrame:
    """Per purchase hour."""
    g = flags.groupBy("hour_of_day").agg(*_rate_measures(), mean_decimal("total_amount").alias("avg_order_value"))
    return _with_rate(g).select(
        "hour_of_day", "total_orders", "anomaly_count", "anomaly_rate", "avg_order_value"
    ).orderBy(F.asc_nulls_last("hour_of_day"))


def day_of_week_analysis(flags: DataFrame) -> DataFrame:
    """Per weekday (0 = Sunday) with its English name."""
    g = flags.groupBy("day_of_week").agg(*_rate_measures(), F.sum("total_amount").alias("total_revenue"))
    return decimals_to_double(
        _with_rate(g).select(
            "day_of_week", day_name("day_of_week").alias("day_name"), "total_orders", "anomaly_count",
            "anomaly_rate", "total_revenue",
        ).orderBy(F.asc_nulls_last("day_of_week"))
    )


def payment_method_analysis(flags: DataFrame) -> DataFrame:
    """Per payment-type list (orders without payments form the null group)."""
    g = flags.groupBy("payment_type").agg(
        *_rate_measures(),
        mean_decimal("payment_installments").alias("avg_installments"),
        F.sum("total_amount").alias("total_revenue"),
    )
    return decimals_to_double(
        _with_rate(g).select(
            "payment_type", "total_orders", "anomaly_count", "anomaly_rate", "avg_installments", "total_revenue",
        ).orderBy(F.desc("total_orders"))
    )


def zscore_buckets(flags: DataFrame, null_bucket: str | None = None) -> DataFrame:
    """Seven z-score buckets, ordered by the smallest z in each. Rows without a z-score are in the top bucket, or
    in one of their own, the last, if ``null_bucket`` names it."""
    g = flags.groupBy(zscore_bucket("amount_zscore", null_bucket).alias("zscore_bucket")).agg(
        _n().alias("order_count"),
        F.sum("total_amount").alias("total_revenue"),
        mean_decimal("total_amount").alias("avg_order_value"),
        F.min("amount_zscore").alias("_min_z"),
    )
    return decimals_to_double(g.orderBy(F.asc_nulls_last("_min_z")).drop("_min_z"))


TOP_ANOMALOUS_COLUMNS = (
    "order_id", "customer_state", "order_purchase_timestamp", "total_amount", "total_items",
    "payment_installments", "payment_type", "amount_zscore", "amount_flag", "time_flag",
    "installment_flag", "anomaly_flag_count",
)


def top_anomalous(flags: DataFrame, limit: int = config.TOP_ANOMALOUS_LIMIT) -> DataFrame:
    """Top-k by z-score among orders with any amount/time/installment flag.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top k, only k rows per task are merged. ``order_id`` breaks ties.
    """
    normal = F.lit(config.LABEL_NORMAL)
    cond = (F.col("amount_flag") != normal) | (F.col("time_flag") != normal) | (F.col("installment_flag") != normal)
    return decimals_to_double(
        flags.where(cond)
        .orderBy(F.desc_nulls_last("amount_zscore"), F.asc("order_id"))
        .limit(limit)
        .select(*TOP_ANOMALOUS_COLUMNS)
    )


def product_categories(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Per product category: distinct products and orders, revenue, mean item price.

    Items are added up per product before they meet the product table; orders are counted from distinct
    (category, order) pairs. The two small results meet null-safely (unknown products form the null category).
    """
    p = products.select(F.col("product_id").alias("p_product_id"), "product_category_name")
    known = F.col("product_id") == F.col("p_product_id")
    per_product = order_items.groupBy("product_id").agg(F.sum("price").alias("_sum"), F.count("price").alias("_n"))
    money = per_product.join(p, known, "left").groupBy("product_category_name").agg(
        F.countDistinct("product_id").alias("product_count"), F.sum("_sum").alias("total_revenue"), F.sum("_n").alias("_n"))
    orders = (
        order_items.select("product_id", "order_id").distinct().join(p, known, "left")
        .groupBy("product_category_name", "order_id").agg(F.lit(1).alias("_one"))
        .groupBy(F.col("product_category_name").alias("_category")).agg(F.count("order_id").alias("order_count")))
    return decimals_to_double(
        money.join(orders, F.col("product_category_name").eqNullSafe(F.col("_category")))
        .select("product_category_name", "product_count", "order_count", "total_revenue",
                (F.col("total_revenue").cast("double") / F.col("_n")).alias("avg_price"))
        .orderBy(F.desc_nulls_last("total_revenue"))
    )


def seller_performance(order_items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per seller: distinct orders, revenue, mean item price (named avg_order_value).

    Items are added up per (seller, order), then per seller, and only then meet the sellers. Items of unknown sellers
    form one null group, whose orders are counted anew: an order may hold items of several unknown sellers.
    """
    s = sellers.select("seller_id", "seller_city", "seller_state")
    per_order = (order_items.groupBy(F.col("seller_id").alias("_seller"), "order_id")
                 .agg(F.sum("price").alias("_sum"), F.count("price").alias("_n")))
    per_seller = per_order.groupBy("_seller").agg(
        F.count("order_id").alias("order_count"), F.sum("_sum").alias("total_revenue"), F.sum("_n").alias("_n"))
    same = F.col("_seller") == F.col("seller_id")
    known = per_seller.join(s, same).select("seller_id", "seller_city", "seller_state", "order_count", "total_revenue", "_n")
    strangers = per_seller.join(s, same, "left_anti").select("_seller")
    unknown = (
        per_order.alias("o").join(strangers.alias("u"), F.col("o._seller").eqNullSafe(F.col("u._seller")), "left_semi")
        .agg(F.countDistinct("order_id").alias("order_count"), F.sum("_sum").alias("total_revenue"), F.sum("_n").alias("_n"),
             F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
        .select(*[F.lit(None).cast(s.schema[c].dataType).alias(c) for c in s.columns], "order_count", "total_revenue", "_n"))
    return decimals_to_double(
        known.unionByName(unknown)
        .select("seller_id", "seller_city", "seller_state", "order_count", "total_revenue",
                (F.col("total_revenue").cast("double") / F.col("_n")).alias("avg_order_value"))
        .orderBy(F.desc_nulls_last("total_revenue"))
    )
