"""Map the driver's TPC-H-like parquet tables onto the six logical tables.

Pure projections and one dimension join, so Catalyst keeps pruning columns and
pushing filters (the status filter lands on ``o_orderstatus`` in the scan).
Ids stay BIGINT; operators do not depend on the id type.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics.functions.columns import hours_after

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_RAW: dict[tuple[str, int, str, str], DataFrame] = {}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw table as a lazy DataFrame; the definition (not the data) is reused per session.

    The input folders are read-only, so resolving a file's schema once per
    session is enough; every query still scans the files when it runs.
    """
    key = (spark.sparkContext.applicationId, id(spark), os.path.abspath(sf_dir), name)
    df = _RAW.get(key)
    if df is None:
        df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
        _RAW[key] = df
    return df


def _price() -> F.Column:
    return F.col("l_extendedprice").cast("decimal(12,2)")


def _status() -> F.Column:
    """Nested conditions that are never null: Catalyst folds ``order_status = <literal>`` into a test of the stored
    column, which the scan takes (one CASE with several branches is not folded)."""
    stored = F.col("o_orderstatus")
    rest = F.when(stored.eqNullSafe("O"), "shipped").otherwise("processing")
    return F.when(stored.eqNullSafe("F"), "delivered").otherwise(rest)


def adapt_orders(orders: DataFrame) -> DataFrame:
    purchase = hours_after("o_orderdate", (F.col("o_orderkey") * 7) % 24)
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _status().alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        hours_after(purchase, 1).alias("order_approved_at"),
        hours_after(purchase, 24).alias("order_delivered_carrier_date"),
        hours_after(purchase, 120).alias("order_delivered_customer_date"),
        hours_after(purchase, 240).alias("order_estimated_delivery_date"),
    )


def adapt_order_items(lineitem: DataFrame) -> DataFrame:
    price = _price()
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).alias("freight_value"),
    )


def adapt_order_payments(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(F.col("l_returnflag") == "A", "boleto")
        .when(F.col("l_returnflag") == "R", "credit_card")
        .otherwise("voucher")
        .alias("payment_type"),
        F.ceil(F.col("l_quantity") / F.lit(4.0)).cast("int").alias("payment_installments"),
        _price().alias("payment_value"),
    )


def adapt_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    n = nation.select(F.col("n_nationkey"), F.col("n_name"))
    return customer.join(n, customer["c_nationkey"] == n["n_nationkey"], "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def adapt_products(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"))


def adapt_sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    n = nation.select(F.col("n_nationkey"), F.col("n_name"))
    return supplier.join(n, supplier["s_nationkey"] == n["n_nationkey"], "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def testdata_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six logical tables over ``sf_dir`` (lazy)."""
    raw = lambda name: read_raw(spark, sf_dir, name)
    lineitem = raw("lineitem")
    nation = raw("nation")
    return {
        "orders": adapt_orders(raw("orders")),
        "order_items": adapt_order_items(lineitem),
        "customers": adapt_customers(raw("customer"), nation),
        "order_payments": adapt_order_payments(lineitem),
        "products": adapt_products(raw("part")),
        "sellers": adapt_sellers(raw("supplier"), nation),
    }
