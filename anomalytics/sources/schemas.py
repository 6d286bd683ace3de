"""Explicit schemas of the logical input tables (no inference at read time)."""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(12, 2)


def _s(*fields) -> StructType:
    return StructType([StructField(name, typ, True) for name, typ in fields])


ORDERS = _s(
    ("order_id", StringType()),
    ("customer_id", StringType()),
    ("order_status", StringType()),
    ("order_purchase_timestamp", TimestampNTZType()),
    ("order_approved_at", TimestampNTZType()),
    ("order_delivered_carrier_date", TimestampNTZType()),
    ("order_delivered_customer_date", TimestampNTZType()),
    ("order_estimated_delivery_date", TimestampNTZType()),
)

ORDER_ITEMS = _s(
    ("order_id", StringType()),
    ("order_item_id", IntegerType()),
    ("product_id", StringType()),
    ("seller_id", StringType()),
    ("shipping_limit_date", TimestampNTZType()),
    ("price", MONEY),
    ("freight_value", MONEY),
)

CUSTOMERS = _s(
    ("customer_id", StringType()),
    ("customer_unique_id", StringType()),
    ("customer_zip_code_prefix", StringType()),
    ("customer_city", StringType()),
    ("customer_state", StringType()),
)

ORDER_PAYMENTS = _s(
    ("order_id", StringType()),
    ("payment_sequential", IntegerType()),
    ("payment_type", StringType()),
    ("payment_installments", IntegerType()),
    ("payment_value", MONEY),
)

PRODUCTS = _s(
    ("product_id", StringType()),
    ("product_category_name", StringType()),
)

SELLERS = _s(
    ("seller_id", StringType()),
    ("seller_zip_code_prefix", StringType()),
    ("seller_city", StringType()),
    ("seller_state", StringType()),
)

ORDER_REVIEWS = _s(
    ("review_id", StringType()),
    ("order_id", StringType()),
    ("review_score", IntegerType()),
    ("review_comment_title", StringType()),
    ("review_comment_message", StringType()),
    ("review_creation_date", TimestampNTZType()),
    ("review_answer_timestamp", TimestampNTZType()),
)

GEOLOCATION = _s(
    ("geolocation_zip_code_prefix", StringType()),
    ("geolocation_lat", DoubleType()),
    ("geolocation_lng", DoubleType()),
    ("geolocation_city", StringType()),
    ("geolocation_state", StringType()),
)

SCHEMAS: dict[str, StructType] = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "customers": CUSTOMERS,
    "order_payments": ORDER_PAYMENTS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "order_reviews": ORDER_REVIEWS,
    "geolocation": GEOLOCATION,
}
