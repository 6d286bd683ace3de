"""One row per delivered order, with item, payment and customer facts.

Shape of the plan: items and payments are pre-aggregated per ``order_id``
(partial + final hash aggregation, so a hot order is combined map-side before
the shuffle), then joined 1:1 to the filtered orders. Both aggregates come out
hash-partitioned on ``order_id``, so the two order joins share one partitioning
and only ``orders`` is shuffled to meet them. The per-order aggregates have one
row per order, so they grow with the data: they carry a sort-merge hint and are
never broadcast, whatever the size estimate says (the static estimate of an
aggregate is a guess; a broadcast of it would run through the driver). The
customer lookup is a plain left join; Spark broadcasts it only when its
measured size is under the broadcast threshold (AQE re-checks at run time) and
otherwise sort-merges, with AQE splitting a skewed customer partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.functions.columns import day_of_week0, mean_decimal

WITH_FREIGHT = "with_freight"
PRICE_ONLY = "price_only"


def time_dimensions(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Year, month, day, weekday (0 = Sunday), hour, ISO week of the purchase time."""
    t = F.col(ts)
    return orders.select(
        "order_id",
        ts,
        F.year(t).alias("order_year"),
        F.month(t).alias("order_month"),
        F.dayofmonth(t).alias("order_day"),
        day_of_week0(t).alias("day_of_week"),
        F.hour(t).alias("hour_of_day"),
        F.weekofyear(t).alias("week_of_year"),
    )


def items_by_order(order_items: DataFrame, amount_mode: str = WITH_FREIGHT) -> DataFrame:
    """Item count, amount, freight and price spread per order."""
    if amount_mode == WITH_FREIGHT:
        amount = F.sum(F.col("price") + F.col("freight_value"))
    elif amount_mode == PRICE_ONLY:
        amount = F.sum(F.col("price"))
    else:
        raise ValueError(f"unknown amount_mode {amount_mode!r}")
    return order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        amount.alias("total_amount"),
        F.sum("freight_value").alias("total_freight"),
        mean_decimal("price").alias("avg_item_price"),
        F.min("price").alias("min_item_price"),
        F.max("price").alias("max_item_price"),
    )


def payments_by_order(order_payments: DataFrame) -> DataFrame:
    """Sorted distinct payment types joined by ', ', max installments, total value, count.

    The set of types per order is bounded by the handful of payment types, so
    collecting it stays small even for a very hot order.
    """
    return order_payments.groupBy("order_id").agg(
        F.array_join(F.array_sort(F.collect_set("payment_type")), ", ").alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"),
        F.sum("payment_value").alias("payment_value"),
        F.count(F.lit(1)).alias("payment_count"),
    )


def per_order(df: DataFrame) -> DataFrame:
    """A per-order aggregate as a join side: shuffled on ``order_id`` (sort-merge), never broadcast."""
    return df.hint("merge")


def delivered(orders: DataFrame) -> DataFrame:
    """status filter; pushed into the scan by Catalyst."""
    return orders.where(F.col("order_status") == F.lit(config.DELIVERED_STATUS))


FULL_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    "order_year", "order_month", "order_day", "day_of_week", "hour_of_day", "week_of_year",
    "total_items", "total_amount", "total_freight", "avg_item_price", "min_item_price", "max_item_price",
    "customer_city", "customer_state", "customer_zip_code_prefix",
    "payment_type", "payment_installments", "payment_value", "payment_count",
)

LOADER_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    "order_year", "order_month", "day_of_week", "hour_of_day",
    "total_items", "total_amount", "total_freight", "avg_item_price",
    "customer_city", "customer_state",
    "payment_type", "payment_installments", "payment_value",
)


def enriched_orders(tables: dict[str, DataFrame], amount_mode: str = WITH_FREIGHT,
                    columns: tuple[str, ...] = FULL_COLUMNS) -> DataFrame:
    """E1 (and E6 with ``amount_mode=PRICE_ONLY, columns=LOADER_COLUMNS``)."""
    t = F.col("order_purchase_timestamp")
    orders = delivered(tables["orders"]).select(
        "*",
        F.year(t).alias("order_year"),
        F.month(t).alias("order_month"),
        F.dayofmonth(t).alias("order_day"),
        day_of_week0(t).alias("day_of_week"),
        F.hour(t).alias("hour_of_day"),
        F.weekofyear(t).alias("week_of_year"),
    )
    items = per_order(items_by_order(tables["order_items"], amount_mode))
    payments = per_order(payments_by_order(tables["order_payments"]))
    customers = tables["customers"].select(
        "customer_id", "customer_city", "customer_state", "customer_zip_code_prefix"
    )
    joined = (
        orders.join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(customers, "customer_id", "left")
    )
    return joined.select(*columns)


def orders_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The detector's nine columns; installments default 1; orders without items dropped.

    The not-null filter on the amount turns the item join into an inner join
    (Catalyst rewrites it), so orders without items never reach the shuffle.
    """
    t = F.col("order_purchase_timestamp")
    orders = delivered(tables["orders"]).select(
        "order_id", "customer_id", "order_purchase_timestamp",
        F.hour(t).alias("hour_of_day"), day_of_week0(t).alias("day_of_week"),
    )
    items = per_order(tables["order_items"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.sum(F.col("price") + F.col("freight_value")).alias("total_amount"),
    ))
    payments = per_order(tables["order_payments"].groupBy("order_id").agg(
        F.max("payment_installments").alias("payment_installments")
    ))
    customers = tables["customers"].select("customer_id", "customer_state")
    return (
        orders.join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(customers, "customer_id", "left")
        .where(F.col("total_amount").isNotNull())
        .select(
            "order_id", "customer_id", "order_purchase_timestamp", "hour_of_day", "day_of_week",
            "total_items", "total_amount",
            F.coalesce(F.col("payment_installments"), F.lit(1)).alias("payment_installments"),
            "customer_state",
        )
    )


def features_from_enriched(enriched: DataFrame) -> DataFrame:
    """E7 derived from E1: the same rows and values as ``orders_features``.

    E1 already holds the item count, the amount with freight, the maximum
    installments and the state per delivered order, so the detector rows are a
    filter and projection of it — no second aggregation of the items.
    """
    return enriched.where(F.col("total_amount").isNotNull()).select(
        "order_id", "customer_id", "order_purchase_timestamp", "hour_of_day", "day_of_week",
        "total_items", "total_amount",
        F.coalesce(F.col("payment_installments"), F.lit(1)).alias("payment_installments"),
        "customer_state",
    )
