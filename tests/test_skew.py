"""A hot key (one customer with a third of the orders, one order with a third of the items)
gives exact results, and AQE splits the skewed join partition instead of running it in one task."""

import datetime as dt

from pyspark.sql import functions as F

from anomalytics.operators import enrich, flags, reports
from helpers import BASE, customer, item, order, payment, tables


def _skewed(spark):
    n = 600
    orders = [order(f"o{i:04d}", "hot" if i % 3 == 0 else f"c{i % 50}", BASE + dt.timedelta(hours=i)) for i in range(n)]
    items = [item("o0000", 1, n=k) for k in range(300)] + [item(f"o{i:04d}", 10 + i % 13) for i in range(1, n)]
    pays = [payment(f"o{i:04d}", inst=1 + i % 12) for i in range(n)]
    custs = [customer("hot", "SP")] + [customer(f"c{k}", "RJ") for k in range(50)]
    return tables(spark, orders, items, pays, customers=custs)


def test_hot_keys_exact_and_split(spark):
    t = _skewed(spark)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        e = enrich.enriched_orders(t)
        rows = e.collect()
        plan = e._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 600
    by_id = {r["order_id"]: r for r in rows}
    assert by_id["o0000"]["total_items"] == 300 and float(by_id["o0000"]["total_amount"]) == 300.0
    assert sum(r["customer_state"] == "SP" for r in rows) == 200
    assert "skew=true" in plan   # AQE split the hot customer's partition

    f = flags.anomaly_flags(enrich.enriched_orders(t))
    states = {r["customer_state"]: r["total_orders"] for r in reports.regional_distribution(f).collect()}
    assert states == {"SP": 200, "RJ": 400}
