"""Plan shape: filters reach the scan, no Cartesian products, joins reuse the order partitioning."""

import os

from pyspark.sql import functions as F

from anomalytics.operators import enrich, flags, reports
from anomalytics.sources import adapters, readers

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _parquet_tables(spark, folder):
    t = adapters.testdata_tables(spark, SF)
    for name, df in t.items():
        df.write.parquet(os.path.join(folder, f"{name}.parquet"))
    return readers.load_all_tables(spark, folder, "parquet")


def test_status_filter_pushed_to_scan_on_stored_columns(spark, tmp_dir):
    tables = _parquet_tables(spark, tmp_dir)
    plan = _plan(enrich.enriched_orders(tables))
    assert "EqualTo(order_status,delivered)" in plan


def test_status_filter_pushed_to_scan_through_the_adapter(spark):
    plan = _plan(enrich.enriched_orders(adapters.testdata_tables(spark, SF)))
    assert "EqualNullSafe(o_orderstatus,F)" in plan


def test_adapted_status_of_null_and_unknown_codes(spark):
    orders = adapters.read_raw(spark, SF, "orders").limit(4)
    codes = spark.createDataFrame([("F",), ("O",), ("P",), (None,)], "o_orderstatus string")
    adapted = adapters.adapt_orders(codes.crossJoin(orders.drop("o_orderstatus").limit(1)))
    assert sorted(r.order_status for r in adapted.select("order_status").collect()) == ["delivered", "processing", "processing", "shipped"]


def test_flag_table_has_no_join_and_reports_no_cartesian(spark, tmp_dir):
    tables = _parquet_tables(spark, tmp_dir)
    e = enrich.enriched_orders(tables)
    f = flags.anomaly_flags(e)
    plan = _plan(reports.monthly_trends(f))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_order_joins_share_one_partitioning_without_broadcast(spark, tmp_dir):
    tables = _parquet_tables(spark, tmp_dir)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(enrich.enriched_orders(tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", old_aqe)
    # orders, items and payments are each hashed on order_id once; customers joins on customer_id
    assert plan.count("hashpartitioning(order_id") == 3
    assert plan.count("SortMergeJoin [order_id") == 2


def test_top_k_is_take_ordered(spark, tmp_dir):
    tables = _parquet_tables(spark, tmp_dir)
    f = flags.anomaly_flags(enrich.enriched_orders(tables))
    assert "TakeOrderedAndProject" in _plan(reports.top_anomalous(f))


def test_column_pruning_reaches_scan(spark, tmp_dir):
    tables = _parquet_tables(spark, tmp_dir)
    plan = _plan(enrich.items_by_order(tables["order_items"]))
    scan = [l for l in plan.split("\n") if "ReadSchema" in l][0]
    assert "product_id" not in scan and "seller_id" not in scan


def test_per_order_aggregates_never_broadcast_under_aqe(spark):
    # default threshold and AQE on: the aggregates are small here, yet they grow with the data, so they are shuffled
    tables = adapters.testdata_tables(spark, SF)
    for e in (enrich.enriched_orders(tables), enrich.orders_features(tables)):
        e.collect()
        full = e._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in full
        plan = full.split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin [order_id") == 2
        # the only broadcasts left are the dimension lookups (nation into customers, customers into orders)
        assert plan.count("BroadcastExchange") == (plan.count("BroadcastHashJoin [c_nationkey")
                                                   + plan.count("BroadcastHashJoin [customer_id"))


def test_bucketed_order_joins_have_no_exchange_on_the_order(spark):
    from anomalytics.operators import enrich
    from anomalytics.plans.workspace import Workspace
    from anomalytics.sources.bucketed import bucket_by_order

    tables = Workspace(spark, "/root/testdata/sf0.001").tables
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            enriched = enrich.enriched_orders(bucket_by_order(tables, buckets=5))
            rows = sorted(map(str, enriched.collect()))
            plan = _plan(enriched)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert "hashpartitioning(order_id" not in plan and "Bucketed: true" in plan
        assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan
        assert rows == sorted(map(str, enrich.enriched_orders(tables).collect()))


def test_bucketed_copies_of_empty_and_odd_tables(spark):
    from anomalytics.sources.bucketed import bucket_by_order

    orders = spark.createDataFrame([("a", 1), (None, 2), ("a", 1)], "order_id string, n int")
    got = bucket_by_order({"orders": orders, "order_items": orders.where("false"), "products": orders}, buckets=3)
    assert sorted(map(str, got["orders"].collect())) == sorted(map(str, orders.collect()))
    assert got["order_items"].count() == 0 and got["order_items"].dtypes == orders.dtypes and got["products"] is orders


def _files_read(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_a_month_filter_reads_its_files_only_and_the_state_is_pushed(spark, tmp_dir):
    import datetime as dt

    from anomalytics.operators import dashboard
    from anomalytics.plans.workspace import Workspace

    rows = Workspace(spark, "/root/testdata/sf0.001").features
    kept = dashboard.write_clustered(rows, os.path.join(tmp_dir, "clustered"))
    assert sorted(map(str, kept.drop(dashboard.MONTH).select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    first = rows.where("customer_state IS NOT NULL").orderBy("order_purchase_timestamp").first()
    day = first.order_purchase_timestamp.date()
    span = (day.replace(day=1), day.replace(day=28))
    for filters in ({"dates": span, "state": first.customer_state}, {"dates": span}, {"state": first.customer_state}):
        asked = dashboard.filter_clustered(kept, **filters)
        assert sorted(map(str, asked.select("order_id").collect())) == sorted(
            map(str, dashboard.filter_orders(rows, **filters).select("order_id").collect()))
    every, one = _files_read(kept), _files_read(dashboard.filter_clustered(kept, dates=span, state=first.customer_state))
    assert 1 <= one <= 2 and every > 50
    assert f"EqualTo(customer_state,{first.customer_state})" in _plan(dashboard.filter_clustered(kept, state=first.customer_state))
