"""Hand-made micro fixtures with hand-computed answers (semantic traps T1–T17)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.operators import detector, enrich, flags, quality, reports, stats
from helpers import BASE, customer, item, order, payment, tables


def _flags(spark, amounts, **kw):
    orders = [order(f"o{i}") for i in range(len(amounts))]
    items = [item(f"o{i}", a) for i, a in enumerate(amounts)]
    t = tables(spark, orders, items, **kw)
    e = enrich.enriched_orders(t)
    return e, flags.anomaly_flags(e)


def test_low_amount_and_extremes(spark):
    amounts = [100, 101, 102, 103, 104, 105, 106, 107, 1, 500]
    e, f = _flags(spark, amounts)
    q1, q3 = np.percentile(amounts, [25, 75])
    iqr = q3 - q1
    got = {r["total_amount"]: (r["amount_flag"], r["extreme_flag"]) for r in f.collect()}
    for a in amounts:
        amount_flag = "HIGH_AMOUNT" if a > q3 + 1.5 * iqr else ("LOW_AMOUNT" if a < q1 - 1.5 * iqr else "NORMAL")
        extreme = "EXTREME_HIGH" if a > q3 + 3 * iqr else ("EXTREME_LOW" if a < q1 - 3 * iqr else "NORMAL")
        assert got[a] == (amount_flag, extreme), a
    assert got[1] == ("LOW_AMOUNT", "EXTREME_LOW")
    assert got[500] == ("HIGH_AMOUNT", "EXTREME_HIGH")


def test_constant_amount_guarded_and_unguarded(spark):
    e, f = _flags(spark, [50] * 5)
    assert {r["amount_zscore"] for r in f.collect()} == {0.0}
    feats = e.select("order_id", "total_amount")
    z = stats.with_amount_zscore(feats).collect()
    assert all(r["amount_zscore"] is None for r in z)


def test_single_row_std_null_gives_zero(spark):
    e, f = _flags(spark, [42])
    r = f.first()
    assert r["std_amount"] is None and r["amount_zscore"] == 0.0


def test_null_amount_is_normal_with_null_z(spark):
    orders = [order("o1"), order("o2"), order("o3"), order("empty")]
    items = [item("o1", 10), item("o2", 20), item("o3", 30)]
    e = enrich.enriched_orders(tables(spark, orders, items))
    f = flags.anomaly_flags(e)
    row = f.where(F.col("order_id") == "empty").first()
    assert row["amount_flag"] == "NORMAL" and row["amount_zscore"] is None and row["anomaly_flag_count"] == 0
    buckets = {r["zscore_bucket"]: r["order_count"] for r in reports.zscore_buckets(f).collect()}
    assert buckets[config.ZSCORE_TOP_BUCKET] >= 1   # T4: null z falls to the ELSE bucket


def test_null_state_kept_in_sql_group_dropped_in_detector(spark):
    orders = [order("o1", "c1"), order("o2", "ghost")]
    items = [item("o1", 10), item("o2", 20)]
    t = tables(spark, orders, items)
    e = enrich.enriched_orders(t)
    f = flags.anomaly_flags(e)
    states = {r["customer_state"] for r in reports.regional_distribution(f).collect()}
    assert states == {"SP", None}
    d = detector.with_statistical_flags(enrich.orders_features(t)).withColumn("is_anomaly_ml", F.lit(False))
    assert {r["customer_state"] for r in detector.anomalies_by_state(d).collect()} == {"SP"}


def test_weekdays_sunday_is_zero(spark):
    orders = [order(f"o{i}", ts=BASE + dt.timedelta(days=i)) for i in range(7)]
    items = [item(f"o{i}", 10) for i in range(7)]
    f = flags.anomaly_flags(enrich.enriched_orders(tables(spark, orders, items)))
    got = {r["day_of_week"]: r["day_name"] for r in reports.day_of_week_analysis(f).collect()}
    assert got == dict(enumerate(config.DAY_NAMES))


@pytest.mark.parametrize("hm,flag", [((1, 59), "NORMAL"), ((2, 0), "UNUSUAL_HOUR"), ((5, 59), "UNUSUAL_HOUR"),
                                      ((6, 0), "NORMAL")])
def test_hour_bounds(spark, hm, flag):
    ts = dt.datetime(2018, 3, 5, hm[0], hm[1])
    f = flags.anomaly_flags(enrich.enriched_orders(tables(spark, [order("o1", ts=ts)], [item("o1", 10)])))
    assert f.first()["time_flag"] == flag


def test_strict_count_thresholds(spark):
    orders = [order("a"), order("b"), order("c"), order("d")]
    items = [item("a", 10, n=i) for i in range(5)] + [item("b", 10, n=i) for i in range(6)] + [item("c", 10), item("d", 10)]
    pays = [payment("c", inst=10), payment("d", inst=11)]
    f = flags.anomaly_flags(enrich.enriched_orders(tables(spark, orders, items, pays)))
    got = {r["order_id"]: (r["size_flag"], r["installment_flag"]) for r in f.collect()}
    assert got["a"][0] == "NORMAL" and got["b"][0] == "LARGE_ORDER"
    assert got["c"][1] == "NORMAL" and got["d"][1] == "HIGH_INSTALLMENTS"


def test_duplicates(spark):
    t = tables(spark, [order("o1"), order("o1"), order("o2")], [item("o1", 1), item("o2", 2)])
    d = quality.duplicate_keys(t["orders"], "order_id").collect()
    assert [(r["order_id"], r["cnt"]) for r in d] == [("o1", 2)]


def test_two_payments_sorted_distinct_list(spark):
    pays = [payment("o1", "credit_card", 3, "10.00", 1), payment("o1", "voucher", 1, "5.00", 2),
            payment("o1", "credit_card", 7, "1.50", 3)]
    p = enrich.payments_by_order(tables(spark, [order("o1")], [item("o1", 1)], pays)["order_payments"]).first()
    assert p["payment_type"] == "credit_card, voucher"
    assert p["payment_installments"] == 7 and float(p["payment_value"]) == 16.5 and p["payment_count"] == 3


def test_top_ties_broken_by_order_id(spark):
    ts = dt.datetime(2018, 3, 5, 3, 0)   # unusual hour: every row passes the filter
    orders = [order(f"o{i:03d}", ts=ts) for i in range(105)]
    items = [item(f"o{i:03d}", 10) for i in range(105)]
    f = flags.anomaly_flags(enrich.enriched_orders(tables(spark, orders, items)))
    top = [r["order_id"] for r in reports.top_anomalous(f).collect()]
    assert top == [f"o{i:03d}" for i in range(100)]


def test_flag_count_equals_counted_flags(spark):
    e, f = _flags(spark, [100, 101, 102, 103, 104, 105, 106, 107, 1, 500])
    for r in f.collect():
        n = sum(r[c] != "NORMAL" for c in ("amount_flag", "time_flag", "installment_flag", "size_flag"))
        assert r["anomaly_flag_count"] == n


def test_group_sums_equal_total(spark):
    e, f = _flags(spark, [100, 101, 102, 103, 104, 105, 106, 107, 1, 500])
    share = reports.flag_share(f).collect()
    assert sum(r["order_count"] for r in share) == 10
    assert abs(sum(r["pct_of_orders"] for r in share) - 100.0) < 1e-9
    assert abs(sum(r["pct_of_revenue"] for r in share) - 100.0) < 1e-9


def test_detector_guard(spark):
    with pytest.raises(ValueError):
        detector.RetailDetector().get_summary_stats()
    with pytest.raises(ValueError):
        detector.RetailDetector(spark.range(3)).get_monthly_trends()


def test_zero_denominators_do_not_raise(spark):
    from anomalytics.functions.columns import pct, safe_div

    df = spark.createDataFrame([(1, 0), (0, 0), (3, None)], "a int, b int")
    rows = df.select(safe_div("a", "b").alias("d"), pct("a", "b").alias("p")).collect()
    assert all(r["d"] is None and r["p"] is None for r in rows)


def test_installments_default_only_in_detector(spark):
    t = tables(spark, [order("o1")], [item("o1", 10)])   # no payments
    e = enrich.enriched_orders(t).first()
    f = enrich.orders_features(t).first()
    assert e["payment_installments"] is None and f["payment_installments"] == 1


def test_amount_modes(spark):
    t = tables(spark, [order("o1")], [item("o1", "10.00", "2.50"), item("o1", "5.00", "1.00", n=2)])
    with_freight = enrich.enriched_orders(t).first()["total_amount"]
    price_only = enrich.enriched_orders(t, enrich.PRICE_ONLY, enrich.LOADER_COLUMNS).first()["total_amount"]
    assert float(with_freight) == 18.5 and float(price_only) == 15.0


def test_detector_facade_end_to_end(spark):
    orders = [order(f"o{i:03d}", ts=BASE + dt.timedelta(hours=i)) for i in range(300)]
    items = [item(f"o{i:03d}", 10 + (i % 7)) for i in range(297)] + [item(f"o{i:03d}", 5000) for i in range(297, 300)]
    d = detector.RetailDetector(enrich.orders_features(tables(spark, orders, items)), contamination=0.05)
    d = d.fit_isolation_forest().add_statistical_flags()
    s = d.get_summary_stats().first()
    assert s["total_orders"] == 300 and s["anomaly_count_ml"] <= 15
    assert d.get_anomalies_by_state().count() == 1
    assert d.get_monthly_trends().count() >= 1
    types = {r["anomaly_type"] for r in d.df.select("anomaly_type").distinct().collect()}
    assert types <= {config.TYPE_NORMAL, config.TYPE_ML, config.TYPE_STATISTICAL, config.TYPE_HIGH_CONFIDENCE}
    big = d.df.where(F.col("total_amount") >= 5000).select("is_anomaly_iqr").collect()
    assert all(r[0] for r in big)
