"""Properties over the driver's tables (sf0.001): group sums equal totals, filters commute,
histogram counts add up, shares add to 100."""

import datetime as dt

from pyspark.sql import functions as F

from anomalytics.operators import dashboard, reports
from anomalytics.plans.workspace import Workspace, Z_FLAG

SF = "/root/testdata/sf0.001"


def test_report_groups_sum_to_total(spark):
    ws = Workspace.get(spark, SF)
    n = ws.flags.count()
    for rep in (reports.monthly_trends, reports.regional_distribution, reports.hourly_distribution,
                reports.day_of_week_analysis, reports.payment_method_analysis):
        assert sum(r["total_orders"] for r in rep(ws.flags).collect()) == n
    assert sum(r["order_count"] for r in reports.zscore_buckets(ws.flags).collect()) == n
    assert abs(sum(r["pct_of_orders"] for r in reports.flag_share(ws.flags).collect()) - 100) < 1e-9


def test_filters_commute(spark):
    rows = Workspace.get(spark, SF).detector_z
    state = dashboard.state_options(rows).first()["customer_state"]
    a = dashboard.filter_orders(dashboard.filter_orders(rows, state=state), amount=(0.0, 200000.0))
    b = dashboard.filter_orders(dashboard.filter_orders(rows, amount=(0.0, 200000.0)), state=state)
    c = dashboard.filter_orders(rows, state=state, amount=(0.0, 200000.0),
                                dates=(dt.date(1900, 1, 1), dt.date(2200, 1, 1)))
    ids = lambda d: sorted(r[0] for r in d.select("order_id").collect())
    assert ids(a) == ids(b) == ids(c)
    counts = dashboard.filter_counts(rows, state=state, amount=(0.0, 200000.0)).first()
    assert counts["shown_orders"] == len(ids(a)) and counts["total_orders"] == rows.count()


def test_histogram_counts_sum_to_rows(spark):
    rows = Workspace.get(spark, SF).detector_z
    h = dashboard.histogram(rows, "total_amount", Z_FLAG).collect()
    assert sum(r["count"] for r in h) == rows.where(F.col("total_amount").isNotNull()).count()
    assert max(r["bin"] for r in h) <= 49 and min(r["bin"] for r in h) >= 0


def test_type_breakdown_shares(spark):
    rows = Workspace.get(spark, SF).detector_z
    t = dashboard.type_breakdown(rows).collect()
    assert abs(sum(r["percent"] for r in t) - 100) < 1e-9
    assert sum(r["count"] for r in t) == rows.count()


def test_detector_rows_from_enriched_equal_standalone_e7(spark):
    from anomalytics.operators import enrich

    ws = Workspace.get(spark, SF)
    a = sorted(map(tuple, ws.features.collect()))
    b = sorted(map(tuple, enrich.orders_features(ws.tables).collect()))
    assert a == b and len(a) > 0
