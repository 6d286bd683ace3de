"""The analysis views answer report SQL through spark.sql with the operators' results."""

from anomalytics import config
from anomalytics.operators import reports
from anomalytics.plans.views import VIEW_NAMES, register_analysis_views
from anomalytics.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"

ZBUCKET = "CASE " + " ".join(f"WHEN amount_zscore < {bound} THEN '{label}'" for bound, label in config.ZSCORE_BUCKETS) + (
    f" ELSE '{config.ZSCORE_TOP_BUCKET}' END")


def test_views_registered_and_sql_matches_operators(spark):
    ws = Workspace.get(spark, SF)
    assert register_analysis_views(spark, ws) == VIEW_NAMES
    names = {t.name for t in spark.catalog.listTables()}
    assert set(VIEW_NAMES) <= names

    sql = spark.sql(f"""
        SELECT {ZBUCKET} AS zscore_bucket, COUNT(*) AS order_count
        FROM v_anomaly_stats GROUP BY {ZBUCKET} ORDER BY MIN(amount_zscore)""").collect()
    op = reports.zscore_buckets(ws.flags).collect()
    assert [(r[0], r[1]) for r in sql] == [(r["zscore_bucket"], r["order_count"]) for r in op]

    n_high = spark.sql("SELECT COUNT(*) FROM v_high_risk_transactions").first()[0]
    assert n_high == ws.flags.where("anomaly_flag_count >= 2").count()
    s = spark.sql("SELECT SUM(order_count) FROM v_anomaly_summary").first()[0]
    assert s == spark.sql("SELECT COUNT(*) FROM v_orders_enriched").first()[0]
    g = spark.sql("SELECT q1, q3 FROM v_global_stats").first()
    assert g["q1"] == ws.stats.q1 and g["q3"] == ws.stats.q3
