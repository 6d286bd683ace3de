"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables under ``sf_dir`` through the adapter and
runs the operators over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics.operators import enrich, reports
from anomalytics.plans.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def round6(df: DataFrame, *cols: str) -> DataFrame:
    """Round values that carry floating-point noise (std, z, percentiles) to 6 places."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- minimum slice ------------------------------------------------------------

@query("monthly_trends")
def monthly_trends(spark, sf_dir):
    return reports.monthly_trends(Workspace.get(spark, sf_dir).flags)


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- scans and enrichment -------------------------------------------------------

from anomalytics.functions.columns import decimals_to_double as _d2d  # noqa: E402
from anomalytics.operators import quality, stats as stats_op  # noqa: E402
from anomalytics.sources import readers  # noqa: E402


@query("scan_orders")
def scan_orders(spark, sf_dir):
    return Workspace.get(spark, sf_dir).tables["orders"]


@query("table_row_counts")
def table_row_counts(spark, sf_dir):
    return readers.table_row_counts(Workspace.get(spark, sf_dir).tables)


@query("items_by_order")
def items_by_order(spark, sf_dir):
    return _d2d(enrich.items_by_order(Workspace.get(spark, sf_dir).tables["order_items"]))


@query("payments_by_order")
def payments_by_order(spark, sf_dir):
    return _d2d(enrich.payments_by_order(Workspace.get(spark, sf_dir).tables["order_payments"]))


@query("time_dimensions")
def time_dimensions(spark, sf_dir):
    return enrich.time_dimensions(Workspace.get(spark, sf_dir).tables["orders"])


@query("orders_enriched")
def orders_enriched(spark, sf_dir):
    return _d2d(Workspace.get(spark, sf_dir).enriched_table)


@query("orders_enriched_price_only")
def orders_enriched_price_only(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return _d2d(enrich.enriched_orders(ws.tables, enrich.PRICE_ONLY, enrich.LOADER_COLUMNS))


@query("orders_features")
def orders_features(spark, sf_dir):
    # the standalone E7 operator (the detector rows of the workspace are derived from E1)
    return _d2d(enrich.orders_features(Workspace.get(spark, sf_dir).tables))


# ---- data quality ---------------------------------------------------------------

@query("null_audit")
def null_audit(spark, sf_dir):
    return quality.null_audit(Workspace.get(spark, sf_dir).enriched_table)


@query("duplicate_orders")
def duplicate_orders(spark, sf_dir):
    return quality.duplicate_keys(Workspace.get(spark, sf_dir).enriched_table, "order_id")


@query("duplicate_item_keys")
def duplicate_item_keys(spark, sf_dir):
    return quality.duplicate_keys(Workspace.get(spark, sf_dir).tables["order_items"], "order_id", "order_item_id")


@query("amount_summary")
def amount_summary(spark, sf_dir):
    # Q3 reads the kept statistics: A1's passes already compute its values over the same rows
    return round6(Workspace.get(spark, sf_dir).stats.amount_summary(spark),
                  "std_order_amount", "q1_amount", "median_amount", "q3_amount", "p99_amount")


# ---- statistics and flags -------------------------------------------------------

@query("global_stats")
def global_stats(spark, sf_dir):
    return round6(Workspace.get(spark, sf_dir).stats.as_frame(spark),
                  "std_amount", "q1", "q3", "std_items", "std_installments")


@query("zscores")
def zscores(spark, sf_dir):
    f = Workspace.get(spark, sf_dir).flags
    return round6(f.select("order_id", "amount_zscore", "items_zscore"), "amount_zscore", "items_zscore")


@query("anomaly_flags")
def anomaly_flags(spark, sf_dir):
    f = Workspace.get(spark, sf_dir).flags
    return round6(_d2d(f), "std_amount", "q1", "q3", "amount_zscore", "items_zscore")


@query("anomaly_summary")
def anomaly_summary(spark, sf_dir):
    return reports.anomaly_summary(Workspace.get(spark, sf_dir).flags)


@query("high_risk_transactions")
def high_risk_transactions(spark, sf_dir):
    return round6(reports.high_risk_transactions(Workspace.get(spark, sf_dir).flags), "amount_zscore")


@query("amount_zscore")
def amount_zscore(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    df = stats_op.with_amount_zscore(ws.features, stats=ws.detector_stats)
    return round6(_d2d(df.select("order_id", "total_amount", "amount_zscore")), "amount_zscore")


@query("iqr_outliers")
def iqr_outliers(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    df = stats_op.with_iqr_flag(ws.features, stats=ws.detector_stats)
    return _d2d(df.select("order_id", "total_amount", "is_anomaly_iqr"))


@query("zscore_outliers")
def zscore_outliers(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    df = stats_op.with_amount_zscore(ws.features, stats=ws.detector_stats)
    out = df.where(stats_op.zscore_flag("amount_zscore")).select("order_id", "total_amount", "amount_zscore")
    return round6(_d2d(out), "amount_zscore")


# ---- reports ----------------------------------------------------------------------

@query("flag_share")
def flag_share(spark, sf_dir):
    return reports.flag_share(Workspace.get(spark, sf_dir).flags)


@query("regional_distribution")
def regional_distribution(spark, sf_dir):
    return reports.regional_distribution(Workspace.get(spark, sf_dir).flags)


@query("hourly_distribution")
def hourly_distribution(spark, sf_dir):
    return reports.hourly_distribution(Workspace.get(spark, sf_dir).flags)


@query("day_of_week_analysis")
def day_of_week_analysis(spark, sf_dir):
    return reports.day_of_week_analysis(Workspace.get(spark, sf_dir).flags)


@query("payment_method_analysis")
def payment_method_analysis(spark, sf_dir):
    return reports.payment_method_analysis(Workspace.get(spark, sf_dir).flags)


@query("zscore_buckets")
def zscore_buckets(spark, sf_dir):
    return reports.zscore_buckets(Workspace.get(spark, sf_dir).flags)


@query("top_anomalous")
def top_anomalous(spark, sf_dir):
    return round6(reports.top_anomalous(Workspace.get(spark, sf_dir).flags), "amount_zscore")


@query("product_categories")
def product_categories(spark, sf_dir):
    t = Workspace.get(spark, sf_dir).tables
    return reports.product_categories(t["order_items"], t["products"])


@query("seller_performance")
def seller_performance(spark, sf_dir):
    t = Workspace.get(spark, sf_dir).tables
    return reports.seller_performance(t["order_items"], t["sellers"])


# ---- detector: features, forest, statistical flags ----------------------------------

from anomalytics.operators import dashboard, detector, iforest  # noqa: E402
from anomalytics.plans.workspace import Z_FLAG  # noqa: E402
from anomalytics import config as _cfg  # noqa: E402

_FEATURES = list(_cfg.FEATURE_COLUMNS)


@query("feature_table")
def feature_table(spark, sf_dir):
    return iforest.feature_table(Workspace.get(spark, sf_dir).features)


@query("standardized_features")
def standardized_features(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return round6(iforest.standardize(iforest.feature_table(ws.features)), *_FEATURES)


@query("iforest_model_summary")
def iforest_model_summary(spark, sf_dir):
    m = Workspace.get(spark, sf_dir).forest.model
    return m.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if("leaf").alias("n_leaves"),
        F.max("depth").alias("max_depth"),
        F.sum(F.when(F.col("leaf"), F.col("size"))).alias("n_sampled"),
        F.round(F.sum("threshold"), 4).alias("sum_threshold"),
        F.sum((F.col("feature") + 1).cast("long") * (F.col("node") + 1)).alias("feature_check"),
    ).orderBy("tree")


@query("iforest_scores")
def iforest_scores(spark, sf_dir):
    s = Workspace.get(spark, sf_dir).forest.scored
    return round6(s.select("order_id", "anomaly_probability", "anomaly_score", "is_anomaly_ml"), "anomaly_probability")


@query("iforest_anomaly_types")
def iforest_anomaly_types(spark, sf_dir):
    return dashboard.type_breakdown(Workspace.get(spark, sf_dir).detector_ml)


@query("iforest_summary_stats")
def iforest_summary_stats(spark, sf_dir):
    return detector.summary_stats(Workspace.get(spark, sf_dir).detector_ml)


@query("score_histogram")
def score_histogram(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    rows = ws.detector_ml
    return round6(dashboard.histogram(dashboard.filter_orders(rows, **ws.default_filters),
                                      "anomaly_probability", "anomaly_type"), "bin_start", "bin_end")


@query("anomaly_types")
def anomaly_types(spark, sf_dir):
    d = Workspace.get(spark, sf_dir).detector_z
    return round6(_d2d(d.select("order_id", "total_amount", "amount_zscore", "is_anomaly_iqr", Z_FLAG, "anomaly_type")),
                  "amount_zscore")


@query("summary_stats")
def summary_stats(spark, sf_dir):
    return detector.summary_stats(Workspace.get(spark, sf_dir).detector_z, Z_FLAG)


@query("anomalies_by_state")
def anomalies_by_state(spark, sf_dir):
    return detector.anomalies_by_state(Workspace.get(spark, sf_dir).detector_z, Z_FLAG)


@query("detector_monthly_trends")
def detector_monthly_trends(spark, sf_dir):
    return detector.monthly_trends(Workspace.get(spark, sf_dir).detector_z, Z_FLAG)


# ---- dashboard tables ------------------------------------------------------------------

def _filtered(ws: Workspace):
    rows = ws.detector_z
    return dashboard.filter_orders(rows, **ws.default_filters)


@query("kpi_metrics")
def kpi_metrics(spark, sf_dir):
    return dashboard.kpi_metrics(Workspace.get(spark, sf_dir).detector_z, Z_FLAG)


@query("filter_bounds")
def filter_bounds(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return round6(dashboard.filter_bounds(ws.detector_z, stats=ws.stats), "p99_amount")


@query("state_options")
def state_options(spark, sf_dir):
    return dashboard.state_options(Workspace.get(spark, sf_dir).detector_z)


@query("type_options")
def type_options(spark, sf_dir):
    return dashboard.type_options(Workspace.get(spark, sf_dir).detector_z)


@query("filtered_orders")
def filtered_orders(spark, sf_dir):
    f = _filtered(Workspace.get(spark, sf_dir))
    return _d2d(f.select("order_id", "customer_state", "order_purchase_timestamp", "total_amount", "anomaly_type"))


@query("filtered_orders_by_state_type")
def filtered_orders_by_state_type(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    rows = ws.detector_z
    first_state = dashboard.state_options(rows).first()["customer_state"]
    f = dashboard.filter_orders(rows, state=first_state, anomaly_type=_cfg.TYPE_NORMAL)
    return _d2d(f.select("order_id", "customer_state", "total_amount", "anomaly_type"))


@query("filter_counts")
def filter_counts(spark, sf_dir):
    ws = Workspace.get(spark, sf_dir)
    return dashboard.filter_counts(ws.detector_z, **ws.default_filters)


@query("amount_histogram")
def amount_histogram(spark, sf_dir):
    f = _filtered(Workspace.get(spark, sf_dir))
    return round6(dashboard.histogram(f, "total_amount", Z_FLAG), "bin_start", "bin_end")


@query("filtered_monthly")
def filtered_monthly(spark, sf_dir):
    return detector.monthly_trends(_filtered(Workspace.get(spark, sf_dir)), Z_FLAG).drop("total_revenue")


@query("top_states")
def top_states(spark, sf_dir):
    return dashboard.top_states(detector.anomalies_by_state(Workspace.get(spark, sf_dir).detector_z, Z_FLAG))


@query("hourly_rate")
def hourly_rate(spark, sf_dir):
    return dashboard.hourly_rate(_filtered(Workspace.get(spark, sf_dir)), Z_FLAG)


@query("type_breakdown")
def type_breakdown(spark, sf_dir):
    return dashboard.type_breakdown(_filtered(Workspace.get(spark, sf_dir)))


@query("flagged_detail")
def flagged_detail(spark, sf_dir):
    # the z > 3 rows all lie above the default p99 amount bound, so the IQR flag marks the rows here
    return dashboard.flagged_detail(_filtered(Workspace.get(spark, sf_dir)), detector.IQR, "amount_zscore")


@query("csv_export_roundtrip")
def csv_export_roundtrip(spark, sf_dir):
    from anomalytics.session import scratch_path
    from anomalytics.sources import sinks

    rows = Workspace.get(spark, sf_dir).detector_z.where(F.col(Z_FLAG))
    out = _d2d(rows.select("order_id", "customer_state", "total_amount", "amount_zscore", "anomaly_type"))
    path = sinks.write_csv(out, scratch_path(spark, "export"), sort_by="amount_zscore")
    return round6(sinks.read_csv_back(out, path), "amount_zscore")


# ---- roadmap operators -------------------------------------------------------------------

@query("category_anomalies")
def category_anomalies(spark, sf_dir):
    from anomalytics.operators import roadmap

    ws = Workspace.get(spark, sf_dir)
    return roadmap.category_anomalies(ws.flags, ws.tables["order_items"], ws.tables["products"])


@query("seller_anomalies")
def seller_anomalies(spark, sf_dir):
    from anomalytics.operators import roadmap

    return round6(roadmap.seller_anomalies(Workspace.get(spark, sf_dir).seller_table), "revenue_zscore")


@query("stream_flags")
def stream_flags(spark, sf_dir):
    from anomalytics.streaming import detection

    return detection.stream_flags(spark, sf_dir, Workspace.get(spark, sf_dir).event_stats).output


@query("stream_window_rates")
def stream_window_rates(spark, sf_dir):
    from anomalytics.streaming import detection

    return detection.stream_window_rates(spark, sf_dir, Workspace.get(spark, sf_dir).event_stats).output


# ---- SQL surface: report SQL over the registered analysis views ---------------------------

SQL_REGIONAL = """
WITH judged AS (
  SELECT customer_state, total_amount, amount_flag <> 'NORMAL' AS odd, amount_flag = 'HIGH_AMOUNT' AS high
  FROM v_anomaly_stats)
SELECT customer_state, count(*) AS total_orders, count_if(odd) AS anomaly_count,
       100.0D * count_if(odd) / count(*) AS anomaly_rate, double(sum(total_amount)) AS total_revenue,
       double(coalesce(sum(total_amount) FILTER (WHERE high), 0)) AS high_amount_revenue,
       double(sum(total_amount)) / count(total_amount) AS avg_order_value
FROM judged GROUP BY customer_state"""

SQL_HIGH_RISK_BY_STATE = """
SELECT customer_state, COUNT(*) AS high_risk_orders, MAX(anomaly_flag_count) AS max_flags,
       CAST(SUM(total_amount) AS DOUBLE) AS high_risk_revenue
FROM v_high_risk_transactions GROUP BY customer_state ORDER BY high_risk_orders DESC"""


@query("sql_regional_distribution")
def sql_regional_distribution(spark, sf_dir):
    from anomalytics.plans.views import register_analysis_views

    register_analysis_views(spark, Workspace.get(spark, sf_dir))
    return spark.sql(SQL_REGIONAL)


@query("sql_high_risk_by_state")
def sql_high_risk_by_state(spark, sf_dir):
    from anomalytics.plans.views import register_analysis_views

    register_analysis_views(spark, Workspace.get(spark, sf_dir))
    return spark.sql(SQL_HIGH_RISK_BY_STATE)


# ---- scale options: sketches kept by month, beside the exact values -------------------------------------------

from anomalytics.operators import sketches  # noqa: E402
from anomalytics.operators.quantiles import exact_percentiles  # noqa: E402


@query("seller_orders_approx")
def seller_orders_approx(spark, sf_dir):
    """Distinct orders per seller from monthly HLL sketches; ``within_bound``: at most four standard deviations off."""
    t = Workspace.get(spark, sf_dir).tables
    monthly = sketches.item_sketches(t["order_items"], t["orders"], "seller_id")
    approx = sketches.merged(monthly, ["seller_id"], distinct=["order_count"]).withColumnRenamed("order_count", "estimate")
    exact = t["order_items"].groupBy("seller_id").agg(F.countDistinct("order_id").alias("order_count"))
    off = F.abs(F.col("estimate") - F.col("order_count"))
    return exact.join(approx, "seller_id").select(
        "seller_id", "order_count", F.col("n_rows").alias("n_items"),
        (off <= F.greatest(F.lit(1.0), 4 * sketches.distinct_error() * F.col("order_count"))).alias("within_bound"))


@query("amount_quantiles_approx")
def amount_quantiles_approx(spark, sf_dir):
    """Quantiles of the amount from monthly KLL sketches; ``within_bound``: the rank of the estimate among all amounts
    is at most twice the sketch's error from the rank that was asked for."""
    rows = Workspace.get(spark, sf_dir).enriched_table
    probs = [0.25, 0.5, 0.75, 0.99]
    found = sketches.merged(sketches.amount_sketches(rows), [], quantiles={"amount": probs}).first()
    exact = exact_percentiles(rows, "total_amount", probs)
    amount = F.col("total_amount").cast("double")
    ranks = rows.agg(F.count("total_amount").alias("n"), *[
        f(F.when(side(amount, found[sketches.quantile_name("amount", p)]), 1)).alias(f"{kind}{i}")
        for i, p in enumerate(probs) for kind, f, side in (("lt", F.count, lambda a, b: a < b), ("le", F.count, lambda a, b: a <= b))]).first()
    slack = 2 * sketches.rank_error() * ranks["n"] + 1
    return spark.createDataFrame(
        [(p, round(e, 6), ranks["n"], ranks[f"lt{i}"] - slack <= p * ranks["n"] <= ranks[f"le{i}"] + slack)
         for i, (p, e) in enumerate(zip(probs, exact))], "p double, exact double, n bigint, within_bound boolean")


# ---- co-located order joins -----------------------------------------------------------------------------------

from anomalytics.operators import enrich as _enrich  # noqa: E402
from anomalytics.sources.bucketed import bucket_by_order  # noqa: E402


@query("orders_enriched_bucketed")
def orders_enriched_bucketed(spark, sf_dir):
    """E1 over tables that were written bucketed by order: no exchange below the two order joins."""
    return _d2d(_enrich.enriched_orders(bucket_by_order(Workspace.get(spark, sf_dir).tables)))


@query("zscore_buckets_null_apart")
def zscore_buckets_null_apart(spark, sf_dir):
    """G7 with the rows that have no z-score in a bucket of their own."""
    return reports.zscore_buckets(Workspace.get(spark, sf_dir).flags, null_bucket="No z-score")


@query("filtered_clustered_month")
def filtered_clustered_month(spark, sf_dir):
    """F6 over the kept detector rows clustered by month and state: one quarter, amounts up to 200,000."""
    import datetime as dt

    from anomalytics.session import scratch_path

    kept = dashboard.write_clustered(Workspace.get(spark, sf_dir).features, scratch_path(spark, "clustered"))
    found = dashboard.filter_clustered(kept, amount=(0.0, 200_000.0), dates=(dt.date(1995, 2, 10), dt.date(1995, 5, 3)))
    return _d2d(found.select("order_id", "customer_state", "total_amount", "order_purchase_timestamp"))
