"""The tables behind the dashboard, from one detector table.

All are aggregations over the detector rows (or a filtered view of them); the
only driver-side values are the filter bounds and histogram edges (scalars).
"""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from anomalytics import config
from anomalytics.functions.columns import count_when, fixed_text, mean_decimal, money_text, pct, safe_div
from anomalytics.operators.quantiles import exact_percentiles


def filter_predicate(state: str | None = None, anomaly_type: str | None = None,
                     amount: tuple[float, float] | None = None,
                     dates: tuple[dt.date, dt.date] | None = None,
                     ts: str = "order_purchase_timestamp"):
    """F6 as one boolean column: optional state, optional type, closed amount and date ranges."""
    cond = F.lit(True)
    if state is not None:
        cond = cond & (F.col("customer_state") == F.lit(state))
    if anomaly_type is not None:
        cond = cond & (F.col("anomaly_type") == F.lit(anomaly_type))
    if amount is not None:
        cond = cond & F.col("total_amount").between(F.lit(amount[0]), F.lit(amount[1]))
    if dates is not None:
        day_after = dt.datetime.combine(dates[1], dt.time()) + dt.timedelta(days=1)
        cond = cond & (F.col(ts) >= F.lit(dt.datetime.combine(dates[0], dt.time())).cast("timestamp_ntz"))
        cond = cond & (F.col(ts) < F.lit(day_after).cast("timestamp_ntz"))
    return cond


def filter_orders(df: DataFrame, **filters) -> DataFrame:
    """the rows that pass the dashboard filters.

    The bounds of a DECIMAL amount are DOUBLEs, so their comparison is not pushed into the scan; the same bounds
    rounded outwards to the column's type are, and they come first.
    """
    kind = df.schema["total_amount"].dataType
    if filters.get("amount") is not None and isinstance(kind, DecimalType):
        low, high = filters["amount"]
        unit = decimal.Decimal(1).scaleb(-kind.scale)
        outward = lambda v, way: F.lit(decimal.Decimal(v).quantize(unit, way)).cast(kind)
        df = df.where((F.col("total_amount") >= outward(low, decimal.ROUND_FLOOR))
                      & (F.col("total_amount") <= outward(high, decimal.ROUND_CEILING)))
    return df.where(filter_predicate(**filters))


def filter_bounds(df: DataFrame, ts: str = "order_purchase_timestamp", stats=None) -> DataFrame:
    """V8: amount min / max / p99 and first / last purchase date (one row).

    ``stats``, when known, are the global statistics of the same rows: then only the dates need a pass.
    """
    if stats is not None:
        low, high, p99 = (F.lit(v) for v in (stats.min_amount, stats.max_amount, stats.p99_amount))
    else:
        low, high = F.min("total_amount"), F.max("total_amount")
        p99 = F.lit(exact_percentiles(df, "total_amount", [0.99])[0])
    return df.agg(
        low.cast("double").alias("min_amount"),
        high.cast("double").alias("max_amount"),
        p99.cast("double").alias("p99_amount"),
        F.to_date(F.min(ts)).alias("min_date"),
        F.to_date(F.max(ts)).alias("max_date"),
    )


def default_filters(df: DataFrame, ts: str = "order_purchase_timestamp", stats=None) -> dict:
    """The dashboard's initial filter values: all states and types, amount [min, p99], all dates."""
    b = filter_bounds(df, ts, stats).first()
    return {"amount": (b["min_amount"], b["p99_amount"]), "dates": (b["min_date"], b["max_date"])}


def state_options(df: DataFrame) -> DataFrame:
    """V8: sorted distinct non-null states."""
    return df.where(F.col("customer_state").isNotNull()).select("customer_state").distinct().orderBy("customer_state")


def type_options(df: DataFrame) -> DataFrame:
    return df.select("anomaly_type").distinct().orderBy("anomaly_type")


def filter_counts(df: DataFrame, **filters) -> DataFrame:
    """V9: shown vs total, both from one scan."""
    return df.agg(count_when(F.coalesce(filter_predicate(**filters), F.lit(False))).alias("shown_orders"),
                  F.count(F.lit(1)).alias("total_orders"))


def kpi_metrics(df: DataFrame, ml_col: str, amount: str = "total_amount") -> DataFrame:
    """V1: orders, anomalies + rate, revenue at risk + share, avg anomaly value + lift over normal."""
    ml = F.col(ml_col)
    g = df.agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_when(ml).alias("anomaly_count"),
        F.sum(amount).alias("_rev"),
        F.coalesce(F.sum(F.when(ml, F.col(amount))), F.lit(0)).alias("_arev"),
        mean_decimal(F.when(ml, F.col(amount))).alias("avg_anomaly_order"),
        mean_decimal(F.when(~ml, F.col(amount))).alias("avg_normal_order"),
    )
    return g.select(
        "total_orders",
        "anomaly_count",
        pct("anomaly_count", "total_orders").alias("anomaly_rate"),
        F.col("_arev").cast("double").alias("anomaly_revenue"),
        pct("_arev", "_rev").alias("revenue_at_risk_pct"),
        "avg_anomaly_order",
        ((safe_div("avg_anomaly_order", "avg_normal_order") - F.lit(1.0)) * F.lit(100.0)).alias("avg_vs_normal_pct"),
    )


def histogram(df: DataFrame, value: str, split: str, bins: int = config.HISTOGRAM_BINS) -> DataFrame:
    """V2 / V3: equal-width bins over [min, max] (the top edge goes to the last bin), split by ``split``."""
    b = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], f"bin int, bin_start double, bin_end double, {split} string, count bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(value).cast("double")
    binc = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    g = df.where(x.isNotNull()).groupBy(binc.alias("bin"), F.col(split).cast("string").alias(split)).agg(
        F.count(F.lit(1)).alias("count")
    )
    return g.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        split,
        "count",
    ).orderBy("bin", split)


def hourly_rate(df: DataFrame, ml_col: str) -> DataFrame:
    """V6: anomaly rate per purchase hour (null hours dropped)."""
    g = df.where(F.col("hour_of_day").isNotNull()).groupBy("hour_of_day").agg(
        F.count("order_id").alias("total_orders"), count_when(F.col(ml_col)).alias("anomaly_count")
    )
    return g.withColumn("anomaly_rate", pct("anomaly_count", "total_orders")).orderBy("hour_of_day")


def type_breakdown(df: DataFrame) -> DataFrame:
    """V7: count and percent per anomaly_type (window over the handful of type rows)."""
    g = df.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("percent", pct("count", F.sum("count").over(Window.partitionBy()))).orderBy(
        F.desc("count"), "anomaly_type"
    )


def top_states(by_state: DataFrame, k: int = config.TOP_STATES_LIMIT) -> DataFrame:
    """V5: the k states with most anomalies (ties by state name)."""
    return by_state.orderBy(F.desc("anomaly_count"), F.asc("customer_state")).limit(k)


def flagged_detail(df: DataFrame, ml_col: str, score_col: str, k: int = config.DETAIL_LIMIT) -> DataFrame:
    """Flagged rows by score, first k, display formats and headers."""
    h = config.DETAIL_HEADERS
    top = df.where(F.col(ml_col)).orderBy(F.desc_nulls_last(score_col), F.asc("order_id")).limit(k)
    return top.select(
        F.col("order_id").alias(h[0]),
        F.col("customer_state").alias(h[1]),
        money_text("total_amount").alias(h[2]),
        F.col("total_items").alias(h[3]),
        F.col("payment_installments").alias(h[4]),
        F.col("hour_of_day").alias(h[5]),
        fixed_text(score_col, 4).alias(h[6]),
        F.col("anomaly_type").alias(h[7]),
    )


MONTH = "purchase_month"


def write_clustered(df: DataFrame, path: str, ts: str = "order_purchase_timestamp", per_file: int = 5_000_000) -> DataFrame:
    """F6 on a kept table: ``df`` written in folders by purchase month, sorted by state, and read again.

    A date filter then lists the folders it needs and reads no other file; a state filter is pushed to the scan, where
    the bounds of sorted files and row groups let it skip most of them. Rows meet by (month, state) range before they
    are written, ranges that hold a hot state are cut by the order's time, and a file has ``per_file`` rows at most.
    Orders without a time have a folder of their own.
    """
    keyed = df.withColumn(MONTH, F.date_format(ts, "yyyy-MM"))
    (keyed.repartitionByRange(MONTH, "customer_state", ts).sortWithinPartitions(MONTH, "customer_state", ts)
     .write.option("maxRecordsPerFile", per_file).partitionBy(MONTH).parquet(path))
    kinds = {f.name: f.dataType for f in keyed.schema}
    found = df.sparkSession.read.schema(keyed.schema).parquet(path)
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keyed.columns])


def filter_clustered(df: DataFrame, **filters) -> DataFrame:
    """F6 over a table of ``write_clustered``: a date range also names its months, so that other folders are not read."""
    dates = filters.get("dates")
    if dates is not None:
        df = df.where(F.col(MONTH).between(dates[0].strftime("%Y-%m"), dates[1].strftime("%Y-%m")))
    return filter_orders(df, **filters).drop(MONTH)
