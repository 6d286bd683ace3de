"""Statistics over a numeric column and per-row scores.

Global statistics are a handful of scalars computed in a few distributed
passes (moments in one aggregation, quantiles by ``exact_percentiles``) and
then used as literals in the per-row expressions — no join with the big side,
nothing but scalars reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.functions.columns import mean_decimal, safe_div
from anomalytics.operators.quantiles import exact_percentiles


@dataclass(frozen=True)
class GlobalStats:
    """A1: statistics of the rows that have an amount (Q3's min, max, median and p99 come from the same passes)."""
    n: int
    mean_amount: float | None
    std_amount: float | None
    q1: float | None
    q3: float | None
    mean_items: float | None
    std_items: float | None
    mean_installments: float | None
    std_installments: float | None
    min_amount: float | None = None
    max_amount: float | None = None
    median_amount: float | None = None
    p99_amount: float | None = None

    A1_FIELDS = ("mean_amount", "std_amount", "q1", "q3", "mean_items", "std_items",
                 "mean_installments", "std_installments")

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """A1 as one row (the v_global_stats columns)."""
        schema = ", ".join(f"{k} double" for k in self.A1_FIELDS)
        return spark.createDataFrame([tuple(getattr(self, k) for k in self.A1_FIELDS)], schema)

    def amount_summary(self, spark: SparkSession) -> DataFrame:
        """Q3 as one row."""
        return spark.createDataFrame(
            [(self.n, self.mean_amount, self.std_amount, self.min_amount, self.max_amount,
              self.q1, self.median_amount, self.q3, self.p99_amount)],
            "total_orders bigint, avg_order_amount double, std_order_amount double, min_order_amount double, "
            "max_order_amount double, q1_amount double, median_amount double, q3_amount double, p99_amount double",
        )


def global_stats(enriched: DataFrame, amount: str = "total_amount") -> GlobalStats:
    """A1 (and Q3) in two distributed passes: moments and extremes, then the exact quantiles."""
    rows = enriched.where(F.col(amount).isNotNull())
    m = rows.agg(
        F.count(F.lit(1)).alias("n"),
        mean_decimal(amount).alias("mean_amount"),
        F.stddev_samp(F.col(amount).cast("double")).alias("std_amount"),
        F.min(amount).cast("double").alias("min_amount"),
        F.max(amount).cast("double").alias("max_amount"),
        mean_decimal("total_items").alias("mean_items"),
        F.stddev_samp(F.col("total_items").cast("double")).alias("std_items"),
        mean_decimal("payment_installments").alias("mean_installments"),
        F.stddev_samp(F.col("payment_installments").cast("double")).alias("std_installments"),
    ).first()
    q1, median, q3, p99 = exact_percentiles(rows, amount, [0.25, 0.5, 0.75, 0.99], n=m["n"])
    return GlobalStats(
        n=m["n"], mean_amount=m["mean_amount"], std_amount=m["std_amount"], q1=q1, q3=q3,
        mean_items=m["mean_items"], std_items=m["std_items"],
        mean_installments=m["mean_installments"], std_installments=m["std_installments"],
        min_amount=m["min_amount"], max_amount=m["max_amount"], median_amount=median, p99_amount=p99,
    )


@dataclass(frozen=True)
class ColumnStats:
    """count, mean, sample std, q1, q3 of one numeric column."""
    n: int
    mean: float | None
    std: float | None
    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1


def column_stats(df: DataFrame, column: str) -> ColumnStats:
    m = df.where(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        mean_decimal(column).alias("mean"),
        F.stddev_samp(F.col(column).cast("double")).alias("std"),
    ).first()
    q1, q3 = exact_percentiles(df, column, [0.25, 0.75], n=m["n"])
    return ColumnStats(m["n"], m["mean"], m["std"], q1, q3)


def _lit(v) -> Column:
    return F.lit(v).cast("double")


def guarded_zscore(x, mean, std) -> Column:
    """A2: (x - mean) / std when std > 0, else 0 (null std also gives 0)."""
    xc = F.col(x) if isinstance(x, str) else x
    if std is None or not std > 0:
        return F.lit(0.0)
    return (xc - _lit(mean)) / _lit(std)


def unguarded_zscore(x, mean, std) -> Column:
    """(x - mean) / std; null where std is 0 or null (no divide error)."""
    xc = F.col(x) if isinstance(x, str) else x
    if mean is None or std is None:
        return F.lit(None).cast("double")
    return safe_div(xc - _lit(mean), _lit(std))


def iqr_fences(q1: float, q3: float, k: float) -> tuple[float, float]:
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def with_amount_zscore(df: DataFrame, column: str = "total_amount", out: str = "amount_zscore",
                       stats: ColumnStats | None = None) -> DataFrame:
    """A7 on any numeric column (detector rows by default)."""
    s = stats or column_stats(df, column)
    return df.withColumn(out, unguarded_zscore(column, s.mean, s.std))


def iqr_flag(x, q1, q3, k: float = config.IQR_MULTIPLIER) -> Column:
    """Strictly outside [q1 - k*IQR, q3 + k*IQR]."""
    xc = F.col(x) if isinstance(x, str) else x
    if q1 is None:
        return F.lit(False)
    lo = _lit(q1) - F.lit(k) * (_lit(q3) - _lit(q1))
    hi = _lit(q3) + F.lit(k) * (_lit(q3) - _lit(q1))
    return (xc < lo) | (xc > hi)


def with_iqr_flag(df: DataFrame, column: str = "total_amount", out: str = "is_anomaly_iqr",
                  stats: ColumnStats | None = None, k: float = config.IQR_MULTIPLIER) -> DataFrame:
    s = stats or column_stats(df, column)
    return df.withColumn(out, F.coalesce(iqr_flag(column, s.q1, s.q3, k), F.lit(False)))


def zscore_flag(z, limit: float = config.ZSCORE_OUTLIER) -> Column:
    """abs(z) > limit (documented method); null z is not an outlier."""
    zc = F.col(z) if isinstance(z, str) else z
    return F.coalesce(F.abs(zc) > F.lit(limit), F.lit(False))


def amount_summary(enriched: DataFrame, amount: str = "total_amount") -> DataFrame:
    """Q3: count, mean, sample std, min, max, q1, median, q3, p99 of the amount (the passes of A1)."""
    return global_stats(enriched, amount).amount_summary(enriched.sparkSession)
