"""The detector facade — immutable; each step returns a new DataFrame.

The flag columns are parameters: ``ml_col`` is the model's boolean flag
(the Isolation Forest's ``is_anomaly_ml`` by default) and ``iqr_col`` the
statistical one, so every report below also runs with any other boolean flag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.functions.columns import count_when, mean_decimal, pct, safe_div
from anomalytics.operators import iforest, stats as stats_op

ML = "is_anomaly_ml"
IQR = "is_anomaly_iqr"


def require_columns(df: DataFrame | None, *cols: str, step: str = "this step") -> DataFrame:
    """Refuse to run a step before the data it needs is there."""
    if df is None:
        raise ValueError(f"Data not loaded. Load data before {step}.")
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{step} needs columns {missing}; run the earlier steps first.")
    return df


def anomaly_type(ml: Column, iqr: Column) -> Column:
    """The last matching rule wins: both -> High Confidence, IQR -> Statistical, ML -> ML Detected."""
    return (
        F.when(ml & iqr, F.lit(config.TYPE_HIGH_CONFIDENCE))
        .when(iqr, F.lit(config.TYPE_STATISTICAL))
        .when(ml, F.lit(config.TYPE_ML))
        .otherwise(F.lit(config.TYPE_NORMAL))
    )


def with_statistical_flags(df: DataFrame, amount: str = "total_amount",
                           stats: stats_op.ColumnStats | None = None) -> DataFrame:
    """A7 + A8 on detector rows: ``amount_zscore`` (unguarded) and ``is_anomaly_iqr``."""
    require_columns(df, amount, step="add_statistical_flags")
    s = stats or stats_op.column_stats(df, amount)
    return df.select(
        "*",
        stats_op.unguarded_zscore(amount, s.mean, s.std).alias("amount_zscore"),
        F.coalesce(stats_op.iqr_flag(amount, s.q1, s.q3), F.lit(False)).alias(IQR),
    )


def with_anomaly_type(df: DataFrame, ml_col: str = ML, iqr_col: str = IQR) -> DataFrame:
    require_columns(df, ml_col, iqr_col, step="anomaly_type")
    return df.withColumn("anomaly_type", anomaly_type(F.col(ml_col), F.col(iqr_col)))


@dataclass(frozen=True)
class ForestResult:
    scored: DataFrame     # input rows + anomaly_probability, anomaly_score, is_anomaly_ml
    model: DataFrame      # node table
    cut: float            # score threshold
    psi: int


def with_isolation_forest(df: DataFrame, contamination: float = config.CONTAMINATION,
                          n_trees: int = config.N_TREES, seed: int = config.FOREST_SEED,
                          max_samples: int = config.MAX_SAMPLES, id_col: str = "order_id",
                          features=config.FEATURE_COLUMNS) -> ForestResult:
    """D1–D4 end to end: features -> fit -> score -> cut.

    The trees grow on the raw features: scaling a feature (D2) does not change an isolation tree, see ``iforest``.
    """
    from anomalytics.session import materialize

    require_columns(df, id_col, *features, step="fit_isolation_forest")
    n = df.count()
    psi = min(max_samples, n)
    model = materialize(iforest.fit(df, features, id_col, n_trees, max_samples, seed, n=n))
    # score every input row in place (map-only, no join back), written once for the cut and the reports
    scored = materialize(iforest.score(df, model, psi, features, id_col, n_trees=n_trees))
    labelled, cut = iforest.label(scored, contamination, n=n)
    return ForestResult(labelled, model, cut, psi)


def summary_stats(df: DataFrame, ml_col: str = ML, iqr_col: str = IQR, amount: str = "total_amount") -> DataFrame:
    """One row of totals, counts, rates and means."""
    ml = F.col(ml_col)
    return df.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(amount).cast("double").alias("total_revenue"),
        count_when(ml).alias("anomaly_count_ml"),
        count_when(F.col(iqr_col)).alias("anomaly_count_iqr"),
        pct(count_when(ml), F.count(ml)).alias("anomaly_rate_ml"),
        F.coalesce(F.sum(F.when(ml, F.col(amount))).cast("double"), F.lit(0.0)).alias("anomaly_revenue"),
        mean_decimal(F.when(~ml, F.col(amount))).alias("avg_normal_order"),
        mean_decimal(F.when(ml, F.col(amount))).alias("avg_anomaly_order"),
    )


def anomalies_by_state(df: DataFrame, ml_col: str = ML, amount: str = "total_amount") -> DataFrame:
    """Per state (null state dropped, as a pandas group-by does), most anomalies first."""
    g = df.where(F.col("customer_state").isNotNull()).groupBy("customer_state").agg(
        F.count("order_id").alias("total_orders"),
        count_when(F.col(ml_col)).alias("anomaly_count"),
        F.sum(amount).cast("double").alias("total_amount"),
    )
    return g.withColumn("anomaly_rate", pct("anomaly_count", "total_orders")).orderBy(
        F.desc("anomaly_count"), F.asc("customer_state")
    )


def monthly_trends(df: DataFrame, ml_col: str = ML, amount: str = "total_amount",
                   ts: str = "order_purchase_timestamp") -> DataFrame:
    """Per calendar month 'yyyy-MM'."""
    g = df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count("order_id").alias("total_orders"),
        count_when(F.col(ml_col)).alias("anomaly_count"),
        F.sum(amount).cast("double").alias("total_revenue"),
    )
    return g.withColumn("anomaly_rate", pct("anomaly_count", "total_orders")).orderBy("month")


class RetailDetector:
    """Facade with the reference detector's steps; every call returns a new detector."""

    def __init__(self, df: DataFrame | None = None, contamination: float = config.CONTAMINATION,
                 ml_col: str = ML):
        self.df = df
        self.contamination = contamination
        self.ml_col = ml_col
        self.forest: ForestResult | None = None

    def _with(self, df: DataFrame) -> "RetailDetector":
        out = RetailDetector(df, self.contamination, self.ml_col)
        out.forest = self.forest
        return out

    def fit_isolation_forest(self) -> "RetailDetector":
        require_columns(self.df, step="fit_isolation_forest")
        res = with_isolation_forest(self.df, self.contamination)
        out = self._with(res.scored)
        out.forest = res
        return out

    def add_statistical_flags(self) -> "RetailDetector":
        require_columns(self.df, step="add_statistical_flags")
        df = with_statistical_flags(self.df)
        if self.ml_col in df.columns:
            df = with_anomaly_type(df, self.ml_col)
        return self._with(df)

    def get_summary_stats(self) -> DataFrame:
        return summary_stats(require_columns(self.df, self.ml_col, IQR, step="get_summary_stats"), self.ml_col)

    def get_anomalies_by_state(self) -> DataFrame:
        return anomalies_by_state(require_columns(self.df, self.ml_col, step="get_anomalies_by_state"), self.ml_col)

    def get_monthly_trends(self) -> DataFrame:
        return monthly_trends(require_columns(self.df, self.ml_col, step="get_monthly_trends"), self.ml_col)


def rate(num: Column, den: Column) -> Column:
    return safe_div(num * F.lit(100.0), den)
