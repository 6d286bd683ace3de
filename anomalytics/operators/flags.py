"""A2–A4: per-order z-scores, rule flags and flag count (the v_anomaly_stats table).

Statistics are scalars (``GlobalStats``) applied as literals, so the flag
table is one narrow projection over the enriched orders: no join, no shuffle,
one whole-stage-codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalytics import config
from anomalytics.config import Thresholds, DEFAULT_THRESHOLDS
from anomalytics.operators.stats import GlobalStats, global_stats, guarded_zscore


def _d(v) -> Column:
    return F.lit(v).cast("double")


def flag_columns(stats: GlobalStats, th: Thresholds = DEFAULT_THRESHOLDS) -> dict[str, Column]:
    amount = F.col("total_amount")
    q1, q3 = _d(stats.q1), _d(stats.q3)
    iqr = q3 - q1
    high = amount > q3 + F.lit(th.iqr_multiplier) * iqr
    low = amount < q1 - F.lit(th.iqr_multiplier) * iqr
    ext_high = amount > q3 + F.lit(th.extreme_multiplier) * iqr
    ext_low = amount < q1 - F.lit(th.extreme_multiplier) * iqr
    hour = F.col("hour_of_day").between(th.unusual_hour_first, th.unusual_hour_last)
    inst = F.col("payment_installments") > F.lit(th.max_normal_installments)
    size = F.col("total_items") > F.lit(th.max_normal_items)

    def one(c: Column) -> Column:
        return F.when(c, F.lit(1)).otherwise(F.lit(0))

    return {
        "amount_zscore": guarded_zscore("total_amount", stats.mean_amount, stats.std_amount),
        "items_zscore": guarded_zscore("total_items", stats.mean_items, stats.std_items),
        "amount_flag": F.when(high, config.LABEL_HIGH_AMOUNT).when(low, config.LABEL_LOW_AMOUNT)
        .otherwise(config.LABEL_NORMAL),
        "extreme_flag": F.when(ext_high, config.LABEL_EXTREME_HIGH).when(ext_low, config.LABEL_EXTREME_LOW)
        .otherwise(config.LABEL_NORMAL),
        "time_flag": F.when(hour, config.LABEL_UNUSUAL_HOUR).otherwise(config.LABEL_NORMAL),
        "installment_flag": F.when(inst, config.LABEL_HIGH_INSTALLMENTS).otherwise(config.LABEL_NORMAL),
        "size_flag": F.when(size, config.LABEL_LARGE_ORDER).otherwise(config.LABEL_NORMAL),
        # A4: extreme is not counted
        "anomaly_flag_count": (one(high) + one(low) + one(hour) + one(inst) + one(size)).cast("int"),
    }


def anomaly_flags(enriched: DataFrame, stats: GlobalStats | None = None,
                  th: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """A3 + A4 over every enriched order (orders without an amount keep NORMAL, z null)."""
    s = stats or global_stats(enriched)
    cols = flag_columns(s, th)
    return enriched.select(
        "*",
        _d(s.mean_amount).alias("mean_amount"),
        _d(s.std_amount).alias("std_amount"),
        _d(s.q1).alias("q1"),
        _d(s.q3).alias("q3"),
        *[c.alias(name) for name, c in cols.items()],
    )
