"""Scale options of COUNT(DISTINCT) and PERCENTILE_CONT: mergeable sketches kept for each period.

A sketch table has one row per (keys, period). A new period is one pass over its own rows; a report over any span of
periods merges sketches and reads no old row. Distinct counts are HyperLogLog sketches (relative error about
1.04 / sqrt(2^lg_k), one standard deviation), quantiles KLL sketches (rank error about ``rank_error(k)``). The exact
operators stay beside them; these are for spans where an exact pass costs too much.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12                      # of an HLL sketch: 2^12 registers, at most 4 KB
KLL_K = 400                    # of a KLL sketch: some 10 KB


def distinct_error(lg_k: int = LG_K) -> float:
    """One standard deviation of a distinct count, relative to it."""
    return 1.04 / math.sqrt(1 << lg_k)


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a KLL sketch at about 99 % confidence."""
    return 2.446 / k ** 0.9433


def build(rows: DataFrame, keys: list[str], period: Column, distinct: dict[str, str] | None = None,
          quantiles: dict[str, str] | None = None, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """(keys, period, n_rows, and a binary column per sketch): ``distinct`` and ``quantiles`` map a name to the column
    that is counted or ranked. Partial sketches are merged in the shuffle, so a hot key sends one sketch a task.

    Nulls are left out of a sketch, as COUNT(DISTINCT) and PERCENTILE_CONT leave them out; a group of nulls only has an
    empty sketch (count 0, quantile null). Null keys are a group. Rows without a period have the null period.
    """
    made = [F.count(F.lit(1)).alias("n_rows")]
    for name, column in (distinct or {}).items():
        made.append(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg_k)).alias(name))
    for name, column in (quantiles or {}).items():
        made.append(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias(name))
    return rows.withColumn("period", period.cast("string")).groupBy(*keys, "period").agg(*made)


def merged(sketches: DataFrame, keys: list[str], distinct: list[str] = (),
           quantiles: dict[str, list[float]] | None = None) -> DataFrame:
    """(keys, n_rows, a bigint per distinct sketch, <name>_p<100 p> per quantile) over all periods of ``sketches``."""
    both = [F.sum("n_rows").alias("n_rows")]
    both += [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in distinct]
    both += [F.kll_merge_agg_double(name).alias(f"_{name}") for name in quantiles or {}]
    out = sketches.groupBy(*keys).agg(*both)
    for name, probs in (quantiles or {}).items():
        some = F.kll_sketch_get_n_double(f"_{name}") > 0
        for p in probs:
            out = out.withColumn(quantile_name(name, p), F.when(some, F.kll_sketch_get_quantile_double(f"_{name}", F.lit(p))))
        out = out.drop(f"_{name}")
    return out


def quantile_name(name: str, p: float) -> str:
    return f"{name}_p{100 * p:g}".replace(".", "_")


class SketchStore:
    """Sketches of every period, written under ``path`` (shared storage) by period.

    ``put`` replaces the periods that its rows have and leaves the others: a late file of one month costs one month.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, sketches: DataFrame) -> None:
        """Write the output of ``build``; periods that are there already are replaced."""
        (sketches.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period").parquet(self.path))

    def span(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Sketches of the periods ``first`` .. ``last`` (both in; None: no bound). Only their folders are read."""
        found = self.spark.read.option("basePath", self.path).parquet(self.path)
        found = found.withColumn("period", F.col("period").cast("string"))
        if first is not None:
            found = found.where(F.col("period") >= first)
        if last is not None:
            found = found.where(F.col("period") <= last)
        return found


def item_sketches(order_items: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Distinct orders per (item ``key``, purchase month): the approximate side of G9, G10 and R1. Items whose order is
    unknown have the null period."""
    month = orders.select("order_id", F.date_format("order_purchase_timestamp", "yyyy-MM").alias("_month"))
    rows = order_items.select("order_id", key).join(month, "order_id", "left")
    return build(rows, [key], F.col("_month"), distinct={"order_count": "order_id"})


def amount_sketches(enriched: DataFrame, amount: str = "total_amount") -> DataFrame:
    """Quantiles of the order amount per purchase month: the approximate side of A1, Q3 and V8."""
    return build(enriched, [], F.date_format("order_purchase_timestamp", "yyyy-MM"), quantiles={"amount": amount})
