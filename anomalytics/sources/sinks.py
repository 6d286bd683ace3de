"""Write results.

S7 writes the flagged rows as CSV with a header, highest score first. The sort
is a range-partitioned global sort, so part files come out in order without
funnelling the rows through one task.

S8 keeps a processed table for reuse: written as parquet under the shared
checkpoint folder (or a given path) and read back, so later readers — in this
session or another — skip the processing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics.session import scratch_path


def write_csv(df: DataFrame, path: str, sort_by: str | None = "anomaly_probability",
              mode: str = "overwrite") -> str:
    out = df.orderBy(F.desc_nulls_last(sort_by), F.asc("order_id")) if sort_by else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv_back(df_like: DataFrame, path: str) -> DataFrame:
    """Read a CSV written by ``write_csv`` with the schema of the frame that was written."""
    return df_like.sparkSession.read.schema(df_like.schema).option("header", True).csv(path)


def keep_result(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write once as parquet, return the table read back."""
    target = path or scratch_path(df.sparkSession, "result")
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)
