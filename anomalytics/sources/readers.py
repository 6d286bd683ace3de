"""Read the logical tables from CSV or parquet into lazy DataFrames.

CSV is read by header name with fixed types (no inference pass over the data).
Reading is lazy: nothing is scanned until a query runs, and Catalyst prunes
columns and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics.sources.inference import infer_schema, typed
from anomalytics.sources.schemas import SCHEMAS

# ---- fixed values: file names of the public e-commerce data set --------------
FILE_PREFIX = "olist_"
FILE_SUFFIX = "_dataset.csv"
KNOWN_TABLES = (
    "orders",
    "order_items",
    "customers",
    "products",
    "sellers",
    "order_payments",
    "order_reviews",
    "geolocation",
)
# -----------------------------------------------------------------------------

#: tables whose values may hold line breaks
FREE_TEXT_TABLES = ("order_reviews",)


def table_name(file_name: str) -> str:
    """S3: 'olist_order_items_dataset.csv' -> 'order_items'."""
    base = os.path.basename(file_name)
    if base.startswith(FILE_PREFIX):
        base = base[len(FILE_PREFIX):]
    if base.endswith(FILE_SUFFIX):
        base = base[: -len(FILE_SUFFIX)]
    return base


def file_name(table: str, fmt: str = "csv") -> str:
    if fmt == "csv":
        return f"{FILE_PREFIX}{table}{FILE_SUFFIX}"
    return f"{table}.{fmt}"


def read_csv(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """CSV with header; the known tables' columns are taken by header name and cast to their types. An unknown
    table's types are inferred from all of its rows (one pass, see ``inference``).

    Columns may come in any order and others may stand beside them; a missing one is an error. Values may be quoted,
    with doubled quotes inside; the free-text table may hold line breaks in a value (such a file is not split).
    """
    table = table or table_name(path)
    raw = (
        spark.read.option("header", True).option("mode", "FAILFAST")
        .option("quote", '"').option("escape", '"').option("multiLine", table in FREE_TEXT_TABLES).csv(path)
    )
    schema = SCHEMAS.get(table)
    if schema is None:
        return typed(raw, infer_schema(raw))
    named = {c.strip().lstrip("\ufeff").lower(): c for c in raw.columns}
    absent = [f.name for f in schema if f.name not in named]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)} among {', '.join(raw.columns)}")
    return raw.select(*[F.col(f"`{named[f.name]}`").cast(f.dataType).alias(f.name) for f in schema])


def read_table(spark: SparkSession, folder: str, table: str, fmt: str = "csv") -> DataFrame:
    path = os.path.join(folder, file_name(table, fmt))
    if fmt == "csv":
        return read_csv(spark, path, table)
    return spark.read.format(fmt).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Path test through the Hadoop file system, so it works on shared storage too."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def load_all_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """Every known table that is present, as lazy DataFrames keyed by S3 name."""
    tables: dict[str, DataFrame] = {}
    for table in KNOWN_TABLES:
        path = os.path.join(folder, file_name(table, fmt))
        if _exists(spark, path):
            tables[table] = read_table(spark, folder, table, fmt)
    return tables


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table: one global count per table, unioned (one row each)."""
    parts = [
        df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """One temp view per table so the same data can be queried with spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
