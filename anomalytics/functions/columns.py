"""Column-expression helpers. All are built-in Spark expressions (JVM side,
inside whole-stage codegen); nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from anomalytics import config


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_of_week0(ts) -> Column:
    """Weekday with 0 = Sunday … 6 = Saturday (Spark's dayofweek is 1 = Sunday)."""
    return (F.dayofweek(_c(ts)) - F.lit(1)).cast("int")


def hours_after(ts, hours) -> Column:
    """ts + hours, on TIMESTAMP_NTZ (wall clock, no zone)."""
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return _c(ts) + F.make_dt_interval(F.lit(0), h.cast("int"), F.lit(0), F.lit(0))


def safe_div(num, den) -> Column:
    """num / den as DOUBLE, null when den is 0 or null (no ANSI divide error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    """100 * num / den as DOUBLE; null on zero denominator."""
    return safe_div(_c(num).cast("double") * F.lit(100.0), den)


def rate_pct(num, den) -> Column:
    return pct(num, den)


def count_when(cond: Column) -> Column:
    """Number of rows where cond is true, as BIGINT."""
    return F.count_if(cond).cast("bigint")


def sum_when(cond: Column, value) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END)."""
    v = _c(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def mean_decimal(col) -> Column:
    """Mean of a column as DOUBLE, computed as exact SUM then divided by COUNT.

    Summation stays exact (DECIMAL or BIGINT), so the result does not depend on
    partitioning or engine; only the final division rounds.
    """
    c = _c(col)
    return safe_div(F.sum(c), F.count(c))


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast every DECIMAL column to DOUBLE for the final output (column order kept)."""
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, DecimalType)}
    return df.withColumns(casts) if casts else df


def zscore_bucket(z, null_bucket: str | None = None) -> Column:
    """Seven z-score labels; a null z falls through to the top label, or gets ``null_bucket`` if that is given."""
    zc = _c(z)
    expr = None if null_bucket is None else F.when(zc.isNull(), F.lit(null_bucket))
    for bound, label in config.ZSCORE_BUCKETS:
        expr = F.when(zc < F.lit(bound), F.lit(label)) if expr is None else expr.when(zc < F.lit(bound), F.lit(label))
    return expr.otherwise(F.lit(config.ZSCORE_TOP_BUCKET))


def day_name(dow0) -> Column:
    c = _c(dow0)
    expr = None
    for i, name in enumerate(config.DAY_NAMES):
        expr = F.when(c == F.lit(i), F.lit(name)) if expr is None else expr.when(c == F.lit(i), F.lit(name))
    return expr


def money_text(x) -> Column:
    """'R$ 1,234.56' — thousands separator, two decimals."""
    return F.concat(F.lit("R$ "), F.format_number(_c(x).cast("double"), 2))


def fixed_text(x, digits: int = 4) -> Column:
    """Fixed-point text with `digits` decimals ('0.1234')."""
    return F.format_string(f"%.{digits}f", _c(x).cast("double"))
