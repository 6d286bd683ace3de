"""Captures and dated list changes derived from the ``pages`` table.

The tables hold neither fetch times nor block lists, so both are derived from the rows by fixed rules: a capture's
fetch time from its page id, and the list's history from the MD5 of each distinct host and of each distinct
host + first path step. The same rules stand in the query's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.url_filter import host_of, path_of

EPOCH = "2024-01-01 00:00:00"


def _days(n: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", _days((F.col("page_id") * 7919) % 730).alias("fetched_at"))


def changes_of(pages: DataFrame) -> DataFrame:
    """(pattern, category, action, listed_at): hosts are listed, taken off and some listed again; paths are listed."""
    host, step = host_of(F.col("url")), F.element_at(F.split(path_of(F.col("url")), "/"), 2)
    hosts = pages.select(host.alias("pattern")).where("pattern <> ''").distinct().withColumn("m", _number(F.col("pattern")))
    paths = (pages.where(F.size(F.split(path_of(F.col("url")), "/")) > 1).select(F.concat_ws("/", host, step).alias("pattern"))
             .where("pattern not like '/%' and pattern not like '%/'").distinct()
             .withColumn("m", _number(F.col("pattern"))))

    def change(rows: DataFrame, category: str, action: str, days: Column) -> DataFrame:
        return rows.select("pattern", F.lit(category).alias("category"), F.lit(action).alias("action"),
                           _days(days).alias("listed_at"))

    m = F.col("m")
    listed = hosts.where(m % 3 == 0)
    return (change(listed, "host", "add", m % 500)
            .unionByName(change(listed, "host", "remove", m % 500 + 20 + m % 90))
            .unionByName(change(listed.where(m % 2 == 0), "host", "add", m % 500 + 200))
            .unionByName(change(paths.where(m % 5 == 0), "path", "add", m % 600)))
