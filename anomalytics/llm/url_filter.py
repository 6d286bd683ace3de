"""URL filter as a temporal list join.

Dated list changes (add / remove of a pattern) become validity intervals; every capture is joined as of its fetch
time with the entries active then. A pattern is a domain (it covers the domain and its subdomains) or a host with a
path prefix, so a capture asks only for the few keys its URL spells out: an equality join on the key with a range
condition on the time, never a scan of the list per capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def url_keys(url: Column) -> Column:
    """Every domain suffix of the host, and the host with every path prefix that ends at a slash or the end."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    paths = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(suffixes, F.coalesce(paths, F.array().cast("array<string>")))))


def lower_host(pattern: Column) -> Column:
    """The pattern with its host, all before the first slash, in lower case; paths keep their case."""
    host = F.regexp_extract(pattern, "^[^/]*", 0)
    return F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))


def validity_intervals(changes: DataFrame, pattern: str = "pattern", category: str = "category",
                       action: str = "action", at: str = "listed_at") -> DataFrame:
    """(pattern, category, valid_from, valid_to): an add holds until the next change of its pattern and category.

    Of changes at the same instant a remove wins, so ties and repeated rows make no difference. Changes with a null
    field are ignored. The last add has a null valid_to (open).
    """
    order = Window.partitionBy("pattern", "category").orderBy("valid_from")
    return (
        changes.select(lower_host(F.col(pattern)).alias("pattern"), F.col(category).alias("category"),
                       (F.col(action) == "add").alias("active"), F.col(at).alias("valid_from"))
        .dropna().groupBy("pattern", "category", "valid_from").agg(F.min("active").alias("active"))
        .withColumn("valid_to", F.lead("valid_from").over(order)).where("active").drop("active")
    )


def url_filter(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url",
               at_col: str = "fetched_at") -> DataFrame:
    """Verdict per capture: (id, url, at, blocked, n_active, categories, patterns) as of its fetch time.

    ``categories`` and ``patterns`` are the sorted, comma-joined distinct values of the entries active then.

    * A null or unreadable URL or a null time matches nothing: not blocked, n_active 0, empty strings.
    * Captures are judged one by one as (id, url, time); repeated rows give one row. A null id is a value like others.
    * Only the named columns are read. Empty captures give an empty result; an empty list blocks nothing.
    """
    seen = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("at")).distinct()
    entries = validity_intervals(changes)
    keyed = seen.withColumn("key", F.explode(url_keys(F.col("url"))))
    hits = (
        keyed.join(entries, (F.col("key") == F.col("pattern")) & (F.col("at") >= F.col("valid_from"))
                   & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
        .groupBy(F.col("id").alias("h_id"), F.col("url").alias("h_url"), F.col("at").alias("h_at"))
        .agg(F.count("*").alias("n"), F.collect_set("category").alias("c"), F.collect_set("pattern").alias("p"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in ("id", "url", "at")]
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return seen.join(hits, same[0] & same[1] & same[2], "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(at_col),
        F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        text("c").alias("categories"), text("p").alias("patterns"))
