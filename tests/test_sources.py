"""CSV sources and sinks: written CSV tables read back give the same results as parquet."""

import os

import pytest

from pyspark.sql import functions as F

from anomalytics.operators import enrich, flags, reports
from anomalytics.sources import readers, sinks
from anomalytics.sources import adapters

SF = "/root/testdata/sf0.001"


def _as_csv(t, folder):
    for name, df in t.items():
        target = os.path.join(folder, readers.file_name(name))
        (df.select([F.col(c).cast("string").alias(c) for c in df.columns])
         .coalesce(1).write.option("header", True).csv(target + ".dir"))
        part = [p for p in os.listdir(target + ".dir") if p.startswith("part-")][0]
        os.link(os.path.join(target + ".dir", part), target)


def test_naming_rule():
    assert readers.table_name("data/raw/olist_order_items_dataset.csv") == "order_items"
    assert readers.table_name("olist_geolocation_dataset.csv") == "geolocation"


def test_csv_and_parquet_give_equal_results(spark, tmp_dir):
    t = adapters.testdata_tables(spark, SF)
    logical = {
        "orders": t["orders"],
        "order_items": t["order_items"].select("order_id", "order_item_id", "product_id", "seller_id",
                                               F.lit(None).cast("timestamp_ntz").alias("shipping_limit_date"),
                                               "price", F.col("freight_value").cast("decimal(12,2)").alias("freight_value")),
        "customers": t["customers"].select("customer_id", F.lit(None).cast("string").alias("customer_unique_id"),
                                           "customer_zip_code_prefix", "customer_city", "customer_state"),
        "order_payments": t["order_payments"],
        "products": t["products"],
        "sellers": t["sellers"].select("seller_id", F.lit(None).cast("string").alias("seller_zip_code_prefix"),
                                       "seller_city", "seller_state"),
    }
    _as_csv(logical, tmp_dir)
    loaded = readers.load_all_tables(spark, tmp_dir, "csv")
    assert set(loaded) == set(logical)
    counts = {r["table_name"]: r["row_count"] for r in readers.table_row_counts(loaded).collect()}
    assert counts == {k: v.count() for k, v in logical.items()}

    def monthly(tb):
        return sorted(map(tuple, reports.monthly_trends(flags.anomaly_flags(enrich.enriched_orders(tb))).collect()),
                      key=str)

    assert monthly(loaded) == monthly(logical)
    readers.register_views(loaded, prefix="csv_")
    assert spark.sql("SELECT COUNT(*) FROM csv_orders").first()[0] == counts["orders"]


def test_csv_export_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.9, "b"), (3, 0.1, "c")],
                               "order_id bigint, anomaly_probability double, anomaly_type string")
    path = sinks.write_csv(df, os.path.join(tmp_dir, "out"))
    back = sinks.read_csv_back(df, path)
    assert [r["order_id"] for r in back.collect()] == [2, 1, 3]
    kept = sinks.keep_result(df, os.path.join(tmp_dir, "kept"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_csv_is_read_by_header_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "olist_products_dataset.csv")
    with open(path, "w") as f:
        f.write("product_photos_qty,product_category_name,product_name_lenght,product_id,product_weight_g\n"
                '3,"toys, ""new""",40,p1,100\n,,,p2,\n')
    got = readers.read_csv(spark, path)
    assert got.columns == ["product_id", "product_category_name"]
    assert sorted(map(tuple, got.collect())) == [("p1", 'toys, "new"'), ("p2", None)]
    with open(path, "w") as f:
        f.write("product_category_name\ntoys\n")
    with pytest.raises(ValueError, match="product_id"):
        readers.read_csv(spark, path)


def test_reviews_are_typed_and_may_hold_line_breaks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "olist_order_reviews_dataset.csv")
    with open(path, "w") as f:
        f.write("order_id,review_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
                'o1,r1,4,,"two\nlines, ""quoted""",2018-01-18 00:00:00,2018-01-18 21:46:59\n')
    row = readers.read_csv(spark, path).first()
    assert (row.review_id, row.order_id, row.review_score, row.review_comment_message) == ("r1", "o1", 4, 'two\nlines, "quoted"')
    assert row.review_answer_timestamp.second == 59
