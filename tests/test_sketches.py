"""Sketches kept by period, and inferred CSV types against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from anomalytics.operators import sketches
from anomalytics.session import scratch_path
from anomalytics.sources.inference import infer_schema
from anomalytics.sources.readers import read_csv


def test_monthly_sketches_merge_to_the_whole(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"),
        F.concat(F.lit("2020-0"), (F.col("id") % 4 + 1).cast("string")).alias("m"), (F.col("id") * 31 % 10_007).cast("double").alias("x"))
    store = sketches.SketchStore(spark, scratch_path(spark, "sketches"))
    made = lambda df: sketches.build(df, ["k"], F.col("m"), {"d": "v"}, {"q": "x"})
    for month in ("2020-01", "2020-02", "2020-03", "2020-04"):            # each month is one pass over its own rows
        store.put(made(rows.where(F.col("m") == month)))
    got = {r.k: r for r in sketches.merged(store.span(), ["k"], ["d"], {"q": [0.1, 0.5, 0.9]}).collect()}
    exact = {r.k: r for r in rows.groupBy("k").agg(F.countDistinct("v").alias("d"), F.count("*").alias("n")).collect()}
    for k, row in exact.items():
        assert got[k].n_rows == row.n and abs(got[k].d - row.d) <= 4 * sketches.distinct_error() * row.d
        own = sorted(r.x for r in rows.where(F.col("k") == k).select("x").collect())
        for p in (0.1, 0.5, 0.9):
            value = got[k][sketches.quantile_name("q", p)]
            rank = sum(v <= value for v in own) / len(own)
            assert abs(rank - p) <= 2 * sketches.rank_error() + 1 / len(own)
    part = sketches.merged(store.span("2020-02", "2020-03"), ["k"], ["d"]).agg(F.sum("n_rows")).first()[0]
    assert part == rows.where("m in ('2020-02', '2020-03')").count()


def test_a_period_is_replaced_alone(spark):
    store = sketches.SketchStore(spark, scratch_path(spark, "sketches"))
    make = lambda values: sketches.build(spark.createDataFrame(values, "m string, v bigint"), [], F.col("m"), {"d": "v"})
    store.put(make([("a", 1), ("a", 2), ("b", 3)]))
    store.put(make([("b", 4), ("b", 5), ("b", 6)]))
    assert sketches.merged(store.span(), [], ["d"]).first().d == 5
    assert {r.period: r.n_rows for r in store.span().collect()} == {"a": 2, "b": 3}


def test_nulls_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", None, None), (None, 5, 1.5)], "k string, v bigint, x double")
    got = {r.k: r for r in sketches.merged(sketches.build(rows, ["k"], F.lit("p"), {"d": "v"}, {"q": "x"}), ["k"], ["d"], {"q": [0.5]}).collect()}
    assert (got["a"].d, got["a"].q_p50) == (0, None) and (got[None].d, got[None].q_p50) == (1, 1.5)
    assert sketches.build(rows.where("false"), ["k"], F.lit("p"), {"d": "v"}).count() == 0


CSV = """whole,number,mixed_number,flag,day,moment,mixed_time,words,mostly_whole,nothing,zip
1,1.5,1,true,2020-01-02,2020-01-02 03:04:05,2020-01-02,a,1,,01000
-20,2e3,2.5,FALSE,2021-12-31,2021-12-31 23:59:59.5,2021-01-01 10:00:00,"b, c",2,,99999
,,,,,,,,,,
9007199254740993,-0.25,7,false,1999-02-28,2000-02-29 00:00:00,2022-05-05,1,x,,00007
"""


def test_inferred_types_are_duckdbs(spark, tmp_dir):
    path = os.path.join(tmp_dir, "unknown_table.csv")
    with open(path, "w") as f:
        f.write(CSV)
    names = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR"}
    got = read_csv(spark, path, "unknown_table")
    want = duckdb.sql(f"SELECT * FROM read_csv_auto('{path}', sample_size=-1)")
    assert {c: names[t] for c, t in got.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types)}
    assert [tuple(r) for r in got.collect()] == want.fetchall()


def test_a_late_odd_value_counts(spark):
    raw = spark.createDataFrame([(str(i), str(i)) for i in range(5000)] + [("7.5", "no number")], "a string, b string").repartition(7)
    assert [f.dataType.simpleString() for f in infer_schema(raw)] == ["double", "string"]
    odd = spark.createDataFrame([("99999999999999999999", "2020-13-01", "nan")], "a string, b string, `c.d` string")
    assert [f.dataType.simpleString() for f in infer_schema(odd)] == ["double", "string", "string"]
    assert [f.dataType.simpleString() for f in infer_schema(odd.where("false"))] == ["string"] * 3


@pytest.mark.parametrize("table", ["nation", "orders"])
def test_inferred_types_of_written_tables(spark, table):
    path = scratch_path(spark, f"{table}-csv")
    spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").coalesce(1).write.option("header", True).csv(path)
    got = dict(read_csv(spark, path, "unknown_table").dtypes)
    source = dict(spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").dtypes)
    assert {c: "bigint" if t == "int" else t for c, t in source.items()} == got
