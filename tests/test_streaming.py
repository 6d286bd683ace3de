"""Streaming: the availableNow result equals the batch result; late rows are dropped."""

import datetime as dt
import os

from pyspark.sql import functions as F

from anomalytics.operators.stats import ColumnStats
from anomalytics.streaming import detection

SF = "/root/testdata/sf0.001"


def test_stream_flags_equal_batch(spark):
    run = detection.stream_flags(spark, SF)
    batch_events = spark.read.parquet(os.path.join(SF, "events.parquet"))
    from anomalytics.operators.stats import column_stats

    batch = detection.flag_events(batch_events, column_stats(batch_events, "value"))
    a = sorted(map(tuple, run.output.select(*batch.columns).collect()))
    b = sorted(map(tuple, batch.collect()))
    assert a == b


def test_late_rows_beyond_watermark_are_dropped(spark, tmp_dir):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    day = dt.datetime(2024, 1, 1)

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(tmp_dir, name))

    write("f1", [(1, day + dt.timedelta(hours=1), 1, "view", 1.0, "{}"), (2, day + dt.timedelta(hours=2), 1, "view", 2.0, "{}")])
    write("f2", [(3, day + dt.timedelta(days=2, hours=5), 1, "view", 3.0, "{}")])
    write("f3", [(4, day + dt.timedelta(hours=3), 1, "view", 4.0, "{}")])   # a day-1 row after the watermark passed
    stats = ColumnStats(n=4, mean=2.5, std=1.0, q1=1.0, q3=4.0)
    files = [os.path.join(tmp_dir, d) for d in ("f1", "f2", "f3")]
    os.makedirs(os.path.join(tmp_dir, "stage"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(tmp_dir, "stage")))
    out = detection.windowed_rates(stream, stats)
    q = (out.writeStream.format("memory").queryName("late_test").outputMode("append").start())
    try:
        for f in files:
            part = [p for p in os.listdir(f) if p.endswith(".parquet")][0]
            os.link(os.path.join(f, part), os.path.join(tmp_dir, "stage", os.path.basename(f) + ".parquet"))
            q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.sql("SELECT * FROM late_test").collect()
    day1 = [r for r in rows if r["window_start"] == day]
    assert len(day1) == 1 and day1[0]["n_events"] == 2   # the late row did not reopen day 1


def test_window_rates_independent_of_caller_zone_and_zone_restored(spark):
    key = "spark.sql.session.timeZone"
    base = sorted(map(tuple, detection.stream_window_rates(spark, SF).output.collect()))
    spark.conf.set(key, "America/Sao_Paulo")
    try:
        other = sorted(map(tuple, detection.stream_window_rates(spark, SF).output.collect()))
        assert spark.conf.get(key) == "America/Sao_Paulo"   # the caller's zone is back
    finally:
        spark.conf.set(key, "UTC")
    assert other == base and base


def test_every_window_is_reported_also_from_a_folder_of_parts(spark, tmp_dir):
    events = spark.read.parquet(os.path.join(SF, "events.parquet"))
    one = detection.stream_window_rates(spark, SF).output
    assert one.agg(F.sum("n_events")).first()[0] == events.count()
    events.repartition(3).write.parquet(os.path.join(tmp_dir, "events.parquet"))
    parts = detection.stream_window_rates(spark, tmp_dir).output
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, one.collect()))
    assert detection.stream_flags(spark, tmp_dir).output.count() == events.count()
