"""EventMonitor: statistics that change between runs, closed windows, late rows, restarts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from anomalytics.operators.stats import ColumnStats
from anomalytics.streaming import EventMonitor, StatisticsTable

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DAY = dt.datetime(2024, 1, 1)
NARROW = ColumnStats(n=4, mean=2.0, std=1.0, q1=1.0, q3=2.0)      # fences -0.5 and 3.5
WIDE = ColumnStats(n=9, mean=5.0, std=5.0, q1=0.0, q3=100.0)


def at(hours, days=0):
    return DAY + dt.timedelta(days=days, hours=hours)


def arrive(spark, folder, rows):
    frame = spark.createDataFrame([(i, ts, 1, kind, value, "{}") for i, ts, kind, value in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(folder)


def counts(df):
    return sorted((r["window_start"], r["event_type"], r["n_events"], r["n_outliers"]) for r in df.collect())


def test_statistics_versions(spark, tmp_dir):
    table = StatisticsTable(spark, os.path.join(tmp_dir, "s"))
    with pytest.raises(ValueError, match="publish"):
        table.read()
    assert table.publish(NARROW) == 1 and table.publish(WIDE) == 2
    assert table.read() == (2, WIDE) and table.read(1) == (1, NARROW)


def test_runs_restarts_new_statistics_and_late_rows(spark, tmp_dir):
    source, folder = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "job")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        arrive(spark, source, [(1, at(1), "view", 1.0), (2, at(2), "view", 9.0), (3, None, "view", 9.0)])
        first = EventMonitor(spark, source, folder)
        first.statistics.publish(NARROW)
        assert first.advance() == 1
        assert counts(first.windows()) == [(at(0), "view", 2, 1)] and first.closed().count() == 0
        assert first.advance() == 1                                  # nothing has arrived

        first.statistics.publish(WIDE)
        arrive(spark, source, [(4, at(23), "view", 9.0), (5, at(5, 2), "view", 9.0)])
        again = EventMonitor(spark, source, folder)                  # another process goes on from the folder
        assert again.advance() == 2
        assert counts(again.closed()) == [(at(0), "view", 3, 1)]     # the first day: its first two by version 1
        assert counts(again.still_open()) == [(at(0, 2), "view", 1, 0)]

        arrive(spark, source, [(6, at(3), "view", 9.0), (7, at(6, 2), "buy", None), (8, at(4, 1), "view", 1.0)])
        assert again.advance() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(r["event_id"] for r in again.late().collect()) == [3, 6, 8]    # the days of 6 and 8 were closed
    assert counts(again.windows()) == [(at(0), "view", 3, 1), (at(0, 2), "buy", 1, 0), (at(0, 2), "view", 1, 0)]
    versions = {r["event_id"]: r["stats_version"] for r in again.flags().collect()}
    assert versions == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2}
    total = again.windows().agg(F.sum("n_events")).first()[0] + again.late().count()
    assert total == again.flags().count() == 8                       # every event is in one window or set aside


@pytest.mark.parametrize("cut", ["before_late", "after_windows"])
def test_a_run_cut_off_is_finished_by_the_next_call(spark, tmp_dir, cut, monkeypatch):
    source, folder = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "job")
    arrive(spark, source, [(1, at(1), "view", 1.0), (2, at(1, 3), "view", 1.0)])
    monitor = EventMonitor(spark, source, folder)
    monitor.statistics.publish(NARROW)
    assert monitor.advance() == 1
    arrive(spark, source, [(3, at(2), "view", 1.0), (4, at(1, 9), "view", 9.0)])

    class Lost(Exception):
        pass

    whole = EventMonitor._count

    def cut_off(self, run):
        if cut == "after_windows":
            whole(self, run)
            done = os.path.join(folder, f"progress/run={run}/_SUCCESS")
            os.rename(done, os.path.join(tmp_dir, "not-committed"))       # as if the last write had not been committed
        raise Lost

    monkeypatch.setattr(EventMonitor, "_count", cut_off)
    with pytest.raises(Lost):
        monitor.advance()
    monkeypatch.setattr(EventMonitor, "_count", whole)
    arrive(spark, source, [(5, at(5, 3), "view", 1.0)])                   # late only after the run that was cut off
    resumed = EventMonitor(spark, source, folder)
    assert resumed.advance() == 3
    assert sorted(r["event_id"] for r in resumed.late().collect()) == [3, 5]
    assert counts(resumed.windows()) == [(at(0), "view", 1, 0), (at(0, 3), "view", 1, 0), (at(0, 9), "view", 1, 1)]
