"""Kept tables are shared between sessions, computed anew for a changed input, and deleted after their time."""

import os

import pytest

from anomalytics.plans.kept import KeptTables, input_fingerprint
from anomalytics.plans.workspace import Workspace


class Clock:
    now = 1_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture()
def setup(spark, tmp_dir):
    source = os.path.join(tmp_dir, "in")
    spark.range(10).write.parquet(source)
    built = []

    def build(session=spark):
        built.append(1)
        return session.read.parquet(source).selectExpr("id * 2 AS twice")

    return source, os.path.join(tmp_dir, "kept"), build, built


def test_second_session_reuses_and_changed_input_recomputes(spark, setup):
    source, folder, build, built = setup
    clock = Clock()
    first = KeptTables(spark, folder, clock=clock).get("t", [source], build)
    clock.now += 3000
    other = spark.newSession()
    again = KeptTables(other, folder, clock=clock).get("t", [source], lambda: build(other))
    assert len(built) == 1 and again.inputFiles() == first.inputFiles() and again.count() == 10
    KeptTables(spark, folder, clock=clock).get("t", [source], build, version="2")          # another definition
    assert len(built) == 2
    spark.range(10, 15).write.mode("append").parquet(source)
    clock.now += 1
    assert KeptTables(spark, folder, clock=clock).get("t", [source], build).count() == 15 and len(built) == 3


def test_expired_tables_are_computed_anew_and_deleted_after_the_lease(spark, setup):
    source, folder, build, built = setup
    clock = Clock()
    kept = KeptTables(spark, folder, ttl=100, lease=1000, clock=clock)
    old = kept.get("t", [source], build)
    clock.now += 100
    new = kept.get("t", [source], build)
    assert len(built) == 2 and old.count() == 10                  # under lease: still readable
    clock.now += 1000
    assert kept.sweep() == 1 and kept.sweep() == 0
    assert not any(os.path.exists(f.removeprefix("file://")) for f in old.inputFiles()) and new.count() == 10


def test_a_write_that_was_not_finished_is_not_read(spark, setup):
    source, folder, build, built = setup
    clock = Clock()
    home = os.path.join(folder, "t", input_fingerprint(spark, [source]), str(int(clock.now * 1000) - 5))
    spark.range(3).selectExpr("id AS twice").write.parquet(home)
    os.rename(os.path.join(home, "_SUCCESS"), os.path.join(home, "_cut_off"))
    assert KeptTables(spark, folder, clock=clock).get("t", [source], build).count() == 10 and len(built) == 1


def test_workspaces_share_the_enriched_table(spark, tmp_dir):
    kept = KeptTables(spark, os.path.join(tmp_dir, "kept"))
    a, b = (Workspace(spark, "/root/testdata/sf0.001", kept).enriched_table for _ in range(2))
    assert a.inputFiles() == b.inputFiles()
    assert a.count() == Workspace(spark, "/root/testdata/sf0.001").enriched_table.count()
