"""S8 and lineage: kept workspaces, written tables under the session's checkpoint folder."""

import re

from anomalytics.plans.workspace import Workspace
from anomalytics.session import ensure_checkpoint_dir, materialize

SF = "/root/testdata/sf0.001"


def _local(path: str) -> str:
    """'file:/a', 'file:///a' and '/a' all name the same local path."""
    return "/" + re.sub(r"^(file:)?/*", "", path)


def test_workspace_kept_within_ttl_and_fresh_after(spark):
    a = Workspace.get(spark, SF)
    assert Workspace.get(spark, SF) is a
    b = Workspace.get(spark, SF, ttl=0)          # expired: a fresh workspace replaces the kept one
    assert b is not a and Workspace.get(spark, SF) is b
    assert Workspace(spark, SF) is not b         # the constructor always starts fresh


def test_written_tables_live_in_the_session_checkpoint_folder(spark):
    folder = _local(spark.sparkContext.getCheckpointDir())
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()   # a set folder is kept
    df = materialize(spark.range(100), "probe")
    files = [_local(f) for f in df.inputFiles()]
    assert files and all(f.startswith(folder.rstrip("/") + "/") for f in files)
    assert df.count() == 100


def test_kept_enriched_table_is_read_from_written_files(spark):
    ws = Workspace(spark, SF)
    folder = _local(spark.sparkContext.getCheckpointDir())
    files = [_local(f) for f in ws.enriched_table.inputFiles()]
    assert files and all(f.startswith(folder.rstrip("/") + "/") for f in files)
    plan = ws.flags._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan            # lineage is cut: reports never go back to the raw tables


def test_cluster_session_without_shared_folder_is_refused():
    import pytest

    from anomalytics import session as sess

    class FakeContext:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSession:
        sparkContext = FakeContext()
        conf = FakeConf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sess.ensure_checkpoint_dir(FakeSession())


def test_detector_statistics_equal_a_direct_pass(spark):
    from anomalytics.operators import stats as stats_op

    for folder in (SF, "/root/testdata/sf0.01"):
        ws = Workspace(spark, folder)
        assert ws.detector_stats == stats_op.column_stats(ws.features, "total_amount")


def test_kept_dashboard_bounds_equal_bounds_of_the_detector_rows(spark):
    from anomalytics.operators import dashboard

    ws = Workspace(spark, SF)
    assert ws.default_filters == dashboard.default_filters(ws.detector_z)


def test_amount_summary_matches_numpy(spark):
    import numpy as np

    from anomalytics.operators import stats as stats_op

    amounts = [100.0, 101.5, 102.0, 250.0, 1.0, 500.25, 103.0, None]
    rows = [(i, a, i % 3 + 1, i % 5 + 1) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, "order_id int, total_amount double, total_items int, payment_installments int")
    got = stats_op.amount_summary(df).first()
    x = np.array([a for a in amounts if a is not None])
    want = [len(x), x.mean(), x.std(ddof=1), x.min(), x.max(), *np.percentile(x, [25, 50, 75, 99])]
    assert got[0] == len(x)
    assert np.allclose(list(got)[1:], want[1:], rtol=1e-12, atol=0)


def test_enriched_table_is_written_by_tasks_of_bounded_size(spark, monkeypatch):
    from anomalytics import session

    settings = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(key, None) for key in settings]
    plain = Workspace(spark, SF).enriched_table
    monkeypatch.setattr(session, "TASK_BYTES", 8 << 10)
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "1k")         # AQE joins partitions under 1 MB otherwise, which all of these are
    try:
        bounded = Workspace(spark, SF).enriched_table
    finally:
        spark.conf.unset(least)
    assert len(bounded.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions")) >= len(plain.inputFiles())
    assert sorted(map(str, bounded.collect())) == sorted(map(str, plain.collect()))
    assert [spark.conf.get(key, None) for key in settings] == before
