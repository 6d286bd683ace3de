"""Every query with oracle SQL equals DuckDB on the driver's tables (sf0.001, and the
flagship at sf0.01); queries without SQL run and return rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from conftest import SF_ORACLE, SF_SMALL  # noqa: E402
import oracle_check  # noqa: E402

NAMES = sorted(queries())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "anomaly_rate" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = oracle_check.compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] in ("ok", "tol", "rows-only"), res


def test_flagship_matches_oracle_at_sf001(spark):
    res = oracle_check.compare(spark, SF_ORACLE, ["monthly_trends"], verbose=False)["monthly_trends"]
    assert res[0] == "ok", res
