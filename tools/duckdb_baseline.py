"""Time the oracle SQL of the bench queries on DuckDB (same machine, same parquet).

usage: python tools/duckdb_baseline.py [sf_dir]   -> one JSON line (median of 5 runs per query)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from tools.oracle_check import duck  # noqa: E402
from anomalytics.plans.oracle import oracle_sql  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duck(sf_dir)
    sql = oracle_sql()
    out = {}
    for name in HEADLINE:
        if name not in sql:
            continue
        runs = []
        for _ in range(5):
            t0 = time.perf_counter()
            con.execute(sql[name]).fetchall()
            runs.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(runs), 4)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "queries": out, "total": round(sum(out.values()), 3)}))
