"""Wall-clock of each DuckDB restatement (parity_sql) on one folder of driver tables.

Context for bench.py: the same work done by a single-process vectorised engine.
usage: python tools/duck_times.py [sf_dir]   -> one JSON line
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

import parity_sql  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    times = {}
    for name, sql in parity_sql.SQL.items():
        t0 = time.perf_counter()
        con.execute(sql).fetchall()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"engine": "duckdb", "value": round(sum(times.values()), 3), "queries": times, "sf_dir": sf}))


if __name__ == "__main__":
    main()
