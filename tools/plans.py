"""Plan-shape summary of every catalogue query (initial adaptive plan, sf folder given).

For each query: shuffles (Exchange), broadcasts, join strategies, aggregates,
Parquet scans with pushed filters, and any Python/cartesian operators.
usage: python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from facetframe.plans import indexed  # noqa: E402, F401 (registers its queries)
from facetframe.plans.analogues import QUERIES  # noqa: E402
from facetframe.session import get_spark  # noqa: E402

NODES = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Generate", "TakeOrderedAndProject"]
BAD = ["PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=8)
    print("# Plan shapes of the registered queries\n")
    print(f"Initial physical plans (before AQE re-planning) at `{sf}`; AQE may turn shuffle joins "
          "into broadcast joins at run time once sizes are measured. Counts are operator nodes.\n")
    print("| query | Exchange | Broadcast | BHJ | SMJ | Agg (hash/object/sort) | scans (with pushed filters) | Python/cartesian |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = {n: len(re.findall(r"(?<![A-Za-z])" + n + r"(?![A-Za-z])", plan)) for n in NODES}
        scans = re.findall(r"FileScan parquet[^\n]*", plan)
        pushed = sum(1 for s in scans if re.search(r"PushedFilters: \[[^\]]", s))
        bad = [b for b in BAD if b in plan]
        print(f"| {name} | {c['Exchange']} | {c['BroadcastExchange']} | {c['BroadcastHashJoin']} | "
              f"{c['SortMergeJoin']} | {c['HashAggregate']}/{c['ObjectHashAggregate']}/{c['SortAggregate']} | "
              f"{len(scans)} ({pushed}) | {', '.join(bad) or 'none'} |")
    spark.stop()


if __name__ == "__main__":
    main()
