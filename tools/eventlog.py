"""Job/stage timeline from a Spark event log folder (for local profiling).

usage: python tools/eventlog.py <event-log-dir> [job-group]
"""

from __future__ import annotations

import glob
import json
import sys


def events(folder: str):
    for f in sorted(glob.glob(folder + "/**/*", recursive=True)):
        if "appstatus" in f or not ("events" in f or "local-" in f):
            continue
        try:
            if f.endswith(".zstd"):
                import zstandard
                with open(f, "rb") as fh:
                    data = zstandard.ZstdDecompressor().stream_reader(fh).read().decode()
            else:
                with open(f) as fh:
                    data = fh.read()
        except (IsADirectoryError, UnicodeDecodeError):
            continue
        for line in data.splitlines():
            if line.strip():
                yield json.loads(line)


def main() -> None:
    folder = sys.argv[1]
    group = sys.argv[2] if len(sys.argv) > 2 else None
    jobs, stages = {}, {}
    for e in events(folder):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            jobs[e["Job ID"]] = [e["Submission Time"], None, props.get("spark.jobGroup.id"), e["Stage IDs"]]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si.get("Submission Time"), si.get("Completion Time"),
                                      si["Number of Tasks"], si["Stage Name"][:60])
    sel = [j for j, v in jobs.items() if group is None or v[2] == group]
    t0 = min(jobs[j][0] for j in sel)
    for j in sorted(sel):
        s, c, _, st = jobs[j]
        print(f"job {j:4d} start={(s - t0) / 1000:7.2f} dur={((c or s) - s) / 1000:6.2f} stages={len(st)}")
        for x in st:
            if x in stages and stages[x][0]:
                a, b, n, name = stages[x]
                print(f"      stage {x:5d} start={(a - t0) / 1000:7.2f} dur={(b - a) / 1000:6.2f} "
                      f"tasks={n:4d} {name}")


if __name__ == "__main__":
    main()
