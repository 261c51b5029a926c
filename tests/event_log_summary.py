"""Summarise a Spark event log: per job, its stages, task counts and times.

Usage: python tests/event_log_summary.py <event log file or folder> [top N jobs]
Reads the JSON lines Spark writes with ``spark.eventLog.enabled`` (a single
file, or a rolling ``eventlog_v2_*`` folder; zstd-compressed parts are
decompressed); no UI or server is involved.
"""

from __future__ import annotations

import io
import json
import os
import re
import sys
from collections import defaultdict


def event_lines(path: str):
    if os.path.isdir(path):
        parts = [f for f in os.listdir(path) if f.startswith("events_")]
        parts.sort(key=lambda f: int(re.match(r"events_(\d+)_", f).group(1)))
        files = [os.path.join(path, f) for f in parts]
    else:
        files = [path]
    for f in files:
        if f.endswith(".zstd"):
            import zstandard
            with open(f, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(f) as fh:
                yield from fh


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    jobs, stage_job, stages = {}, {}, {}
    tasks = defaultdict(list)
    if True:
        for line in event_lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                jobs[ev["Job ID"]] = {"start": ev["Submission Time"], "stages": ev["Stage IDs"],
                                      "desc": (ev.get("Properties") or {}).get(
                                          "spark.job.description", "")}
                for sid in ev["Stage IDs"]:
                    stage_job[sid] = ev["Job ID"]
            elif kind == "SparkListenerJobEnd":
                jobs.setdefault(ev["Job ID"], {})["end"] = ev["Completion Time"]
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                stages[info["Stage ID"]] = {
                    "name": info["Stage Name"], "tasks": info["Number of Tasks"],
                    "ms": info.get("Completion Time", 0) - info.get("Submission Time", 0)}
            elif kind == "SparkListenerTaskEnd":
                info = ev["Task Info"]
                tasks[ev["Stage ID"]].append(info["Finish Time"] - info["Launch Time"])
    rows = [(j.get("end", 0) - j.get("start", 0), jid, j) for jid, j in jobs.items() if "start" in j]
    total = sum(r[0] for r in rows)
    print(f"{len(rows)} jobs, {total / 1000:.1f} s in jobs")
    for ms, jid, j in sorted(rows, key=lambda r: -r[0])[:top]:
        print(f"job {jid}: {ms} ms")
        for sid in j["stages"]:
            st = stages.get(sid)
            if st:
                longest = max(tasks[sid], default=0)
                print(f"   stage {sid}: {st['tasks']} tasks, {st['ms']} ms, "
                      f"longest task {longest} ms  {st['name'][:60]}")


if __name__ == "__main__":
    main()
