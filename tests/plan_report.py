"""Print a markdown table of the physical plan shape of every registered query.

Usage: python tests/plan_report.py [sf_dir]
Counts, per query, the file scans, shuffle exchanges (hash / range / single),
broadcast exchanges and joins of the executed plan before it runs.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = [
    ("scans", r"FileScan "),
    ("hash shuffles", r"Exchange hashpartitioning"),
    ("range shuffles", r"Exchange rangepartitioning"),
    ("single-partition shuffles", r"Exchange SinglePartition"),
    ("broadcasts", r"BroadcastExchange"),
    ("broadcast joins", r"BroadcastHashJoin"),
    ("sort-merge joins", r"SortMergeJoin"),
    ("expand", r"Expand "),
    ("top-k", r"TakeOrderedAndProject"),
]


def main() -> None:
    from cohortlens.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry
    print("| query | " + " | ".join(k for k, _ in KINDS) + " | join types |")
    print("| --- |" + " --- |" * (len(KINDS) + 1))
    for name, q in entry.queries().items():
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(p, plan)) for _, p in KINDS]
        joins = sorted(set(re.findall(r"(LeftOuter|LeftSemi|LeftAnti|Inner), Build", plan)
                           + re.findall(r"SortMergeJoin \[[^]]*\], \[[^]]*\], (\w+)", plan)))
        print(f"| `{name}` | " + " | ".join(str(c) for c in counts) + f" | {', '.join(joins)} |")


if __name__ == "__main__":
    main()
