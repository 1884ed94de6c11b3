"""Summarise the final (adaptive) physical plan of every catalogue query.

    python tools/plan_summary.py [sf_dir]     -> a markdown table on stdout

Counts are taken from the plan Spark actually ran (after AQE re-planning):
initial plans, reused stages and the build plans of cached relations are
left out.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pinax.plans import catalog  # noqa: E402
from pinax.session import build_session  # noqa: E402

COUNTS = {
    "scans": r"(FileScan|Scan parquet|BatchScan|InMemoryTableScan)",
    "shuffles": r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "broadcasts": r"BroadcastExchange",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "windows": r"\bWindow \[",
    "python": r"(MapInPandas|PythonMapInArrow|ArrowEvalPython|BatchEvalPython)",
}
_SKIP = ("== Initial Plan ==", "InMemoryRelation")


_NODE = re.compile(r"^[ :|]*(\+-|:-) ")


def _node_col(line: str) -> int | None:
    """Column of a node's branch mark (``+-`` / ``:-``), None for other lines
    (a root line, or a continuation of a literal holding a line break)."""
    m = _NODE.match(line)
    return m.end(1) - 2 if m else None


def final_plan(df) -> str:
    """The executed plan only.

    Drops every ``== Initial Plan ==`` section (the main query's and those of
    subqueries printed inside it) and the build plan under each
    ``InMemoryRelation`` (a cached relation is read by its InMemoryTableScan;
    its one-time build would otherwise be printed again at every use).
    Section ends are found from node lines only.
    """
    out, skip_col = [], None
    for ln in df._jdf.queryExecution().executedPlan().toString().splitlines():
        col = _node_col(ln)
        if skip_col is not None:
            if col is None or col > skip_col:
                continue
            skip_col = None
        if col is not None and any(m in ln for m in _SKIP):
            skip_col = col
            continue
        out.append(ln)
    return "\n".join(out)


def count_nodes(final: str) -> dict:
    """Node counts; reused stages and subqueries do no new work and are skipped."""
    lines = [ln for ln in final.splitlines() if "Reused" not in ln]
    return {k: sum(len(re.findall(p, ln)) for ln in lines) for k, p in COUNTS.items()}


def summarise(spark, sf_dir: str) -> list[tuple[str, dict]]:
    out = []
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()
        out.append((name, count_nodes(final_plan(df))))
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    rows = summarise(spark, sf_dir)
    print("| query | " + " | ".join(COUNTS) + " |")
    print("| --- | " + " | ".join("---" for _ in COUNTS) + " |")
    for name, c in rows:
        print(f"| {name} | " + " | ".join(str(c[k]) for k in COUNTS) + " |")


if __name__ == "__main__":
    main()
